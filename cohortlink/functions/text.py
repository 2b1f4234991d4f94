"""Column functions on text: trimming, parsing, sanitising and HTML cleaning."""

from __future__ import annotations

import html
import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sent to tasks by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

# Markup whose content is no text of the page goes with its tags; any other tag ends a line.
_DROPPED = ["script", "style", "template", "rt", "rp"]
HIDDEN = re.compile("<(?:" + "|".join(
    [rf"{t}\b[^>]*>.*?(?:</{t}\s*>|\Z)" for t in _DROPPED] + [r"!--.*?(?:-->|\Z)", r"![^>]*>", r"\?[^>]*>"]) + ")",
    re.IGNORECASE | re.DOTALL)
BREAK = re.compile(r"<br\s*/?>", re.IGNORECASE)
TAG = re.compile(r"""</?[a-zA-Z](?:[^'">]|"[^"]*"|'[^']*')*>|</?[a-zA-Z][^>]*>""")
GAPS = re.compile(r"\n\s*\n+")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def normal_name(c) -> Column:
    """Trimmed lower-case form used for name comparison; null becomes empty."""
    return F.lower(F.coalesce(strip(c), F.lit("")))


def parse_dob(c) -> Column:
    """Date written year-month-day, or null when it is not one."""
    c = _col(c)
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "y-M-d"))


def parse_id(c) -> Column:
    """Whole number in text, or null when it is not one."""
    return strip(c).try_cast("bigint")


def sanitise(c) -> Column:
    """Keep ASCII letters, digits, dash and underscore."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_-]", "")


def iso_text(c, kind: T.DataType) -> Column:
    """Text of a value with dates and times in ISO form; a time of whole seconds shows no fraction."""
    c = _col(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def clean_text(text: str) -> str:
    """Text of a cell without markup, one text run per line.

    References are resolved before tags are removed, so escaped markup goes too, and once more
    after, as an HTML parser does with the text it finds.
    """
    text = BREAK.sub("\n", html.unescape(text))
    text = TAG.sub("\n", HIDDEN.sub("\n", text))
    return GAPS.sub("\n", html.unescape(text)).strip()


@F.pandas_udf(T.StringType())
def _clean(cells: pd.Series) -> pd.Series:
    return cells.map(clean_text, na_action="ignore")


def clean_html(c) -> Column:
    """:func:`clean_text` of a column; only cells that hold markup, references or line ends travel to Python."""
    c = _col(c)
    marked = c.rlike("[&<\n]")
    return F.when(marked, _clean(F.when(marked, c))).otherwise(strip(c))


def clean_strings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Apply :func:`clean_html` to every string column (or to those named)."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: clean_html(F.col(f"`{n}`")) for n in names})
