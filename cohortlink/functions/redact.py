"""Column functions that hide secrets, dates and names in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that announce a secret, and the marks put in place of what is hidden.
SECRET_WORDS = ["password", "pwd", "secret", "token", "key"]
SECRET_MARK = "***REDACTED***"
DATE_MARK = "***DATE***"

SECRET = rf"""(?i)({'|'.join(SECRET_WORDS)})['"]?\s*[:=]\s*['"]?[^\s'"]+"""

# Date forms that are hidden.
DATES = [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/\d{4}\b", r"\b\d{1,2}\.\d{1,2}\.\d{4}\b"]


def redact_secrets(c: Column) -> Column:
    """Replace the value after a secret word; the word stays."""
    return F.regexp_replace(c, SECRET, rf"$1={SECRET_MARK}")


def redact_dates(c: Column) -> Column:
    """Replace every date."""
    for pattern in DATES:
        c = F.regexp_replace(c, pattern, F.lit(DATE_MARK))
    return c


def mask_user(c: Column) -> Column:
    """First two letters and the last of a user name; short names vanish."""
    return F.when(F.length(c) > 4, F.concat(F.left(c, F.lit(2)), F.lit("***"), F.right(c, F.lit(1)))) \
        .when(F.length(c) > 0, F.lit("***"))


def mask_preview(c: Column) -> Column:
    """First and last three letters of a long value."""
    return F.when(F.length(c) > 10, F.concat(F.left(c, F.lit(3)), F.lit("..."), F.right(c, F.lit(3)))).otherwise(c)


def redact(df: DataFrame, columns: list[str], dates: bool = True) -> DataFrame:
    """Hide secrets, and dates unless told otherwise, in the named columns."""
    def hide(name):
        c = redact_secrets(F.col(name))
        return redact_dates(c) if dates else c
    return df.withColumns({n: hide(n) for n in columns})
