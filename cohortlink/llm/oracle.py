"""The queries that SQL can express, in DuckDB's dialect."""

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
_SIZE = r"length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

EXACT = f"""
WITH hashed AS (SELECT doc_id, sha256({_NORM}) AS text_sha256 FROM documents),
groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM hashed JOIN groups USING (text_sha256)
"""

MIX = f"""
WITH sized AS (SELECT doc_id, source, CAST({_SIZE} AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM per),
weighed AS (SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS most,
    source_size * 3.0::DOUBLE / CAST(place % 3 + 1 AS DOUBLE) AS full_at FROM placed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER w, 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level FROM weighed
    WINDOW w AS (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT * REPLACE ((SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, place LIMIT 1) AS level) FROM levels),
targeted AS (SELECT *, least(most, coalesce(level * weight, most)) AS target FROM leveled),
summed AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high
    FROM targeted),
lowered AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source NULLS LAST), 0.0) AS low, max(high) OVER () AS total FROM summed),
shares AS (SELECT source, source_size, target, total, CAST(floor(low / total * 4294967296) AS BIGINT) AS low,
    CAST(floor(high / total * 4294967296) AS BIGINT) AS high FROM lowered),
slots AS (SELECT slot, CAST((slot::HUGEINT * 2654435769) % 4294967296 AS BIGINT) AS point
    FROM (SELECT unnest(range(0, (SELECT CAST(ceil(max(total) / 32) AS BIGINT) FROM shares))) AS slot)),
ranked AS (SELECT source, source_size, target, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
    FROM slots JOIN shares ON point >= low AND point < high),
visits AS (SELECT source, rank % ((source_size + 31) // 32) AS block, count(*) AS visits
    FROM ranked WHERE target - rank * 32 > 0 GROUP BY ALL),
streams AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sized WHERE size > 0),
pieces AS (SELECT doc_id, source, start, size, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS block FROM streams),
taken AS (SELECT p.doc_id, sum((least(start + size, (p.block + 1) * 32) - greatest(start, p.block * 32))
    * coalesce(visits, 0)) AS taken FROM pieces p
    LEFT JOIN visits v ON p.source IS NOT DISTINCT FROM v.source AND p.block = v.block GROUP BY p.doc_id)
SELECT d.doc_id, d.size, s.source_size, s.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN taken t ON t.doc_id = d.doc_id
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
stats AS (SELECT CAST(count(*) FILTER (WHERE len(terms) > 0) AS BIGINT) AS n_docs, CAST(coalesce(sum(len(terms)), 0) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
occ AS (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT item_id, term, CAST(floor(1000.0 * ln((2.0 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), stats),
imp AS (SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // greatest(n_terms, 1))) AS impact
    FROM tf, stats),
scored AS (SELECT item_id, row, doc_id, sum(w * impact) AS score FROM imp JOIN w USING (term) GROUP BY item_id, row, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST, row) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""

ORACLE: dict[str, str] = {"op8_exact_dedup": EXACT, "op10_source_mix": MIX, "op12_lexical_search": SEARCH}
