"""DuckDB SQL for those of the queries that SQL can express on whole tables in reasonable time.

The others have none: templates with a statistical merge (1), page layout (3),
a tokenizer (5, 8, 11, 13), trained models (6, 9). Tests compare them with plain
versions, round trips or held-out labels. Ids of documents are distinct here.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _split(text: str, between: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{between}'), lambda x: x <> '')"


_BLANK = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"

OP2 = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {_split("coalesce(text, '')", _BLANK)} AS w FROM documents),
l0 AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw FROM d),
l AS (SELECT *, array_to_string({_split("translate(regexp_replace(raw, '[0-9]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", _BLANK)}, ' ') AS line, len({_split("raw", _BLANK)}) AS n FROM l0),
lines AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM lines GROUP BY doc_id),
grams AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 7), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS k FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY doc_id),
texts AS (SELECT DISTINCT source, line, doc_id FROM lines),
hosts AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1),
often AS (SELECT t.source, line, min(doc_id) AS first FROM texts t JOIN hosts h ON t.source IS NOT DISTINCT FROM h.source GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) >= 0.005 * any_value(docs)),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN often o ON o.line = lines.line AND o.source IS NOT DISTINCT FROM lines.source AND o.first <> doc_id GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
 FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - n_removed_words >= 20 AND n_words - n_removed_words >= 0.5 * n_words AS kept FROM f
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_split("coalesce(text, '')", _BLANK)} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 34), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS p FROM twice),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
left_ AS (SELECT words.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY words.p) FILTER (gone.p IS NULL), '') AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN left_ USING (doc_id)
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {_split(_LOW, _NOT_WORD)} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_split(_LOW, _NOT_WORD)} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_split(_LOW, _BLANK)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(list_slice(w, k, k + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) >= 3) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e0 AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.o)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o) AS component_id, r.doc_id = min(o) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE)), true)),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id, x.label = a.label AS same, list_dot_product(a.v, x.v)::BIGINT AS score FROM e a JOIN e x ON x.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op4_substring_dedup": OP4, "op7_decontaminate": OP7, "op10_near_duplicates": OP10, "op12_hard_negatives": OP12}
