"""The thin opN_ queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, exact_dedup, html_extract, language_id, license_scan, line_dedup, mixing, sharding, simhash, substring_dedup
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op1_decontamination"] = r"""
WITH alpha AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, alpha),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, alpha),
wins AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 8) AS n, array_to_string(w[s:s + 7], ' ') AS win
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.s, p.n, x.item FROM spots p JOIN wins x ON x.n = p.n AND x.win = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1),
near_terms AS (SELECT win, n, unnest(string_split(win, ' ')) AS term FROM (SELECT DISTINCT win, n FROM wins)),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(w) AS term FROM d) GROUP BY 1),
ranks AS (SELECT win, term FROM (SELECT win, t.term, row_number() OVER (PARTITION BY win ORDER BY coalesce(df, 0), t.term) AS r FROM near_terms t LEFT JOIN df ON df.term = t.term) WHERE r = 1),
tok AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i, w FROM d),
near AS (SELECT doc_id, count(DISTINCT win) AS n_near FROM (
  SELECT doc_id, win FROM tok JOIN ranks ON ranks.term = tok.term WHERE list_has_all(w[greatest(i - 7, 1):i + 7], string_split(win, ' '))) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


@_query
def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


ORACLES["op2_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r),
k AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
j AS (SELECT k.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY k.i) AS line FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(kept, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""


@_query
def op3_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_line_dedup"] = r"""
WITH d AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
w AS (SELECT doc_id, s, array_to_string(l[s:s + 2], chr(10)) AS h FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 3)) AS i FROM r),
k AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
j AS (SELECT k.doc_id, count(*) AS kept, string_agg(line, chr(10) ORDER BY k.i) AS body FROM k LEFT JOIN g ON g.doc_id = k.doc_id AND g.i = k.i WHERE g.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_lines, len(l) - coalesce(kept, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""


@_query
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query
def op5_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


@_query
def op6_source_mixing(spark, sf_dir):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return mixing.mix(table(spark, sf_dir, "documents")).select(*cols)


ORACLES["op6_source_mixing"] = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
m AS (SELECT *, md5(concat_ws('|', 'mix-1', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR))) AS h FROM d),
o AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM m),
s0 AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
s1 AS (SELECT *, row_number() OVER (ORDER BY k = '-', k) - 1 AS sid FROM s0),
s2 AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s1),
s3 AS (SELECT *, 3 * source_size AS cap, sum(weight) OVER () AS weights,
       coalesce(sum(3 * source_size) OVER f, 0) AS cap_before, coalesce(sum(weight) OVER f, 0) AS weight_before FROM s2
       WINDOW f AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - cap_before) * weight > cap * (weights - weight_before) AS is_full FROM s3),
s5 AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) AS DOUBLE) / CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target FROM s4),
src AS (SELECT *, coalesce(sum(target) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS reach, greatest(1, CAST(ceil(total / 65536.0) AS BIGINT)) AS block FROM s5),
p AS (SELECT id AS place, (CAST(id AS DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE * total AS at FROM (SELECT unnest(range(CAST(ceil(CAST(total AS DOUBLE) / block) AS BIGINT))) AS id, total FROM (SELECT DISTINCT total, block FROM src))),
a AS (SELECT place, sid, row_number() OVER (PARTITION BY sid ORDER BY place) - 1 AS r FROM p ASOF JOIN (SELECT sid, reach FROM src WHERE target > 0) q ON p.at >= q.reach),
n AS (SELECT sid, source_size, block, CAST(ceil(CAST(source_size AS DOUBLE) / block) AS BIGINT) AS n FROM src WHERE source_size > 0),
u AS (SELECT a.sid, r % n AS b, count(*) AS uses FROM a JOIN n USING (sid) WHERE r < 3 * n GROUP BY 1, 2),
c0 AS (SELECT sid, source_size, block, unnest(range(n)) AS b FROM n),
c AS (SELECT c0.sid, c0.b, coalesce(uses, 0) AS uses, coalesce(sum(coalesce(uses, 0) * least(block, source_size - c0.b * block)) OVER (PARTITION BY c0.sid ORDER BY c0.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM c0 LEFT JOIN u ON u.sid = c0.sid AND u.b = c0.b),
x AS (SELECT doc_id, size, src.source_size, target, src.sid, block, e - size AS a, e, greatest(CAST(ceil(CAST(src.source_size AS DOUBLE) / block) AS BIGINT) - 1, 0) AS lastb FROM o JOIN src USING (k))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(coalesce(c2.t + c2.uses * (e - c2.b * block), 0) - coalesce(c1.t + c1.uses * (a - c1.b * block), 0) AS BIGINT) AS taken
FROM x LEFT JOIN c c1 ON c1.sid = x.sid AND c1.b = least(CAST(floor(a / block) AS BIGINT), lastb)
       LEFT JOIN c c2 ON c2.sid = x.sid AND c2.b = least(CAST(floor(e / block) AS BIGINT), lastb)
"""


@_query
def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op7_exact_dedup"] = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
WINDOW g AS (PARTITION BY h)
"""


@_query
def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@_query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs), keep=("doc_id",))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@_query
def op10_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


ORACLES["op10_license_scan"] = license_scan.oracle_sql()
