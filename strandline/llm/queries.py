"""The queries opN of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import ann, decontaminate, langid, lexical, lines, packing, paragraphs, quality, repeats, simhash, trie, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.report(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op9_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Rules of op11: longest wins.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.report(table(spark, sf_dir, "conversations"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_packing": op2_packing,
    "op3_lines": op3_lines,
    "op4_language_id": op4_language_id,
    "op5_repeats": op5_repeats,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_simhash": op8_simhash,
    "op9_paragraphs": op9_paragraphs,
    "op10_decontamination": op10_decontamination,
    "op11_url_filter": op11_url_filter,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
sized AS (SELECT item, ws, least(len(ws), 10) AS k FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM sized)),
p AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM sized) WHERE len(ws) >= k),
m AS (SELECT p.doc_id, p.i, p.k, w.item FROM p JOIN w ON p.k = w.k AND w.g = array_to_string(p.ws[p.i:p.i + p.k - 1], ' ')),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SYMBOLS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {15 - 5 * k}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8)
    for k in range(4)
)

OP6 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, {_SYMBOLS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""

OP11 = """
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT b.*, h || p AS rule, v FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f
"""

OP12 = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 100 AS base FROM t),
bits AS (SELECT c, base, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc FROM ids),
h AS (SELECT c, base, xor(crc, 4294967295) % 6 AS h FROM bits),
both_parts AS (SELECT h.c, 0 AS part, t.i, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.i <= h.h
  UNION ALL SELECT h.c, 1, t.i, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i > h.h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, md5(length(role) || ':' || role || text) AS k, length(text) AS n FROM both_parts),
keys AS (SELECT c, d, n, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS path FROM s
  UNION ALL SELECT c, 0, 0, '' FROM h),
last AS (SELECT c, max(d) AS len FROM keys GROUP BY c),
nodes AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS here,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM keys JOIN last USING (c) GROUP BY path, d),
kids AS (SELECT k.path, count(DISTINCT m.path) AS n_children FROM keys k JOIN keys m ON m.c = k.c AND m.d = k.d + 1 GROUP BY k.path),
up AS (SELECT m.path, min(n.conv_id) AS parent_conv_id FROM keys k JOIN keys m ON m.c = k.c AND m.d = k.d + 1 JOIN nodes n ON n.path = k.path GROUP BY m.path),
below AS (SELECT k.path, CAST(sum(u.here) AS BIGINT) AS saved_tokens, count(*) FILTER (u.path NOT IN (SELECT path FROM kids)) AS n_leaves
  FROM nodes u JOIN keys k ON k.c = u.conv_id AND k.d <= u.d GROUP BY k.path)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes LEFT JOIN kids USING (path) LEFT JOIN up USING (path) JOIN below USING (path)
"""

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, sum(len(ws)) AS terms FROM d),
t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT b, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS b, item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, s),
p AS (SELECT b, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN t USING (term), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0
QUALIFY rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op6_warc": OP6, "op10_decontamination": OP10, "op11_url_filter": OP11, "op12_prefix_trie": OP12, "op13_ranked_search": OP13}
