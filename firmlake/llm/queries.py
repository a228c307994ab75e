"""The queries of this package, one per operator, and their SQL."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm import alignment, bpe, fm_index, hnsw, html_template, language, line_dedup, minhash, periodic, sharding, toxicity, url_filter, warc
from firmlake.llm.registry import query, table
from firmlake.session import settle, work_path

SHARDS = 24


def vocabulary() -> str:
    """The word-level vocabulary; FIRMLAKE_VOCABULARY names another file."""
    own = os.environ.get("FIRMLAKE_VOCABULARY")
    if own:
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_vector_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(table(spark, folder, "documents"), SHARDS)


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
win AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT a.doc_id, a.k, a.n, p.item_id
  FROM (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase FROM win) a JOIN p USING (n, phrase)),
words AS (SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, k, n FROM hit))
  GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)"""


@query("op10_fm_index", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return fm_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = w.doc_id"""


@query("op9_minhash", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_speculative_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), vocabulary())


OP3_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
part AS (SELECT doc_id, p, unnest(u) AS line, generate_subscripts(u, 1) AS q FROM (SELECT doc_id, p, list_filter(list_transform(string_split(
    replace(replace(replace(x, '. ', '.' || chr(10)), '! ', '!' || chr(10)), '? ', '?' || chr(10)), chr(10)),
    lambda y: trim(y, E' \t\r\x0b\x0c')), lambda y: y <> '') AS u FROM raw) WHERE len(u) > 0),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, q) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM part),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM l),
w AS (SELECT a.doc_id, a.k AS i, min(b.k) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 30
    AND b.upto - a.upto + a.n >= 30 GROUP BY ALL
  UNION SELECT b.doc_id, max(a.k) AS i, b.k AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 30
    AND b.upto - a.upto + a.n >= 30 GROUP BY b.doc_id, b.k),
d AS (SELECT doc_id, list(line ORDER BY k) AS ls FROM l GROUP BY doc_id),
t AS (SELECT w.doc_id, i, j, array_to_string(ls[i : j], chr(10)) AS content FROM w JOIN d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, i) AS rn FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS k FROM r WHERE rn > 1),
n AS (SELECT l.doc_id, count(*) AS n, count(g.k) AS m FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id),
left_ AS (SELECT l.doc_id, p, string_agg(line, ' ' ORDER BY q) FILTER (WHERE g.k IS NULL) AS remains, count(g.k) AS m
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id, p),
kept AS (SELECT raw.doc_id, string_agg(CASE WHEN coalesce(m, 0) = 0 THEN x ELSE remains END, chr(10) ORDER BY p) AS kept
  FROM raw LEFT JOIN left_ USING (doc_id, p) GROUP BY raw.doc_id)
SELECT documents.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n = m THEN '' ELSE coalesce(kept, '') END) AS text_sha256
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op3_line_winnowing", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


@query("op4_nb_ngrams")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to FROM f"""


@query("op8_capture_index", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    place = work_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), f"{place}/archives")
    found = settle(warc.captures(spark, f"{place}/archives"), "captures")
    warc.write_index(found, f"{place}/index")
    hits = settle(warc.look_up(spark, f"{place}/index", found.select("url")), "hits")
    return warc.payloads(spark, f"{place}/index", hits).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"), "record_type", "refers_to",
    )


OP2_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


@query("op2_hnsw", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return hnsw.search(hnsw.build_index(rows), rows.where("vec_id % 50 = 0"))


# Captures and lists are derived from the pages: every page is a capture of its URL, and reports of pages put hosts,
# domains and URLs on a list and take them off again.
_FETCHED = "timestamp '2023-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast((page_id * 7919) % 17520 as int), 0, 0)"


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(_FETCHED).alias("fetched_at"))


def page_entries(pages: DataFrame) -> DataFrame:
    name = url_filter.host(F.col("url"))
    rows = pages.where("page_id is not null and url is not null").select(
        "page_id", "url", name.alias("host"), F.expr(_FETCHED.replace("7919", "104729")).alias("at")
    )
    kinds = (
        ("host", F.col("host"), "page_id % 40 = 7", 9), ("url", F.col("url"), "page_id % 5 = 1", 40),
        ("domain", F.array_join(F.slice(F.split("host", r"\."), -2, 2), "."), "page_id % 2000 = 3", 3),
    )
    out = None
    for scope, value, chosen, days in kinds:
        own = rows.where(chosen).select(F.lit(scope).alias("scope"), value.alias("value"), "at", "page_id")
        ends = F.col("at") + F.make_dt_interval(F.lit(days) + F.col("page_id") % 11)
        both = own.select("scope", "value", F.lit(True).alias("listed"), "at").union(own.select("scope", "value", F.lit(False), ends))
        out = both if out is None else out.union(both)
    return out


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
    THEN regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)', 2)), '\.+$', '') ELSE '' END AS host,
    TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST((page_id * 7919) % 17520 AS INTEGER)) AS fetched_at,
    TIMESTAMP '2023-01-01 00:00:00' + to_hours(CAST((page_id * 104729) % 17520 AS INTEGER)) AS at_
  FROM pages),
n AS (SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || host ||
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*((:[0-9]*)?[^#]*)', 1) ELSE url END AS clean,
    string_split(host, '.') AS labels FROM p),
listed AS (
  SELECT 'host:' || host AS key, at_, 9 + page_id % 11 AS days FROM n WHERE page_id % 40 = 7 AND url IS NOT NULL
  UNION ALL SELECT 'url:' || clean, at_, 40 + page_id % 11 FROM n WHERE page_id % 5 = 1 AND url IS NOT NULL
  UNION ALL SELECT 'domain:' || array_to_string(labels[greatest(len(labels) - 1, 1) :], '.'), at_, 3 + page_id % 11 FROM n
    WHERE page_id % 2000 = 3 AND url IS NOT NULL),
e AS (SELECT key, at_, max(state) AS state FROM (
    SELECT key, at_, 1 AS state FROM listed UNION ALL SELECT key, at_ + to_days(CAST(days AS INTEGER)), 0 FROM listed) GROUP BY ALL),
i AS (SELECT key, state, at_ AS a, lead(at_) OVER (PARTITION BY key ORDER BY at_) AS b FROM e),
k AS (SELECT DISTINCT page_id, url, fetched_at, unnest(list_distinct(['url:' || clean] || CASE WHEN host = '' THEN [] ELSE ['host:' || host] ||
    CASE WHEN len(labels) > 1 THEN list_transform(generate_series(1, len(labels) - 1),
      lambda j: 'domain:' || array_to_string(labels[j:], '.')) ELSE [] END END)) AS key FROM n WHERE url <> ''),
m AS (SELECT page_id, url, fetched_at, count(DISTINCT key) AS n, string_agg(DISTINCT key, ' ' ORDER BY key) AS reasons
  FROM k JOIN i USING (key) WHERE state = 1 AND fetched_at >= a AND (b IS NULL OR fetched_at < b) GROUP BY ALL)
SELECT p.page_id, p.url, strftime(p.fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, m.n IS NOT NULL AS blocked,
  CAST(coalesce(m.n, 0) AS BIGINT) AS n_reasons, coalesce(reasons, '') AS reasons
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url = m.url AND p.fetched_at = m.fetched_at"""


@query("op7_temporal_lists", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    out = url_filter.evaluate(page_captures(pages), page_entries(pages))
    return out.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


# In these pages the main text is what the article element holds; the operator finds that element by itself.
OP6_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h1|p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(t, '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""


@query("op6_template_slots", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.extract(table(spark, folder, "pages"))


# DuckDB has no crc32: a fold over the bytes of the decimal id, eight shifts for each.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda x, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, b)),
  CAST(4294967295 AS BIGINT)))"""

OP11_SQL = rf"""
WITH o AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_CRC} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a FROM o),
d AS (SELECT doc_id, n, list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) AS w FROM a),
p AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
part AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM same),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM part GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND s.q % t.q = 0 AND t.start <= s.start
  AND t.start + t.length >= s.start + s.length)),
sums AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs,
  arg_min(struct_pack(start := start, length := length, q := q), row(-length, start, q)) AS best FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length,
  CAST(best.q AS BIGINT) AS period, CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted loops: a tenth of the documents, by the hash of the id, go on in a loop from some word on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    first = g % n
    loop = words[first : first + 1 + (n - first) // (3 + g % 8)]
    return words[:first] + (loop * -(-(n - first) // len(loop)))[: n - first]


@query("op11_periodic_runs", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    runs = periodic.with_runs(table(spark, folder, "documents").select("doc_id", "text"), looped).select(
        "doc_id", "_runs", "_collapsed",
        F.expr("array_max(transform(_runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))").alias("best"),
        F.expr("array_join(transform(_runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')").alias("lines"),
    )
    return runs.select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_byte_gru")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict(table(spark, folder, "documents"))


@query("op13_token_links")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        a = f.read()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        b = f.read()
    out = alignment.align(table(spark, folder, "documents"), a, b, lambda groups: F.sha2(groups.cast("binary"), 256))
    return out.withColumnRenamed("groups", "groups_sha256")
