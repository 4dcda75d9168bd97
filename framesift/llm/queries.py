"""Each operator applied to its whole table, as one query."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, convnet, idfiles, jaccard, merkle, mixing, periodic, rules, suffixes, topk, urls, warc, wrappers
from framesift.llm.registry import query
from framesift.llm.shared import settled
from framesift.llm.words import words
from framesift.sources.shared import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules", """
WITH texts AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
listed AS (
  SELECT k, doc_id, source, t, list_filter(string_split_regex(t, '[ \\t-\\r]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \\t-\\r]')) AS ls
  FROM texts),
windows AS (
  SELECT k, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT k, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM listed)),
repeated AS (
  SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS before
  FROM (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, sum(least(3, i - coalesce(before, -9))) AS n FROM repeated GROUP BY k),
base AS (
  SELECT doc_id, source AS host, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[ \\t-\\r]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM listed LEFT JOIN covered USING (k)),
verdicts AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT host, sum(base_failed::INT)::DOUBLE AS f, count(*)::DOUBLE AS n FROM verdicts GROUP BY host),
sums AS (SELECT sum(f) AS sf, sum(n) AS sn, count(*)::DOUBLE AS h, sum(n * n) AS n2, sum(f * f / n) AS f2 FROM hosts),
prior AS (
  SELECT sf / sn AS p, sf / sn * (1 - sf / sn) AS pq, (f2 - sf * sf / sn - (h - 1) * (sf / sn) * (1 - sf / sn)) / (sn - n2 / sn) AS v
  FROM sums),
weighed AS (SELECT p, CASE WHEN v > 0 AND isfinite(v) THEN least(1000, greatest(0, pq / v - 1)) ELSE 1000 END AS w FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (f + p * w) / (n + w) <= 0.75 AS kept
FROM verdicts JOIN hosts ON verdicts.host IS NOT DISTINCT FROM hosts.host CROSS JOIN weighed
""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents judged by their words and by their source's rate of failures."""
    return rules.judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op7_url_filters", """
WITH rules (h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT row_number() OVER () AS k, page_id, strpos(url, '://') AS s, url FROM pages),
parts AS (
  SELECT k, page_id, CASE WHEN s > 0 THEN regexp_extract(substr(url, s + 3), '^[^/?#]*') ELSE '' END AS raw,
    CASE WHEN s > 0 THEN regexp_extract(substr(url, s + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut),
named AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM named LEFT JOIN best USING (k)
""")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs under five rules."""
    listed = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judged(table(spark, sf_dir, "pages"), listed)


@query("op5_mixing", """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, n, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source)),
levels (k, level) AS (
  SELECT 1, (SELECT sum(n)::DOUBLE * 150 / 100 / sum(w) FROM sources)
  UNION ALL
  SELECT k + 1, (SELECT ((SELECT sum(n)::DOUBLE * 150 / 100 FROM sources) - coalesce(sum(2 * n) FILTER (2.0::DOUBLE * n <= w * level), 0)::DOUBLE)
    / nullif(sum(w) FILTER (2.0::DOUBLE * n > w * level), 0)::DOUBLE FROM sources)
  FROM levels WHERE k < 100 AND level IS NOT NULL),
top AS (SELECT max(level) AS level FROM levels),
rates AS (
  SELECT source, n, least((2 * n)::DOUBLE, w * level) AS target,
    CASE WHEN n > 0 THEN least((2 * n)::DOUBLE, w * level) / n ELSE 0 END AS rate
  FROM sources CROSS JOIN top),
parts AS (SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 4294967296)::BIGINT AS part FROM rates),
drawn AS (
  SELECT s.doc_id, s.source, size, n, target, whole, seed, whole + ((hash + seed * 2654435769) % 4294967296 < part)::BIGINT AS copies
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source CROSS JOIN (SELECT unnest(range(32)) AS seed)),
seeds AS (
  SELECT source, arg_min(seed, (away, seed)) AS seed
  FROM (SELECT source, seed, abs(sum(copies * size) - any_value(target)) AS away FROM drawn GROUP BY source, seed) GROUP BY source)
SELECT doc_id, size, n AS source_size, target, (copies * size)::BIGINT AS taken
FROM drawn JOIN seeds ON drawn.source IS NOT DISTINCT FROM seeds.source AND drawn.seed = seeds.seed
""")
def mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken so that sources come near their targets."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' tokens by byte-level BPE, and the bytes these stand for."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encoded(table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decoded(ids, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by a network learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    net = convnet.learned(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return convnet.scored(docs, net).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query("op6_warc", """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS hex FROM pages),
kept AS (SELECT p, max(page_id) AS last FROM payloads GROUP BY p)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM payloads JOIN kept USING (p)
""")
def web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to an archive and read back from it."""
    path = folder(spark, "archive")
    warc.written(table(spark, sf_dir, "pages"), path)
    found = settled(warc.read(spark, path).drop("payload"), "archived")
    return warc.resolved(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_ngram_jaccard", """
WITH RECURSIVE listed AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \\t-\\r]+'), lambda w: w <> '') AS ws
  FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM listed WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reached GROUP BY a) ON doc_id = a
""")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by their shingles' similarity."""
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query("op2_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' main texts."""
    return wrappers.extracted(table(spark, sf_dir, "pages"))


@query("op8_exact_top_k", """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored)
WHERE rank <= 10
""")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors with the highest products for every hundredth vector."""
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids written to files and read back from them."""
    path = folder(spark, "ids")
    idfiles.written(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 1)
    rows = idfiles.read(spark, path).select(
        "part", "seq", "at", "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))
    return idfiles.started(settled(rows, "starts")).select("doc_id", "start", "n_tokens", "ids_crc32")


MERKLE_LEVELS = 8  # of a language's tree in SQL, enough for 8 ** 8 rows; two over the languages
MERKLE_SQL = """
WITH RECURSIVE given AS (
  SELECT row_number() OVER () AS k, doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS front, text,
    coalesce((4294967295 - list_reduce(
      list_transform(range(8 * strlen(doc_id::VARCHAR)), lambda i: (ascii(substr(doc_id::VARCHAR, 1 + (i // 8)::INT, 1)) >> (i % 8)::INT) & 1),
      lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295)) % 3 = 0, false) AS hit
  FROM documents),
hashed AS (
  SELECT k, doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN hit THEN sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM given),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, coalesce(other, leaf) AS start FROM hashed),
n0 AS (SELECT lang, r, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
""" + "".join(f"""p{k} AS (SELECT lang, r // 8 AS r, string_agg(d, '' ORDER BY r) AS s FROM n{k - 1} WHERE n > 1 GROUP BY ALL),
n{k} AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT lang, r, sha256(s) AS d FROM p{k})),
""" for k in range(1, MERKLE_LEVELS + 1)) + "subs AS (SELECT lang, d FROM (" + " UNION ALL ".join(
    f"SELECT lang, d FROM n{k} WHERE n = 1" for k in range(MERKLE_LEVELS + 1)) + """)),
t0 AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, d, count(*) OVER () AS n FROM subs),
u1 AS (SELECT r // 8 AS r, string_agg(d, '' ORDER BY r) AS s FROM t0 WHERE n > 1 GROUP BY ALL),
t1 AS (SELECT r, sha256(s) AS d, count(*) OVER () AS n FROM u1),
u2 AS (SELECT r // 8 AS r, string_agg(d, '' ORDER BY r) AS s FROM t1 WHERE n > 1 GROUP BY ALL),
top AS (SELECT coalesce((SELECT sha256(s) FROM u2), (SELECT d FROM t1 WHERE n = 1), (SELECT d FROM t0 WHERE n = 1)) AS root),
f0 AS (SELECT l.k, l.doc_id, l.lang, leaf, l.r, t0.r AS t, t0.d AS subroot, start AS f, '' AS proof
  FROM leaves l JOIN t0 ON l.lang IS NOT DISTINCT FROM t0.lang),
""" + "".join(f"""f{j} AS (SELECT k, doc_id, f.lang, leaf, f.r, t, subroot,
  CASE WHEN s IS NULL THEN f ELSE sha256(substr(s, 1, 64 * ({at} % 8)) || f || substr(s, 64 * ({at} % 8) + 65)) END AS f,
  proof || CASE WHEN s IS NULL THEN '' ELSE substr(s, 1, 64 * ({at} % 8)) || substr(s, 64 * ({at} % 8) + 65) END AS proof
  FROM f{j - 1} f LEFT JOIN {table} p ON {on}),
""" for j, at, table, on in [
    *((k, f"(f.r // {8 ** (k - 1)})", f"p{k}", f"f.lang IS NOT DISTINCT FROM p.lang AND f.r // {8 ** k} = p.r") for k in range(1, MERKLE_LEVELS + 1)),
    (MERKLE_LEVELS + 1, "f.t", "u1", "f.t // 8 = p.r"), (MERKLE_LEVELS + 2, "(f.t // 8)", "u2", "f.t // 64 = p.r")]) + f"""
last AS (SELECT * FROM f{MERKLE_LEVELS + 2})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM last CROSS JOIN top
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' proofs under a manifest's root, with every third tampered with."""
    docs = table(spark, sf_dir, "documents")
    rows = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    made = merkle.manifest(docs.select(
        "doc_id", "lang", merkle.row_digest(*rows, F.col("text")).alias("digest"),
        F.when(hit, merkle.row_digest(*rows, lower)).alias("tampered")), "lang", ["doc_id"])
    root = F.lit(made.root.hex() if made.root is not None else None).cast("string")
    found = made.proofs().select(
        "doc_id", merkle.shown(F.col("digest")).alias("leaf"), merkle.shown(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.shown(merkle.folded(F.coalesce("tampered", "digest"), F.col("path"))).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def planted(docs: DataFrame) -> DataFrame:
    """The documents, every tenth with its words from some place on repeating."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    hit = (h % 10 == 0) & (F.size("_words") > 0)
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words(F.col("text"))).alias("_words"))
    rows = rows.withColumns({"_g": F.floor(h / 10), "_n": F.size("_words").cast("long")}).withColumn("_a", F.when(hit, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", 1 + F.expr("(_n - _a) div (3 + _g % 8)"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: F.get(
        "_words", F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    return rows.select("doc_id", F.when(hit, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' runs of repeated words, and what is left when each is said once."""
    found = periodic.detected(planted(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("_l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_suffix_dedup", """
WITH given AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
strings AS (SELECT k, i, md5(substr(x, (2 * i + 1)::INT, 800)) AS m FROM (SELECT k, x, unnest(range(strlen(x) // 2 - 399)) AS i FROM given)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY m) AS n FROM strings) WHERE n > 1),
opened AS (SELECT k, i, coalesce(i - lag(i) OVER (PARTITION BY k ORDER BY i) > 400, true) AS new FROM again),
numbered AS (SELECT k, i, sum(new::INT) OVER (PARTITION BY k ORDER BY i) AS s FROM opened),
spans AS (SELECT k, s, min(i) AS a, max(i) + 400 AS b FROM numbered GROUP BY k, s),
cut AS (
  SELECT k, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) || [999999999] AS froms, [0] || list(b ORDER BY a) AS tos
  FROM spans GROUP BY k)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(froms) + 1),
    lambda j: substr(x, (2 * tos[j] + 1)::INT, (2 * (froms[j] - tos[j]))::INT)), '') END)) AS kept_sha256
FROM given LEFT JOIN cut USING (k)
""")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of passages that come more than once."""
    found = suffixes.deduplicated(table(spark, sf_dir, "documents"), ["doc_id"])
    values = found.texts.select(
        *suffixes.KEY, "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return found.joined(settled(values, "kept")).drop(*suffixes.KEY)
