"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refloom.llm import byte_bpe, decontaminate, exact_dedup, fingerprint, importance, lz_dedup, ppm_language, secret_scan, sharding, simhash, suffix_dedup, whitening, zstd_quality
from refloom.llm.common import held_out, table, tidied


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS long) AS n_{k}") for k in ("assign", "access", "hex")]
    more = F.expr("cast(size(filter(found, x -> x.kind = 'random')) AS long) AS n_random")
    return found.select("doc_id", *counts, F.sha2(F.expr(secret_scan.listed("base")), 256).alias("base_sha256"), F.expr(secret_scan.listed("found")).alias("spans"), more)


def op2_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = zstd_quality.score(docs, zstd_quality.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = ppm_language.identify(docs, ppm_language.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, offsets=False, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_edits(table(spark, sf_dir, "documents"))
    sketches = [fingerprint.shown(F.col("sketch")).alias("fingerprint"), fingerprint.shown(F.col("edited_sketch")).alias("edited_fingerprint")]
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *sketches, "near_edited", "near_next", "n_shingles", "kept_share")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: tidied(q)
    for q in (op1_secret_scan, op2_lz_dedup, op3_suffix_dedup, op4_zstd_quality, op6_ppm_language, op5_byte_bpe, op7_sharding, op8_fingerprint, op9_simhash, op10_decontaminate, op11_importance, op12_exact_dedup, op13_whitening)
}
SECRETS_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT doc_id, 0 AS kind_no, 'assign' AS kind, string_split_regex(t, '{assign}') AS gaps, regexp_extract_all(t, '{assign}') AS vals FROM t
  UNION ALL SELECT doc_id, 1, 'access', string_split_regex(t, '{access}'), regexp_extract_all(t, '{access}') FROM t
  UNION ALL SELECT doc_id, 2, 'hex', string_split_regex(t, '{hex}'), regexp_extract_all(t, '{hex}') FROM t
  UNION ALL SELECT doc_id, 3, 'random', string_split_regex(t, '{random}'), regexp_extract_all(t, '{random}') FROM t),
flat AS (SELECT doc_id, kind_no, kind, unnest(gaps[:len(vals)]) AS gap, unnest(vals) AS v, generate_subscripts(vals, 1) AS i FROM found WHERE len(vals) > 0),
placed AS (SELECT doc_id, kind_no, kind, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS BIGINT) AS e FROM flat),
spans AS (SELECT doc_id, kind_no, kind, v, e - length(v) AS s, e FROM placed WHERE CASE kind_no WHEN 0 THEN length(regexp_extract(v, '{assign}', 1)) >= 6 WHEN 1 THEN length(v) >= 20 ELSE true END),
base AS (SELECT * FROM spans WHERE kind_no < 3),
fresh AS (SELECT c.*, row_number() OVER () AS c, length(v) AS n, CASE WHEN regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') THEN 16 WHEN regexp_full_match(v, '[A-Z2-7]+') THEN 32 WHEN regexp_full_match(v, '[0-9a-z]+|[0-9A-Z]+') THEN 36
    WHEN regexp_full_match(v, '[0-9A-Za-z]+') THEN 62 ELSE 64 END AS k
  FROM spans c WHERE kind_no = 3 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
symbols AS (SELECT c, k, unnest(range(1, n + 1)) AS i, unnest(string_split(v, '')) AS ch FROM fresh),
numbered AS (SELECT c, i, ch, CAST(CASE k WHEN 16 THEN instr('0123456789abcdef', lower(ch)) - 1 WHEN 32 THEN instr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ch) - 1 WHEN 36 THEN instr('0123456789abcdefghijklmnopqrstuvwxyz', lower(ch)) - 1
  ELSE least(instr('0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_', ch) - 1, 63) END AS DOUBLE) AS x,
  CASE WHEN ch BETWEEN '0' AND '9' THEN 0 WHEN ch BETWEEN 'a' AND 'z' THEN 1 WHEN ch BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END AS kind FROM symbols),
stepped AS (SELECT *, lag(kind) OVER w AS before, lag(x) OVER w AS last, avg(x) OVER (PARTITION BY c) AS mean FROM numbered WINDOW w AS (PARTITION BY c ORDER BY i)),
equal AS (SELECT c, sum(m * (m - 1) / 2) AS pairs FROM (SELECT c, ch, CAST(count(*) AS DOUBLE) AS m FROM symbols GROUP BY 1, 2) GROUP BY 1),
walked AS (SELECT c, CAST(count_if(kind <> before) AS DOUBLE) AS changes, sum(pow(x - mean, 2)) AS spread, sum((x - mean) * (last - mean)) AS serial FROM stepped GROUP BY c),
own AS (SELECT fresh.*, pairs, changes, spread, serial, CASE k WHEN 16 THEN {hex_pairs} ELSE {equal_pairs} END AS q, CASE k WHEN 16 THEN {hex_triples} ELSE {equal_triples} END AS t,
  {ordinary} * CASE k {changes} END AS p, n * (n - 1.0) / 2 AS m2, n * (n - 1.0) * (n - 2.0) AS m3 FROM fresh JOIN equal USING (c) JOIN walked USING (c)),
scored AS (SELECT *, ((m2 * q - pairs) / sqrt(m2 * (q - q * q) + m3 * (t - q * q)) + (changes - (n - 1) * p) / sqrt((n - 1) * p * (1 - p))
  + CASE WHEN spread <= 0 THEN {serial} - 1 ELSE {serial} - abs(serial / spread) END * sqrt(n)) / sqrt(3.0) AS z, least(2.0, greatest(0.5, n / 40.0)) AS weight FROM own),
tails AS (SELECT *, exp(-pow(least(abs(z), 37), 2) / 2) / (2.5066282746 * (0.661 * least(abs(z), 37) + 0.339 * sqrt(pow(least(abs(z), 37), 2) + 5.51))) AS far FROM scored),
steps AS (SELECT *, CAST(greatest(0, least({last_step}, floor({steps} * (ln(weight) - CASE WHEN z >= 0 THEN ln(far) ELSE ln(1 - far) END)))) AS INTEGER) AS step FROM tails),
line AS (SELECT min(step) AS line FROM (SELECT step, count(*) OVER (ORDER BY step DESC) AS at_least, sum(weight) OVER () AS total FROM steps) WHERE exp(-step / CAST({steps} AS DOUBLE)) * total <= {rate} * at_least),
random AS (SELECT doc_id, kind_no, kind, v, s, e FROM steps WHERE step >= (SELECT line FROM line)),
per AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS a,
  count_if(kind_no = 0) AS n0, count_if(kind_no = 1) AS n1, count_if(kind_no = 2) AS n2, count_if(kind_no = 3) AS n3 FROM (SELECT * FROM base UNION ALL SELECT * FROM random) GROUP BY 1)
SELECT doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access, CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, CAST(coalesce(n3, 0) AS BIGINT) AS n_random
FROM documents LEFT JOIN per USING (doc_id)
"""

FACTORS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h FROM w WHERE len(w) >= 50),
first AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, k + j AS i FROM h JOIN first USING (h), range(0, 50) AS r(j) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

#: Thirteen tokens of which eleven agree have four in a row that do, so runs of four find every alignment that counts; shorter items are aligned at each
#: token.
LEAKS_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS d FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS b FROM benchmark WHERE text IS NOT NULL),
short AS (SELECT DISTINCT unnest(b) AS w FROM b WHERE len(b) < 13),
dg AS (SELECT doc_id, unnest(range(1, len(d) - 2)) AS i, unnest(list_transform(range(1, len(d) - 2), lambda i: array_to_string(d[i:i + 3], ' '))) AS g FROM d WHERE len(d) >= 4
  UNION ALL SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(1, len(d) + 1)) AS i, unnest(d) AS w FROM d WHERE (SELECT count(*) FROM short) > 0) JOIN short USING (w)),
bg AS (SELECT item_id, unnest(range(1, len(b) - 2)) AS j, unnest(list_transform(range(1, len(b) - 2), lambda i: array_to_string(b[i:i + 3], ' '))) AS g FROM b WHERE len(b) >= 13
  UNION ALL SELECT item_id, unnest(range(1, len(b) + 1)), unnest(b) FROM b WHERE len(b) < 13),
aligned AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM dg JOIN bg USING (g)),
e AS (SELECT doc_id, item_id, list_transform(range(1, len(b) + 1), lambda k: CASE WHEN k + shift >= 1 AND d[k + shift] = b[k] THEN 1 ELSE 0 END) AS e FROM aligned JOIN d USING (doc_id) JOIN b USING (item_id)),
judged AS (SELECT doc_id, item_id, len(e) AS n, list_sum(e) AS total, list_max(list_transform(range(1, len(e) - least(13, len(e)) + 2), lambda s: list_sum(e[s:s + least(13, len(e)) - 1]))) AS best FROM e)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_tokens, CAST(max(total) AS BIGINT) AS n_equal, CAST(max(total) AS DOUBLE) / max(n) AS share FROM judged WHERE best * 5 >= least(13, n) * 4 GROUP BY 1, 2
"""

#: crc32 goes over the bytes of each distinct word with a table that is made from its polynomial.
IMPORTANCE_SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) AS r(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM d) GROUP BY 1, 2),
words AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, n AS s, 0 AS t FROM f UNION ALL SELECT unnest(w), 0, 1 FROM b) GROUP BY 1),
hexed AS (SELECT f, s, t, hex(encode(f)) AS x FROM words),
bytes AS (SELECT f, s, t, list_transform(range(1, length(x), 2), lambda k: CAST((instr('0123456789ABCDEF', x[k]) - 1) * 16 + instr('0123456789ABCDEF', x[k + 1]) - 1 AS BIGINT)) AS bytes FROM hexed),
hashed AS (SELECT f, s, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, y: xor(c // 256, crc[(xor(c, y) % 256) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT doc_id, sum(gain * n) AS total, sum(n) AS n FROM f JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY 1),
rows AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, 9), lambda k: CAST(instr('0123456789abcdef', sha256('2024:' || doc_id)[k]) - 1 AS BIGINT))), lambda h, x: h * 16 + x) AS h FROM d LEFT JOIN weights USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM rows),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, CAST(score AS BIGINT) AS score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranked) THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM t
"""


def _secrets_sql() -> str:
    scan = secret_scan
    values = {"assign": scan.ASSIGN, "access": scan.ACCESS, "hex": scan.HEX, "random": scan.CANDIDATE, "hex_pairs": scan.HEX_PAIRS, "equal_pairs": scan.EQUAL_PAIRS, "hex_triples": scan.HEX_TRIPLES, "equal_triples": scan.EQUAL_TRIPLES}
    values |= {"ordinary": scan.ORDINARY_CHANGES, "serial": scan.SERIAL, "last_step": scan.LAST_STEP, "steps": scan.STEPS, "rate": scan.FALSE_DISCOVERY, "changes": " ".join(f"WHEN {k} THEN {v}" for k, v in scan.CHANGES.items())}
    sql = SECRETS_SQL
    for name, value in values.items():
        sql = sql.replace("{" + name + "}", str(value).replace("'", "''"))
    return sql


ORACLE_SQL: dict[str, str] = {"op1_secret_scan": _secrets_sql(), "op2_lz_dedup": FACTORS_SQL, "op10_decontaminate": LEAKS_SQL, "op11_importance": IMPORTANCE_SQL, "op12_exact_dedup": EXACT_SQL}
