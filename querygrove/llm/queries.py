"""Registered queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querygrove.llm import (
    ball_kmeans, byte_bpe, chat_format, decontaminate, importance, language_id, line_dedup, lm_scoring, minhash, quality_classifier, quality_rules, suffix_dedup,
    url_filter,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.strip_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("own.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = language_id.held_out("doc_id", 3, 1)
    model = quality_classifier.fit(docs, labels.filter(~held))
    rows = quality_classifier.score(docs, model)
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_attention")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recovered stretch of a turn; ``true_role`` is what the table says of the chunk."""
    chunks = chat_format.as_transcripts(table(spark, sf_dir, "conversations")).withColumnRenamed("role", "true_role")
    return chat_format.parse_transcripts(chunks, ("true_role",))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), vocabulary, decoded="decoded"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.fit(docs))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), url_filter.labelled_table(spark))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out("doc_id", 5, 0)
    rows = language_id.predict(docs, language_id.fit(docs.filter(~held)))
    return rows.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select(F.col("own.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.size(F.coalesce("words", F.array())).alias("n_bitmap_words"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.coded(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup, "op2_decontamination": op2_decontamination, "op3_quality_classifier": op3_quality_classifier, "op4_chat_format": op4_chat_format, "op5_byte_bpe": op5_byte_bpe, "op6_lm_scoring": op6_lm_scoring, "op7_minhash": op7_minhash, "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules, "op10_language_id": op10_language_id, "op11_line_dedup": op11_line_dedup,
    "op12_importance_resampling": op12_importance_resampling, "op13_ball_kmeans": op13_ball_kmeans, "pipeline": corpus_pipeline.run,
}
#: A text as the hexadecimal digits of its bytes; strings of 200 bytes by digest; covered runs; what lies between them.
OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 199 AS BIGINT))) AS i FROM d WHERE length(h) >= 400),
g AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM p),
c AS (SELECT doc_id, i FROM g WHERE k IN (SELECT k FROM g GROUP BY k HAVING count(*) > 1)),
m AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
s AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM r GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS a, lo AS b FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
  UNION ALL SELECT d.doc_id, coalesce(max(hi), 0), any_value(length(h) // 2) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

#: Shingle sets, links by counting shared shingles, and the reach of every document over links.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sh), n AS MATERIALIZED (SELECT doc_id, len(s) AS size FROM sh),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.size + ny.size - c)),
links AS MATERIALIZED (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reach JOIN n USING (doc_id) GROUP BY doc_id"""

#: Lines with their keys, the keys that enough documents hold, and what is left of every text.
OP11_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
  CAST(count(DISTINCT (i - 1) // 64) FILTER (gone) AS INT) AS n_bitmap_words
FROM m GROUP BY doc_id"""

#: The crc32 of distinct words by folding their bytes, gains of buckets, and a plain sort.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS c, 0 AS step FROM range(256)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
dw AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
bw AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
ws AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bk AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(w))), lambda j: ('0x' || substring(hex(encode(w)), 2 * j + 1, 2))::BIGINT)),
    lambda a, b: xor(t[xor(a & 255, b) + 1], a >> 8)), 4294967295) % 10000 AS b FROM ws, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN bk USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN bk USING (w) GROUP BY b),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
g AS (
  SELECT s.b, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * (s_all + 10000) / ((s.n::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (b), n),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN bk USING (w) JOIN g USING (b) GROUP BY doc_id),
sc AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substring(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able FROM sc WHERE n_features >= 20)
SELECT sc.*, CASE WHEN rank <= 10 * able // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)"""


def op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All distances of every round; ``m`` puts the lower index first among equal ones."""
    ctes = [
        """c AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM c, range({parts}) AS r(part))""",
        f"""b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS e, v
  FROM p WHERE vec_id IN (SELECT vec_id FROM c ORDER BY vec_id LIMIT {entries}))""",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.v,
  min(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT * {entries} + e) AS m
  FROM p JOIN b{r} b USING (part) GROUP BY ALL)""")
        if r < rounds:
            ctes.append(f"""s{r} AS (SELECT part, m % {entries} AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, (SELECT any_value(len(v)) FROM p) + 1) AS r(i) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(any_value(u.v), any_value(b.v)) AS v FROM b{r} b
  LEFT JOIN (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY part, e) u USING (part, e) GROUP BY part, e)""")
    return f"""WITH {", ".join(ctes)},
k AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k, h"""


ORACLES: dict[str, str] = {
    "op1_suffix_dedup": OP1_SQL, "op7_minhash": OP7_SQL, "op11_line_dedup": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_ball_kmeans": op13_sql(),
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
