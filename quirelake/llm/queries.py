"""The queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import documents
from quirelake.llm.compaction import sharded
from quirelake.llm.filter_audit import audit
from quirelake.llm.hilbert_search import nearest
from quirelake.llm.html_text import main_texts
from quirelake.llm.kneser_ney import toxicity
from quirelake.llm.mixing import taken
from quirelake.llm.ngram_join import link_components
from quirelake.llm.packing import pack
from quirelake.llm.parsing import with_edits
from quirelake.llm.pii import KINDS, find_pii, written_spans
from quirelake.llm.secret_index import RULES, find_secrets
from quirelake.llm.time_partitions import rewritten_by_time, shifted_moment
from quirelake.llm.token_files import token_file_digest


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def _is(kind: str):
    return lambda x: x == kind


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir)).withColumn("own", F.filter("pii", lambda s: s["base"]))
    numbers = [F.size(F.filter(F.transform("own", lambda s: s["kind"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *numbers, F.sha2(written_spans(F.col("own")), 256).alias("base_sha256"), written_spans(F.col("pii")).alias("spans"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.aggregate("takings", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    return taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", words.alias("taken"), F.transform("takings", lambda t: t["shard"]).alias("shards"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir)).withColumn("own", F.filter("secrets", lambda s: s["base"]))
    numbers = [F.size(F.filter(F.transform("own", lambda s: s["kind"]), _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in RULES if r.base]
    return found.select("doc_id", *numbers, F.sha2(written_spans(F.col("own")), 256).alias("base_sha256"), written_spans(F.col("secrets")).alias("spans"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("text_chars"), "shard_no", "shard_rows", "version")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    earlier = F.col("arrived_at") < F.lit("2024-04-01 00:00:00").cast("timestamp_ntz")
    return rewritten_by_time(clicks, shifted_moment(F.col("ts"), F.col("click_id")), ("arrived_at", "click_id"), "click_id", earlier)


QUERIES = {"op1_token_files": op1_token_files, "op2_pii": op2_pii, "op3_fingerprints": op3_fingerprints, "op4_mixing": op4_mixing, "op5_nearest": op5_nearest, "op6_secrets": op6_secrets, "op7_shards": op7_shards, "op8_packing": op8_packing, "op9_toxicity": op9_toxicity, "op10_ngram_join": op10_ngram_join, "op11_filter_audit": op11_filter_audit, "op12_html_text": op12_html_text, "op13_time_partitions": op13_time_partitions}
OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS k FROM s
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.k = b.k AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.sh)
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(q.e, lambda x, i: x * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END,
      CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 'C' ELSE '' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, left(filter_order, step - 1) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT contains(fails, own) AND (earlier = '' OR NOT regexp_matches(fails, '[' || earlier || '_]')) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]') THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, own) AND regexp_matches(fails, '[' || earlier || '_]') THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]') THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, own) AND NOT regexp_matches(fails, '[' || earlier || '_]') THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op5_nearest": OP5_SQL, "op10_ngram_join": OP10_SQL, "op11_filter_audit": OP11_SQL}
