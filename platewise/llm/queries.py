"""One query for each training-data operator: the operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, common, decontaminate, merkle, neardup, passages, quality, secrets, sentencepieces, sharding, syncmers, tokenfiles
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_documents(table(spark, sf_dir, "documents"), 16))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.train(docs, labels, where=~held_out)
    return quality.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_conversations(turns))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = vocabulary("byte_bpe_50k.json")
    out = f"{common.shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    tokenfiles.write(table(spark, sf_dir, "documents"), out, path, end_id=2)
    return tokenfiles.read(spark, out)


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("lang")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = vocabulary("piece_bpe_32k.model")
    return sentencepieces.digest(sentencepieces.encode(table(spark, sf_dir, "documents"), path), path)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")[0], vocabulary("piece_bpe_32k.model")[0])


QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_secrets": op3_secrets,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_passages": op6_passages,
    "op7_chat": op7_chat,
    "op8_token_files": op8_token_files,
    "op9_syncmers": op9_syncmers,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_alignment": op13_alignment,
}

MERKLE_SQL = """
WITH RECURSIVE
steps AS (
  SELECT list(v ORDER BY n) AS crc FROM (
    SELECT n, list_reduce(list_concat([n], range(8)),
                          lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM range(256) AS bytes(n))
),
marked AS (
  SELECT doc_id, source, lang, n_chars, text, COALESCE(xor(4294967295, list_reduce(
           list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
           lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]))) % 3 = 0, FALSE) AS bad
  FROM documents, steps
),
versions AS (
  SELECT lang, doc_id, bad, COALESCE(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || COALESCE(strlen(source) || ':' || source, '-')
         || COALESCE(strlen(lang) || ':' || lang, '-') || COALESCE(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         COALESCE(strlen(text) || ':' || text, '-') AS body,
         COALESCE(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS lowered
  FROM marked
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER () AS id
  FROM (SELECT lang, doc_id, sha256(head || body) AS leaf, sha256(head || IF(bad, lowered, body)) AS changed FROM versions)
),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, COUNT(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 8, n
),
tops AS (
  SELECT 0 AS level, tree AS pos, hash, COUNT(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n
),
climb AS (
  SELECT id, tree, 0 AS level, pos, changed AS fold, '' AS sibs FROM leaves
  UNION ALL
  SELECT c.id, c.tree, c.level + 1, c.pos // 8, sha256(string_agg(IF(m.pos = c.pos, c.fold, m.hash), '' ORDER BY m.pos)),
         c.sibs || string_agg(IF(m.pos = c.pos, '', m.hash), '' ORDER BY m.pos)
  FROM climb c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.pos // 8 = c.pos // 8 AND m.n > 1
  GROUP BY c.id, c.tree, c.level, c.pos, c.fold, c.sibs
),
higher AS (
  SELECT c.id, 0 AS level, c.tree AS pos, c.fold, c.sibs
  FROM climb c JOIN nodes m ON m.tree = c.tree AND m.level = c.level AND m.pos = c.pos AND m.n = 1
  UNION ALL
  SELECT c.id, c.level + 1, c.pos // 8, sha256(string_agg(IF(m.pos = c.pos, c.fold, m.hash), '' ORDER BY m.pos)),
         c.sibs || string_agg(IF(m.pos = c.pos, '', m.hash), '' ORDER BY m.pos)
  FROM higher c JOIN tops m ON m.level = c.level AND m.pos // 8 = c.pos // 8 AND m.n > 1
  GROUP BY c.id, c.level, c.pos, c.fold, c.sibs
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, t.hash AS root, sha256(h.sibs) AS proof_sha256, h.fold AS folded_root, h.fold = t.hash AS verified
FROM leaves l JOIN nodes s ON s.tree = l.tree AND s.n = 1 JOIN tops t ON t.n = 1
JOIN higher h ON h.id = l.id AND h.level = t.level"""

#: DuckDB SQL where SQL can express the operator.
ORACLE: dict[str, str] = {"op11_merkle": MERKLE_SQL}
