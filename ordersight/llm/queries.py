"""Queries over the shared tables, one per operator, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm import (chat, cotraining, decontaminate, fertility, line_chunks, mixing, pii, resampling, sharding,
                            simhash, token_files, toxicity, whitening)
from ordersight.llm.common import durable, table
from ordersight.session import written

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.balanced(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                        "copies", "rate")


def op5_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "byte_share", "entropy")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def op7_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def _crc(batches):
    for batch in batches:
        crc = np.array([zlib.crc32(ids) for ids in batch.column(3).to_pylist()], np.int64)
        yield pa.record_batch([*batch.columns[:3], pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return read.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_line_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_chunks.without_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.sharded(durable(rows))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_prefix_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: A conversation whose texts hold control strings of the template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(written(chat.formatted(given.unionByName(probe)), "chat"))


def op13_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.lit((model.values / model.trace).tolist() if len(model.values) else []).cast("array<double>")
    return rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_k", "whitened")).select(
        "vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_pivots, op2_toxicity_crf, op3_quality_cotraining, op4_entropy_balancing, op5_tokeniser_fertility,
    op6_pii_semi_markov, op7_prefix_filter_decontamination, op8_token_files, op9_line_chunks,
    op9_line_passages, op10_hypergeometric_shards, op11_prefix_crc_resampling, op12_incremental_chat,
    op13_refined_whitening)}

_DECONTAMINATION = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
item AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
gram AS MATERIALIZED (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, i, i + least(len(w), 10) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
place AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
hit AS MATERIALIZED (
  SELECT doc_id, i, size, item_id FROM (
    SELECT doc_id, i, s.size, list_slice(w, i, i + s.size - 1) AS g
    FROM place, (SELECT DISTINCT size FROM gram) s WHERE i + s.size - 1 <= len(w)) p
  JOIN gram USING (size, g)),
covered AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (
    SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(n.n, 0)::BIGINT AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

_LINE_CHUNKS = rf"""
WITH line AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i, len(l) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words FROM line),
ended AS (
  SELECT *, (h % {line_chunks.ALONE} <> 0 OR (coalesce(lag(h) OVER d, 0) * {line_chunks.FACTOR} + h) % {line_chunks.TOGETHER} = 0)
    AND line <> lead(line) OVER d OR i = n OR words > {line_chunks.PASSAGE_WORDS} OR lead(words) OVER d > {line_chunks.PASSAGE_WORDS} AS stops
  FROM hashed WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(stops::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ended),
chunk AS (
  SELECT doc_id, c, min(i) AS first, count(*) AS size, sum(words) AS words, list(line ORDER BY i) AS lines,
    list(words ORDER BY i) AS each FROM numbered GROUP BY doc_id, c),
sided AS (
  SELECT *, CASE WHEN (lag(each) OVER d)[1] <= {line_chunks.PASSAGE_WORDS} THEN list_reverse(lag(lines) OVER d) ELSE [] END AS before,
    CASE WHEN (lag(each) OVER d)[1] <= {line_chunks.PASSAGE_WORDS} THEN list_reverse(lag(each) OVER d) ELSE [] END AS before_words,
    CASE WHEN (lead(each) OVER d)[1] <= {line_chunks.PASSAGE_WORDS} THEN lead(lines) OVER d ELSE [] END AS behind,
    CASE WHEN (lead(each) OVER d)[1] <= {line_chunks.PASSAGE_WORDS} THEN lead(each) OVER d ELSE [] END AS behind_words
  FROM chunk WINDOW d AS (PARTITION BY doc_id ORDER BY c)),
anchor AS (
  SELECT *, row_number() OVER o AS no, first_value(doc_id) OVER o AS origin, first - first_value(first) OVER o AS shift,
    first_value(before) OVER o AS origin_before, first_value(behind) OVER o AS origin_behind
  FROM sided WHERE size > 1 OR words >= {line_chunks.ANCHOR_WORDS}
  WINDOW o AS (PARTITION BY lines ORDER BY doc_id, c)),
extended AS (
  SELECT *, len(list_filter(range(1, least(len(before), len(origin_before)) + 1), lambda k: before[1:k] = origin_before[1:k])) AS up,
    len(list_filter(range(1, least(len(behind), len(origin_behind)) + 1), lambda k: behind[1:k] = origin_behind[1:k])) AS down
  FROM anchor WHERE no > 1),
met AS (
  SELECT DISTINCT doc_id, origin, shift, unnest(range(first - up, first + size + down)) AS i FROM extended),
run AS (
  SELECT m.*, words, m.i - row_number() OVER (PARTITION BY m.doc_id, origin, shift ORDER BY m.i) AS run
  FROM met m JOIN numbered n ON n.doc_id = m.doc_id AND n.i = m.i),
judged AS (
  SELECT doc_id, i, sum(words) OVER (PARTITION BY doc_id, origin, shift, run) AS total FROM run),
gone AS (
  SELECT doc_id, i FROM judged WHERE total > {line_chunks.PASSAGE_WORDS}
  UNION SELECT doc_id, unnest(range(first, first + size)) FROM extended WHERE size > 1)
SELECT n.doc_id, count(*)::BIGINT AS n_lines, count(DISTINCT c)::BIGINT AS n_chunks, count(g.i)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
"""

ORACLES = {"op7_prefix_filter_decontamination": _DECONTAMINATION, "op9_line_chunks": _LINE_CHUNKS}
