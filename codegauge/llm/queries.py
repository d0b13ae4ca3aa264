"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.llm import compression, conversations, covertree, decontaminate, licenses, lm, neardup, periodicity, quality, sampling, sharding, substrings, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).drop("text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def license_digest(found: DataFrame) -> DataFrame:
    base, own = "transform(phrases, m -> m.label)", "transform(templates, m -> m.label)"
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.expr("array_min(transform(phrases, m -> m.start))").alias("first_word"),
        F.expr("array_max(transform(phrases, m -> m.start))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct({base})), ',')").alias("base_labels"),
        F.expr(f"array_join(array_sort(array_union({base}, {own})), ',')").alias("labels"),
        F.expr("CASE WHEN size(templates) > 0 THEN 1D WHEN size(phrases) > 0 THEN 0.5D ELSE 0D END").alias("score"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (compression.fold("doc_id") == 0).alias("held_out"), "score", quality.predicted().alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_digest(decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def overlap_digest(found: DataFrame) -> DataFrame:
    items = F.expr("array_sort(array_distinct(flatten(transform(matches, m -> m.item_ids))))")
    return found.select("doc_id", "n_words", decontaminate.covered_words().alias("n_hit"), items.alias("items")) \
        .select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op9_sampled_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.sample_segmentations(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "rank", F.size("ids").cast("long").alias("n_tokens"), "log_prob", "log_inclusion",
                        F.xxhash64("ids").alias("ids_hash"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", (compression.fold("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_digest(periodicity.find_runs(plant_periods(_table(spark, sf_dir, "documents"))))


def plant_periods(docs: DataFrame) -> DataFrame:
    """Documents whose number's checksum ends in 0 get a periodic tail, as op11's contract fixes it."""
    return docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"),
                       F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w")) \
        .withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w").cast("long")) \
        .withColumn("a", F.expr("CAST(g % greatest(n, 1) AS INT)")).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)")) \
        .select("doc_id", F.expr("""CASE WHEN h % 10 = 0 AND n > 0 THEN array_join(concat(slice(w, 1, a),
            slice(flatten(array_repeat(slice(w, a + 1, p), CAST((n - a + p - 1) div p AS INT))), 1, CAST(n - a AS INT))), ' ')
            ELSE text END""").alias("text"))


def periods_digest(found: DataFrame) -> DataFrame:
    best = "array_min(transform(runs, r -> named_struct('l', -r.length, 's', r.start, 'p', r.period)))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.withColumn("best", F.expr(best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("best.s").alias("start"), F.expr("-best.l").alias("length"),
        F.expr("best.p").alias("period"), F.expr("-best.l * 1000 div best.p").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def removal_digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", F.expr("aggregate(removed, 0L, (n, r) -> n + r.end - r.begin)").alias("n_removed"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return repair_digest(turns.select("conv_id"), conversations.repair(damage_turns(turns)))


def damage_turns(turns: DataFrame) -> DataFrame:
    """Faults by the checksum of conversation and turn, as op12's contract fixes them."""
    spaced = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                          F.expr("crc32(concat(coalesce(CAST(conv_id AS STRING), ' '), ':', coalesce(CAST(turn AS STRING), ' '))) % 20").alias("k"))
    return spaced.where("k <> 0").select(
        "conv_id", "turn", F.expr("CASE WHEN k = 4 THEN 'user' ELSE role END").alias("role"),
        F.expr("CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("CASE WHEN k = 3 THEN array(0, 1) ELSE array(0) END")).alias("n")).drop("n")


def repair_digest(ids: DataFrame, found: conversations.Repair) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One hash per conversation from its sorted chunks; of a long one only the chunk at hand is in memory."""
        begun, owner, sha, lead = False, None, None, b""
        for batch in batches:
            ids_out, out = [], []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != owner:
                    if begun:
                        ids_out.append(owner)
                        out.append(sha.hexdigest())
                    begun, owner, sha, lead = True, row["conv_id"], hashlib.sha256(), b""
                for role, text in zip(row["roles"], row["texts"]):
                    sha.update(lead + f"{role}:{text}".encode())
                    lead = b"\n"
            id_type = batch.schema.field("conv_id").type
            yield pa.record_batch([pa.array(ids_out, id_type), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.record_batch([pa.array([owner], id_type), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    whole = found.turns.where("whole").select("conv_id", F.sha2(F.expr(
        "array_join(transform(arrays_zip(roles, texts), t -> concat(t.roles, ':', t.texts)), '\n')"), 256).alias("repaired_sha256"))
    split = found.turns.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "chunk") \
        .select("conv_id", "roles", "texts").mapInArrow(digest, whole.schema)
    hashes = whole.unionByName(split)
    owners = ids.distinct().select(F.col("conv_id").alias("id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return owners.join(found.summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id") \
        .join(hashes, F.col("id").eqNullSafe(F.col("conv_id")), "left") \
        .select(F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_hash_shards": op3_hash_shards,
    "op4_license_scan": op4_license_scan,
    "op5_token_counts": op5_token_counts,
    "op6_quality": op6_quality,
    "op7_decontaminate": op7_decontaminate,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_sampled_segmentations": op9_sampled_segmentations,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_substring_dedup": op13_substring_dedup,
}
