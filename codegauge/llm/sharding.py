"""Byte-bounded shards by extendible hashing, with DataFrame functions only.

Every row has a 60-bit hash of its key. The directory is a binary trie over hash prefixes: it starts with one bucket, and only a
bucket above the byte limit splits on its next bit. A bucket splits if it is too large and holds two different hashes; as the same
then holds for all prefixes above it, the depth of a row's bucket is one more than its deepest such prefix. That is worked out
from pre-aggregated cells: rows are summed by their first hash bits (some dozens of cells for every shard), the cells are rolled
up to all their prefixes, and only rows in cells that still split take part in the next round, with more bits. The rows meet the
directory once, in an equality join on their cell.

Rows with the same hash cannot be parted by bits. Where they exceed the limit together they fill overflow pages of their bucket:
running sums of half a limit, dealt within salted sub-groups of about PAGE_ROWS rows, so a key with a large part of all rows is no
single task. A row above the limit has a page of its own, marked `oversize`; no other page exceeds the limit.

Defined results: a null key hashes as an empty text, a null text has 0 bytes; repeated rows share a hash and get pages as said;
rows keep all their columns, to which `bytes`, `shard` (the prefix bits), `depth`, `page`, `shard_bytes`, `shard_rows` and
`oversize` are added, each under `prefix` + its name, which must be free (a clash is an error that names the column); a row travels as
one struct, so no other column name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from codegauge.session import scratch_path

HASH_BITS = 60
LIMIT_BYTES = 2_000_000
#: The first round has about 2 ** FINE_BITS cells for every shard.
FINE_BITS = 5
#: Rows that number their overflow pages together.
PAGE_ROWS = 10_000
ADDED = ["bytes", "shard", "depth", "page", "shard_bytes", "shard_rows", "oversize"]


def _hash(key: str) -> F.Column:
    """The first 60 bits of the md5 of a key, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _first(bits: int) -> F.Column:
    return F.shiftright("__h", HASH_BITS - bits)


def directory(rows: DataFrame, limit: int, fine_bits: int = FINE_BITS) -> tuple[int, DataFrame]:
    """Bits of the first round, and for each of its cells the buckets in it: (cell, leaves of (prefix, depth, bytes, n)).

    `rows` has the hash `__h` and `__bytes`.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("__bytes")).first()[0] or 0
    first = bits = min(HASH_BITS, int(total // limit).bit_length() + fine_bits)
    least, todo, parts = 0, rows, []
    while True:
        path = scratch_path(spark, "cells")
        todo.groupBy(_first(bits).alias("cell")).agg(
            F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi")) \
            .write.parquet(path)
        cells = spark.read.parquet(path)
        up = cells.withColumn("d", F.explode(F.sequence(F.lit(least), F.lit(bits)))).withColumn("prefix", F.expr(f"shiftright(cell, {bits} - d)"))
        splits = up.groupBy("d", "prefix").agg(F.sum("bytes").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")) \
            .where((F.col("b") > limit) & (F.col("lo") < F.col("hi"))).select("d", "prefix")
        deepest = up.select("d", "prefix", "cell").join(splits, ["d", "prefix"]).groupBy("cell").agg(F.max("d").alias("deepest"))
        placed = cells.join(deepest, "cell", "left").withColumn("depth", F.coalesce(F.col("deepest") + 1, F.lit(least)))
        parts.append(placed.where(F.col("depth") <= bits).select(
            F.shiftright("cell", bits - first).alias("cell"), F.expr(f"shiftright(cell, {bits} - depth)").alias("prefix"), "depth", "bytes", "n"))
        larger = placed.where(F.col("depth") > bits).select(F.col("cell").alias("__cell"))
        if larger.isEmpty():
            break
        todo = todo.withColumn("__cell", _first(bits)).join(larger, "__cell", "left_semi").drop("__cell")
        least, bits = bits, min(HASH_BITS, bits + 2 * fine_bits)
    found = reduce(DataFrame.union, parts)
    whole = found.groupBy("prefix", "depth").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    leaves = found.select("cell", "prefix", "depth").join(whole, ["prefix", "depth"])
    return first, leaves.groupBy("cell").agg(F.collect_set(F.struct("prefix", "depth", "bytes", "n")).alias("leaves"))


def shard(docs: DataFrame, key: str = "doc_id", text_col: str = "text", limit: int = LIMIT_BYTES, prefix: str = "",
          fine_bits: int = FINE_BITS) -> DataFrame:
    """The rows with the shard and page they belong to."""
    taken = [prefix + c for c in ADDED if prefix + c in docs.columns]
    if taken:
        raise ValueError(f"columns exist already: {taken}")
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.struct("*").alias("__row"), _hash(key).alias("__h"), size.alias("__bytes"))
    bits, cells = directory(rows.select("__h", "__bytes"), limit, fine_bits)
    path = scratch_path(docs.sparkSession, "directory")
    cells.write.parquet(path)
    cells = docs.sparkSession.read.parquet(path)
    leaf = F.expr(f"filter(leaves, l -> shiftright(__h, {HASH_BITS} - l.depth) = l.prefix)[0]")
    placed = rows.withColumns({"__cell": _first(bits), "__salt": F.rand(7)}).join(cells.withColumnRenamed("cell", "__cell"), "__cell") \
        .withColumn("__leaf", leaf).drop("leaves", "__cell")
    over = (F.col("__leaf.bytes") > limit) & (F.col("__leaf.n") > 1)
    parts = [placed.where(~over).withColumn("__page", F.lit("0"))]
    if not cells.where(F.exists("leaves", lambda x: (x["bytes"] > limit) & (x["n"] > 1))).isEmpty():
        group = F.floor(F.col("__salt") * F.ceil(F.col("__leaf.n") / PAGE_ROWS))
        alone = F.col("__bytes") * 2 > limit
        window = Window.partitionBy("__h", "__group", "__alone")
        order = window.orderBy("__bytes")
        number = F.when(F.col("__alone"), F.row_number().over(order)).otherwise(
            F.floor(F.sum("__bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) * 2 / limit))
        parts.append(placed.where(over).withColumns({"__group": group, "__alone": alone})
                     .withColumn("__page", F.concat_ws(".", "__group", F.col("__alone").cast("int"), number))
                     .drop("__group", "__alone"))
    named = {"bytes": F.col("__bytes"), "shard": F.expr(f"lpad(bin(shiftright(__h, {HASH_BITS} - __leaf.depth)), __leaf.depth, '0')"),
             "depth": F.col("__leaf.depth").cast("long"), "page": F.col("__page"), "shard_bytes": F.col("__leaf.bytes"),
             "shard_rows": F.col("__leaf.n"), "oversize": F.col("__bytes") > limit}
    return reduce(DataFrame.union, parts).select("__row.*", *(c.alias(prefix + n) for n, c in named.items()))


def write_shards(sharded: DataFrame, path: str, prefix: str = "") -> None:
    """One folder of Parquet for every shard page."""
    name = F.concat(F.lit("s"), F.col(prefix + "shard"), F.lit("-"), F.col(prefix + "page"))
    sharded.withColumn("shard_name", name).repartition("shard_name").write.partitionBy("shard_name").parquet(path)
