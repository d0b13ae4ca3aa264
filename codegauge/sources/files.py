"""Trees of source files in, fixed files out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.functions import lang as L
from codegauge.operators.batches import stretches

#: Bytes of text that a writing task holds as Python objects.
PIECE = 1 << 20


def read_source_files(spark: SparkSession, glob: str, lang: str | None = None) -> DataFrame:
    """(path, lang, code): one row per file, read by the executors; `lang` overrides the suffix."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(glob)
    path = F.col("_metadata.file_path")
    return raw.select(
        path.alias("path"),
        L.lang_of_path(path, F.lit(lang) if lang else None).alias("lang"),
        F.col("value").alias("code"))


def fixed_files(df: DataFrame) -> DataFrame:
    """(lang, out_path, fixed_code) for rows with a path and fixed text."""
    return df.filter(F.col("fixed_code") != "").select(
        "lang", L.fixed_path(F.col("path"), F.col("lang")).alias("out_path"), "fixed_code")


def write_fixed(df: DataFrame, path: str) -> None:
    """The fixed texts as a table partitioned by language, each row with its target path.

    Many small sources make many small read tasks: their rows are dealt to partitions of a fitting size, so the table does not
    get a file for every few sources.
    """
    fixed_files(df).hint("rebalance", "lang").write.mode("overwrite").partitionBy("lang").parquet(path)


def write_sources(df: DataFrame, path: str) -> None:
    """Every `value` as a line of a text file in a folder `name=<name>`: what `partitionBy("name").text(path)` writes.

    Tasks put their files in place themselves, each by a rename, where `path` is one that Arrow can write; a repeated task
    writes the same files. A job's own commit moves all files one after the other and sets rights by a process per file.
    """
    rows = df.select("name", "value")
    try:
        fs.FileSystem.from_uri(path)
    except pa.ArrowException:
        rows.write.partitionBy("name").text(path)
        return

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (store, root), task = fs.FileSystem.from_uri(path), TaskContext.get()
        last, folder, lines = None, None, []

        def close() -> None:
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/.{task.taskAttemptId()}") as out:
                out.write(b"".join(lines))
            store.move(f"{folder}/.{task.taskAttemptId()}", f"{folder}/part-{task.partitionId():05d}.txt")

        for batch in batches:
            sizes = pc.binary_length(batch.column("value")).fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in stretches(sizes, PIECE):
                for row in batch.slice(a, b - a).to_pylist():
                    if folder is not None and row["name"] != last:
                        close()
                        lines = []
                    last = row["name"]
                    folder = f"{root}/name={_escaped(last) or '__HIVE_DEFAULT_PARTITION__'}"
                    lines.append((row["value"] or "").encode() + b"\n")
        if folder is not None:
            close()
        yield pa.record_batch([pa.array([task.partitionId()], pa.int64())], names=["task"])

    rows.sortWithinPartitions("name").mapInArrow(put, "task bigint").count()


def _escaped(name: str | None) -> str:
    """A folder name as Spark writes it."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in name or "")
