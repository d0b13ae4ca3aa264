"""Most similar short text of the same group by equal characters at equal positions, without trying all pairs.

Candidates are sorted and packed into books of neighbours, and books into shelves of bounded size. A book knows which characters
(mod 64) occur at each position; the positions where a text meets this index are an upper bound of its similarity to any candidate
of the book. Every text first searches the shelf where it would stand in sorted order; what it finds there is the floor for
all other shelves of its group. In a shelf, books are visited best bound first until no bound beats the floor.

Texts and shelves meet in (shelf, part) groups: a group of texts that holds most rows spreads over its shelves, and a shelf that
many texts search is handed to as many tasks as it has parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from codegauge.session import scratch_path

BOOK, SHELF, PART = 256, 1 << 16, 1 << 14
_BLOCK = 1024
_NO_ROW = (1 << 63) - 1


def letters(texts: list[str], width: int, fill: int) -> np.ndarray:
    """Code points as a matrix, short texts filled up."""
    out = np.full((len(texts), width), fill, np.int32)
    for i, text in enumerate(texts):
        codes = np.frombuffer(text[:width].encode("utf-32-le", "surrogatepass"), np.int32)
        out[i, :len(codes)] = codes
    return out


def _bits(codes: np.ndarray) -> np.ndarray:
    return np.where(codes >= 0, np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)), np.uint64(0))


def search(candidates: np.ndarray, rows: np.ndarray, texts: np.ndarray, floor: np.ndarray, floor_row: np.ndarray,
           book: int = BOOK) -> tuple[np.ndarray, np.ndarray]:
    """Best (similarity, row) of every text: the floor, or a candidate that is more similar or as similar with a smaller row.

    Inside a book candidates stand in the order of their rows, so the first of the best ones wins."""
    starts = np.arange(0, len(rows), book)
    owner = np.arange(len(rows)) // book
    by = np.lexsort((rows, owner))
    candidates, rows = candidates[by], rows[by]
    index = np.bitwise_or.reduceat(_bits(candidates), starts, axis=0)
    first_row = rows[starts]
    best, best_row = floor.copy(), floor_row.copy()
    for a in range(0, len(texts), _BLOCK):
        part = texts[a:a + _BLOCK]
        bits = _bits(part)
        bound = np.zeros((len(part), len(starts)), np.int16)
        for p in range(part.shape[1]):
            bound += (bits[:, p, None] & index[None, :, p]) != 0
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(part))
        for nth in range(len(starts)):
            books = order[live, nth]
            most = bound[live, books]
            live = live[most >= best[a + live]]  # bounds fall from here on
            if not len(live):
                break
            books = order[live, nth]
            useful = (bound[live, books] > best[a + live]) | (first_row[books] < best_row[a + live])
            for number in np.unique(books[useful]):
                who = live[useful & (books == number)]
                stop = min(starts[number] + book, len(rows))
                inside, own = candidates[starts[number]:stop], rows[starts[number]:stop]
                equal = np.zeros((len(who), len(own)), np.int16)
                for p in range(part.shape[1]):
                    equal += part[who, p, None] == inside[None, :, p]
                at = equal.argmax(axis=1)
                found, row = equal[np.arange(len(who)), at], own[at]
                better = (found > best[a + who]) | ((found == best[a + who]) & (row < best_row[a + who]))
                best[a + who[better]], best_row[a + who[better]] = found[better], row[better]
    return best, best_row


def _shelve(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row per shelf from sorted (group, text, row)."""
    number, group, texts, rows = 0, None, [], []

    def shelf() -> pa.RecordBatch:
        return pa.record_batch([pa.array([(TaskContext.get().partitionId() << 32) + number]), pa.array([group], pa.string()),
                                pa.array([texts[0]]), pa.array([texts], pa.list_(pa.string())), pa.array([rows], pa.list_(pa.int64()))],
                               names=["shelf", "kind", "first", "texts", "rows"])

    for batch in batches:
        for kind, text, row in zip(*(c.to_pylist() for c in batch.columns)):
            if texts and (kind != group or len(texts) >= size):
                yield shelf()
                number, texts, rows = number + 1, [], []
            group = kind
            texts.append(text)
            rows.append(row)
    if texts:
        yield shelf()


def _meet(asks: DataFrame, shelves: DataFrame, width: int, book: int, part: int) -> DataFrame:
    """(kind, text, shelf, sim, row_no) of asks (kind, text, shelf, sim, row_no) after searching their shelf."""
    parts = asks.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    dealt = asks.join(parts, "shelf").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts"))).drop("parts")
    copies = shelves.join(parts, "shelf").select(F.col("shelf").alias("of"), "texts", "rows",
                                                 F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("copy"))

    def visit(asked: pa.Table, shelf: pa.Table) -> pa.Table:
        if asked.num_rows and shelf.num_rows:
            inside, rows = shelf["texts"][0].as_py(), np.array(shelf["rows"][0].as_py(), np.int64)
            best, row = search(letters(inside, width, -1), rows, letters(asked["text"].to_pylist(), width, -2),
                               asked["sim"].to_numpy().astype(np.int16), asked["row_no"].to_numpy().astype(np.int64), book)
        else:
            best, row = np.zeros(0, np.int16), np.zeros(0, np.int64)
        return pa.table({"kind": asked["kind"], "text": asked["text"], "shelf": asked["shelf"], "sim": pa.array(best.astype(np.int32)),
                         "row_no": pa.array(row)})

    return dealt.groupBy("shelf", "part").cogroup(copies.groupBy("of", "copy")).applyInArrow(
        visit, "kind string, text string, shelf long, sim int, row_no long")


def nearest(texts: DataFrame, candidates: DataFrame, width: int, book: int = BOOK, shelf: int = SHELF, part: int = PART) -> DataFrame:
    """(kind, text, row_no): for each distinct text the candidate (kind, text, row_no) of its kind that has most characters of the first
    `width` in common; of equal ones the smallest row. Texts of a kind without candidates are left out."""
    spark = texts.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"nearest-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    shelves = stored(
        candidates.select("kind", "text", F.col("row_no").cast("long").alias("row_no")).repartitionByRange("kind", "text")
        .sortWithinPartitions("kind", "text").mapInArrow(
            lambda batches: _shelve(batches, shelf), "shelf long, kind string, first string, texts array<string>, rows array<long>"), "shelves")
    places = shelves.select("kind", "shelf", "first")
    home = texts.join(places, "kind").groupBy("kind", "text").agg(
        F.coalesce(F.max_by("shelf", F.when(F.col("first") <= F.col("text"), F.col("first"))), F.min("shelf")).alias("shelf"))
    floors = stored(_meet(home.withColumn("sim", F.lit(-1)).withColumn("row_no", F.lit(_NO_ROW)), shelves, width, book, part), "floors")
    others = floors.withColumnRenamed("shelf", "home").join(places.drop("first"), "kind").where("shelf <> home").drop("home")
    found = floors.unionByName(_meet(others, shelves, width, book, part))
    return found.groupBy("kind", "text").agg(F.max(F.struct("sim", (-F.col("row_no")).alias("neg"))).alias("best")) \
        .select("kind", "text", (-F.col("best.neg")).alias("row_no"))
