"""Removal of repeated passages with suffix automata of reference shards.

A window of `window` words is removed where the same words start earlier: in a smaller id, or earlier in the same document. The
reference is the corpus itself, so its automata have no size bound and cannot be broadcast; they are built where they are needed:

1. Every window has an anchor, the word group with the smallest hash inside it (the first of equal ones). Equal windows have equal
   anchors. Neighbouring windows with one anchor form a piece of at most `2 * window` words; each window lies in one piece.
2. Pieces whose anchor occurs once cannot repeat and go no further: only anchor hashes are counted for them.
3. Equal pieces are aggregated to the earliest one; the windows of all later ones are repeated as a whole. The windows of one piece
   differ from each other, since their common anchor stands at another place in each; so an anchor with one piece left is settled.
4. The earliest pieces of the other anchors are dealt by anchor to shards of bounded size. A window reaches far to the left or far to
   the right of its anchor, so two pieces with a common window have equal words on that side: a piece whose sides (see `sides`) stand
   in no other piece is left out. From the others a shard builds one suffix automaton in document order and streams each piece
   through it while it grows: the matching statistic of a word is the longest stretch ending there that the automaton has from an
   earlier place. Stretches of `window` words and more are spans to be removed.
5. An anchor whose pieces alone would pass a shard's size (a phrase in very many different surroundings) is dealt by its sides, and
   what shares a side by whole windows, whose earliest occurrence is an aggregate. It needs no automaton, and no case is dropped.
   A piece has at most `window` less the anchor's words plus one windows, so the rows grow with the pieces, not with their pairs.
6. Spans return to their documents by id and text hash.

Defined results: a null or empty text has no words; a null id counts as smaller than all others; rows with one id and different
texts are different documents in the order of their text hashes; rows that repeat id and text count as one document and all get its
result; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.words import SPACES, chain, joined_words, mix, plain_words, runs, slices, split_words, stretches
from codegauge.session import scratch_path

WINDOW = 20
#: Words that one automaton holds on average; an anchor with more than a quarter of it is dealt by windows.
SHARD_WORDS = 1 << 16
_PACK = 4096  # a piece's place: first word * _PACK + number of words


def _first_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of `width` values the position of its smallest one, the first of equal ones."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = at[:-step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        reach += step
    return at


def _anchor_words(window: int) -> int:
    return max(1, 3 * window // 10)


def _grams(hashes: np.ndarray, group: int) -> np.ndarray:
    """Hash of the `group` words from each word on."""
    count = max(0, len(hashes) - group + 1)
    grams = mix(hashes[:count])
    for k in range(1, group):
        grams = chain(grams, hashes[k:count + k])
    return grams


def find_pieces(number: np.ndarray, hashes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Text, first word in the slice, number of words, anchor hash and content hash of every piece."""
    group = _anchor_words(window)
    n = len(hashes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    grams = _grams(hashes, group)
    anchor = _first_smallest(grams, window - group + 1)
    whole = np.flatnonzero(number[:n - window + 1] == number[window - 1:])  # windows inside one text
    first, last = runs(anchor[whole])
    start, words = whole[first], whole[last - 1] - whole[first] + window
    # windows of two texts never share an anchor's place, since an anchor lies inside its window
    return number[start], start, words, grams[anchor[start]], stretches(hashes)(start, words)


def sides(found: pa.Array, offsets: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every piece the last start of a window that lies to the left of its anchor, and the keys of its left and its right side.

    `found` has the words of all pieces, `offsets` where each begins. Of a window's words beside the anchor at least half stand on
    one side: windows up to that start hold the left key's words, later ones the right key's. A side with no window has the key 0."""
    group, pieces = _anchor_words(window), len(anchor)
    near = (window - group + 1) // 2
    coded = found.dictionary_encode()
    hashes = plain_words(coded.dictionary, SPACES)[1][coded.indices.to_numpy()] if len(found) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(pieces), np.diff(offsets))
    grams = _grams(hashes, group)
    hits = np.flatnonzero(grams == anchor.view(np.uint64)[owner[:len(grams)]])
    at = hits[np.searchsorted(owner[hits], np.arange(pieces))]  # all windows hold the anchor's first place
    begin, end = offsets[:-1], offsets[1:]
    last, stretch = at - near, stretches(hashes)

    def key(some: np.ndarray, start: np.ndarray, side: int) -> np.ndarray:
        out = np.zeros(pieces, np.uint64)
        out[some] = np.maximum(mix(stretch(start[some], np.full(some.sum(), near + group)) + np.uint64(side)), 1)
        return out

    return last - begin, key(last >= begin, last, 1), key(np.maximum(last + 1, begin) + window <= end, at, 2)


def sharing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pieces have a side that another piece has too."""
    _, which, count = np.unique(np.concatenate([left, right]), return_inverse=True, return_counts=True)
    left_count, right_count = np.split(count[which], 2)
    return (left != 0) & (left_count > 1) | (right != 0) & (right_count > 1)


def _slice_pieces(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    number, hashes = plain_words(part.column("text"), SPACES)
    text, start, words, anchor, content = find_pieces(number, hashes, window)
    start = start - np.searchsorted(number, text)
    return text, start * _PACK + words, anchor.view(np.int64), content.view(np.int64)


def earlier_matches(pieces: Iterator[list[Hashable]], window: int) -> Iterator[list[tuple[int, int]]]:
    """For each piece the maximal stretches covered by windows that stand in an earlier piece or earlier in this one.

    One suffix automaton of all pieces so far; it takes in each word after the word's matching statistic is known."""
    length, link, step = [0], [-1], [{}]

    def cloned(state: int, word: Hashable, at: int) -> int:
        """A copy of state `at` for the words that reach it over `state`."""
        length.append(length[state] + 1)
        link.append(link[at])
        step.append(step[at].copy())
        link[at] = copy = len(length) - 1
        while state >= 0 and step[state].get(word) == at:
            step[state][word] = copy
            state = link[state]
        return copy

    for piece in pieces:
        spans: list[tuple[int, int]] = []
        tail = state = matched = 0
        for place, word in enumerate(piece):
            while state and word not in step[state]:
                state = link[state]
                matched = length[state]
            if word in step[state]:
                state = step[state][word]
                matched += 1
            if matched >= window:
                start = place + 1 - window
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], place + 1)
                else:
                    spans.append((start, place + 1))
            at = step[tail].get(word)
            if at is not None:
                tail = at if length[at] == length[tail] + 1 else cloned(tail, word, at)
            else:
                length.append(length[tail] + 1)
                link.append(0)
                step.append({})
                fresh, above = len(length) - 1, tail
                while above >= 0 and word not in step[above]:
                    step[above][word] = fresh
                    above = link[above]
                if above >= 0:
                    at = step[above][word]
                    link[fresh] = at if length[at] == length[above] + 1 else cloned(above, word, at)
                tail = fresh
            if state and matched <= length[link[state]]:  # the state was split
                state = link[state]
        yield spans


def _all_pieces(docs: DataFrame, window: int, anchors_only: bool) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                text, place, anchor, content = _slice_pieces(part, window)
                if anchors_only:
                    yield pa.record_batch([pa.array(anchor)], names=["anchor"])
                else:
                    rows = pa.array(text)
                    yield pa.record_batch([part.column("id").take(rows), part.column("hash").take(rows), pa.array(place), pa.array(anchor),
                                           pa.array(content)], names=["id", "hash", "place", "anchor", "content"])

    id_type = docs.schema["id"].dataType.simpleString()
    schema = "anchor long" if anchors_only else f"id {id_type}, hash long, place long, anchor long, content long"
    return (docs.select("text") if anchors_only else docs).mapInArrow(cut, schema)


def _piece_texts(asked: DataFrame, id_type: str) -> DataFrame:
    """The words of asked pieces: rows of a text and its list of (place, anchor, hot)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                number, found = split_words(part.column("text"))
                first = np.searchsorted(number, np.arange(part.num_rows))
                asked = part.column("asked")
                flat = asked.flatten()
                rows = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                place = flat.field("place").to_numpy()
                start, words = first[rows] + place // _PACK, place % _PACK
                total = np.append(0, np.cumsum(words))
                taken = np.arange(total[-1]) + np.repeat(start - total[:-1], words)
                lists = pa.ListArray.from_arrays(pa.array(total, pa.int32()), found.take(pa.array(taken)).cast(pa.string()))
                yield pa.record_batch([part.column("id").take(pa.array(rows)), part.column("hash").take(pa.array(rows)), flat.field("place"),
                                       flat.field("anchor"), flat.field("hot"), lists],
                                      names=["id", "hash", "place", "anchor", "hot", "words"])

    return asked.mapInArrow(cut, f"id {id_type}, hash long, place long, anchor long, hot boolean, words array<string>")


def _shard_spans(pieces: DataFrame, shards: int, window: int, id_type: str) -> DataFrame:
    def judge(shard: pa.Table) -> pa.Table:
        order = pd.DataFrame({"known": shard["id"].is_valid().to_numpy(), "id": shard["id"].to_pandas(), "hash": shard["hash"].to_numpy(),
                              "place": shard["place"].to_numpy()}).drop_duplicates().sort_values(["known", "id", "hash", "place"]) \
            .index.to_numpy()  # a repeated row sends its pieces twice
        words = shard["words"].combine_chunks().take(pa.array(order))
        found, offsets = words.flatten(), words.offsets.to_numpy() - words.offsets[0].as_py()
        _, left, right = sides(found, offsets, shard["anchor"].to_numpy()[order], window)
        linked = np.flatnonzero(sharing(left, right))
        codes = found.dictionary_encode().indices.to_numpy()
        texts = (codes[offsets[i]:offsets[i + 1]].tolist() for i in linked.tolist())
        rows, begins, ends = [], [], []
        for row, spans in zip(order[linked].tolist(), earlier_matches(texts, window)):
            for begin, end in spans:
                rows.append(row)
                begins.append(begin)
                ends.append(end)
        at = pa.array(rows, pa.int64())
        first = shard["place"].to_numpy()[rows] // _PACK if rows else np.zeros(0, np.int64)
        return pa.table({"id": shard["id"].take(at), "hash": shard["hash"].take(at), "begin": pa.array(first + np.array(begins, np.int64)),
                         "end": pa.array(first + np.array(ends, np.int64))})

    return pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard") \
        .applyInArrow(judge, f"id {id_type}, hash long, begin long, end long")


def _sides_apart(pieces: DataFrame, window: int, id_type: str) -> DataFrame:
    """For each side of a piece that has windows: its key and the words of these windows, from word `begin` of the text on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            found, offsets = words.flatten(), words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
            last, left, right = sides(found, offsets, batch.column("anchor").to_numpy(), window)
            first = batch.column("place").to_numpy() // _PACK
            size = np.diff(offsets)
            middle = np.maximum(last + 1, 0)  # where the right side's windows begin
            for key, start, stop in ((left, np.zeros_like(last), np.minimum(last + window, size)), (right, middle, size)):
                some = np.flatnonzero(key)
                total = np.append(0, np.cumsum(stop[some] - start[some]))
                taken = np.arange(total[-1]) + np.repeat(offsets[some] + start[some] - total[:-1], stop[some] - start[some])
                rows = pa.array(some)
                yield pa.record_batch([batch.column("id").take(rows), batch.column("hash").take(rows), pa.array(first[some] + start[some]),
                                       pa.array(key[some].view(np.int64)),
                                       pa.ListArray.from_arrays(pa.array(total, pa.int32()), found.take(pa.array(taken)))],
                                      names=["id", "hash", "start", "key", "words"])

    return pieces.mapInArrow(cut, f"id {id_type}, hash long, start long, key long, words array<string>")


def _window_spans(pieces: DataFrame, window: int, id_type: str, stored: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Repeated windows of anchors too frequent for a shard, by the earliest occurrence of each window."""
    apart = stored(_sides_apart(pieces, window, id_type), "sides")
    shared = stored(apart.groupBy("key").count().where("count > 1").select("key"), "shared")
    found = stored(apart.join(shared, "key").select("id", "hash", "start", F.posexplode(F.expr(
        f"transform(sequence(1, size(words) - {window - 1}), i -> slice(words, i, {window}))")).alias("nth", "part"))
        .select("id", "hash", F.expr("start + nth").alias("begin"), F.sha2(F.array_join("part", " "), 256).alias("part")), "windows")
    earliest = found.groupBy("part").agg(F.min(F.struct("id", "hash", "begin")).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    return found.join(earliest, "part").where("NOT struct(id, hash, begin) <=> earliest") \
        .select("id", "hash", "begin", F.expr(f"begin + {window}").alias("end"))


def repeated_spans(source: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows id, hash, begin, end: words to be removed of the document with that id and text hash. `source`: id, hash, text."""
    spark, id_type = source.sparkSession, source.schema["id"].dataType.simpleString()

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"substrings-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    # stored, so that the join's sides are shuffles of their own and a hot anchor is split
    again = stored(_all_pieces(source, window, True).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    repeated = stored(_all_pieces(source, window, False).join(again, "anchor"), "repeated")
    distinct = stored(repeated.groupBy("anchor", "content").agg(F.min(F.struct("id", "hash", "place")).alias("earliest"),
                                                                F.count("*").alias("n")), "distinct")
    copies = repeated.join(distinct.where("n > 1").select("anchor", "content", "earliest"), ["anchor", "content"]) \
        .where("NOT struct(id, hash, place) <=> earliest") \
        .select("id", "hash", F.expr(f"place div {_PACK}").alias("begin"), F.expr(f"place div {_PACK} + place % {_PACK}").alias("end"))
    # an anchor with one piece has no window in two places but in that piece's copies
    several = stored(distinct.groupBy("anchor").agg(F.sum(F.expr(f"earliest.place % {_PACK}")).alias("words"), F.count("*").alias("contents"))
                     .where("contents > 1").select("anchor", "words"), "several")
    shards = max(1, math.ceil((several.agg(F.sum("words")).first()[0] or 0) / shard_words))
    asked = distinct.join(several, "anchor").selectExpr("earliest.*", "anchor", f"words > {shard_words // 4} AS hot") \
        .groupBy(F.col("id").alias("i"), F.col("hash").alias("h")).agg(F.collect_list(F.struct("place", "anchor", "hot")).alias("asked"))
    texts = source.join(asked, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).select("id", "hash", "text", "asked")
    pieces = stored(_piece_texts(texts, id_type), "pieces")
    return copies.unionByName(_shard_spans(pieces.where("NOT hot"), shards, window, id_type)) \
        .unionByName(_window_spans(pieces.where("hot"), window, id_type, stored))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: its id, `n_words`, `removed` (begin and end of maximal stretches, in words) and `kept`, the text of the
    other words."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    spans = repeated_spans(source, window, shard_words).groupBy(F.col("id").alias("i"), F.col("hash").alias("h")) \
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                number, found = split_words(part.column("text"))
                first = np.searchsorted(number, np.arange(rows))
                spans = part.column("spans")
                flat = spans.flatten()
                base = first[np.repeat(np.arange(rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy())]
                edge = np.zeros(len(number) + 1, np.int64)
                np.add.at(edge, base + flat.field("begin").to_numpy(), 1)
                np.add.at(edge, base + flat.field("end").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                begins, ends = runs(np.where(gone, number, -1 - number))
                begins, ends = begins[gone[begins]], ends[gone[begins]]
                owner = number[begins]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(begins - first[owner]), pa.array(ends - first[owner])], ["begin", "end"]))
                yield pa.record_batch([part.column("id"), pa.array(np.bincount(number, minlength=rows)), lists,
                                       joined_words(found, number, rows, ~gone)], names=["id", "n_words", "removed", "kept"])

    return source.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left").select("id", "text", "spans") \
        .mapInArrow(cut, f"id {id_type}, n_words long, removed array<struct<begin:long,end:long>>, kept string") \
        .withColumnRenamed("id", id_col)
