"""Token counts by dynamic programming over a trie of pre-tokens.

A task collects the distinct pre-tokens of some MiB of text, inserts them in a trie and walks it level by level: the best unigram score
of a prefix is the best over the last piece of the score of the prefix before it plus the piece's score, so it is worked out once
for all pre-tokens that share the prefix. A node keeps the fewest tokens among equally good segmentations; the counts of
terminal nodes are summed over each text. Row-local: no shuffle. A trie lives for one slice of text, so memory is bounded by its
characters.

Defined results: null and empty texts have no tokens; repeated rows are counted row by row; only the id is carried along, so other
columns cannot clash; an empty table gives an empty result; very long words are deep paths, handled level by level as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.pieces import MODEL_PATH, Lookup, Pieces, char_bytes, code_points, escape, load_pieces, splitter
from codegauge.llm.words import slices

SLICE_BYTES = 4 << 20


def trie_counts(words: list[str], pieces: Pieces, lookup: Lookup) -> np.ndarray:
    """Tokens in the best segmentation of every distinct word."""
    flat, start = code_points(words)
    length = np.diff(start)
    out = np.zeros(len(words), np.int64)
    alive = np.flatnonzero(length > 0)
    node = np.zeros(len(words), np.int64)  # of the word's prefix at the current level
    byte_count = {}
    # the last `longest` levels: score, tokens, and for every node its parent and the characters on the way
    score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    parents: list[np.ndarray] = []
    chars: list[np.ndarray] = []
    depth = 0
    while len(alive):
        char = flat[start[alive] + depth].astype(np.int64)
        keys, inverse = np.unique(node[alive] << 21 | char, return_inverse=True)
        parent, char = keys >> 21, keys & ((1 << 21) - 1)
        node[alive] = inverse
        parents.append(parent)
        chars.append(char)
        best, count = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        # ends of pieces: the path down to every node, one character longer in each turn, hashed from its first character
        span = min(pieces.longest, len(parents))
        path = [np.arange(len(keys))]
        for back in range(1, span + 1):
            path.append(parents[-back][path[-1]])
        for size in range(1, span + 1):
            value = lookup.start(len(keys))
            for k in range(size - 1, -1, -1):
                value = lookup.extend(value, chars[-1 - k][path[k]].astype(np.uint64))
            row = lookup.find(value)
            before = path[size]
            ok = np.flatnonzero(row >= 0)
            s, t = score[-size][before[ok]] + lookup.scores[row[ok]], tokens[-size][before[ok]] + 1
            _take(best, count, ok, s, t)
            if size == 1:
                lost = np.flatnonzero(row < 0)
                if len(lost):
                    for c in np.unique(char[lost]).tolist():
                        byte_count.setdefault(c, len(char_bytes(chr(c))))
                    add = np.array([byte_count[c] for c in char[lost].tolist()], np.int64)
                    _take(best, count, lost, score[-1][before[lost]] + pieces.unknown, tokens[-1][before[lost]] + add)
        score.append(best)
        tokens.append(count)
        if len(score) > pieces.longest:
            score.pop(0)
            tokens.pop(0)
        if len(parents) > pieces.longest:
            parents.pop(0)
            chars.pop(0)
        depth += 1
        done = length[alive] == depth
        out[alive[done]] = count[node[alive[done]]]
        alive = alive[~done]
    return out


def _take(best: np.ndarray, count: np.ndarray, at: np.ndarray, score: np.ndarray, tokens: np.ndarray) -> None:
    """Keep the better score, and fewer tokens where scores are equal but for rounding."""
    close = np.abs(score - best[at]) <= 1e-9
    better = (score > best[at]) & ~close | close & (tokens < count[at])
    best[at[better]], count[at[better]] = score[better], tokens[better]


def count_tokens(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_pretokens` and `n_tokens`."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, split = Lookup(pieces.value), splitter(pieces.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                parts = [split.findall(escape(t)) for t in part.column("text").to_pylist()]
                distinct = sorted(set().union(*parts)) if parts else []
                counts = dict(zip(distinct, trie_counts(distinct, pieces.value, lookup).tolist()))
                yield pa.record_batch([part.column("id"), pa.array([len(p) for p in parts], pa.int64()),
                                       pa.array([sum(map(counts.__getitem__, p)) for p in parts], pa.int64())],
                                      names=["id", "n_pretokens", "n_tokens"])

    return source.mapInArrow(run, f"id {kind}, n_pretokens long, n_tokens long").withColumnRenamed("id", id_col)
