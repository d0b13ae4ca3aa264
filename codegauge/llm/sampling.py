"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed best-first (A*) search over the lattice.

A text's lattice is a chain of its pre-tokens' lattices. Backward sums give the chance of every edge at its node, so the mass below any
partial segmentation is known exactly and serves as the heuristic. The search keeps regions of the segmentation space with a
Gumbel-perturbed maximum each: the whole space has a Gumbel(0) value; expanding a region emits its best member (drawn by chance, as the
best of a perturbed region is) and leaves the rest as new regions: for each pre-token, "the same up to here, another
segmentation here", whose values are Gumbels truncated at the value just popped. Popping the region of largest value k times emits k
distinct segmentations in the order of their perturbed scores; the next value is the threshold of the inclusion scores,
log(1 - exp(-exp(log p - threshold))).

Random numbers are a hash of (seed, row key, draw), so a row's samples depend on its key and text alone, on no batch or task. Regions
are expanded lazily with arrays; distinct pre-tokens of a slice of text share their lattices. Row-local: no shuffle.

Scores are those of `codegauge.llm.pieces` times `alpha`. Defined results: a null or empty text has one segmentation, without tokens;
a text with fewer than k segmentations gives all of them, each with inclusion score 0; repeated rows give equal samples; a null id
is a key of its own; only id and text are read, so other columns cannot clash; an empty table gives an empty result. Rests of
less than 1e-15 of a pre-token's mass count as none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codegauge.llm.pieces import MODEL_PATH, Lookup, Pieces, char_bytes, decode, load_pieces, pretokens
from codegauge.llm.words import mix, slices, stretches

SAMPLES, ALPHA, SEED = 2, 0.3, 1
SLICE_BYTES = 2 << 20
_DRAW = np.uint64(0x9E3779B97F4A7C15)
#: Draw numbers: sample << 40 | pre-token << 8 | use; `use` counts the tokens of a pre-token, the last ones are set aside.
_ROOT, _REST = 255, 254
_ALL = (1 << 64) - 1


def in_order(keys: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in their order, first ones first, and the sorted keys; `bits` of a number beside the key hold a place."""
    packed = keys << bits | np.arange(len(keys), dtype=np.uint64)
    packed.sort()  # much faster than an indirect sort
    return (packed & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64), packed >> bits


def distinct(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each stretch of characters, equal ones sharing theirs, and for each number its first stretch, in their order.

    Stretches are matched by the upper bits of hashes; `same` tells from the numbers and first stretches whether that was right. If it was not,
    the whole hashes are tried; if these fail too, none are shared."""
    hashes = stretches(mix(flat.astype(np.uint64)))(begin, size)
    for whole in (False, True):
        if whole:
            order = np.argsort(hashes, kind="stable")
            keys = hashes[order]
        else:
            bits = np.uint64(len(hashes).bit_length())
            order, keys = in_order(hashes >> bits, bits)
        new = np.ones(len(order), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = order[new]
        by = np.argsort(first)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        number = np.empty(len(order), np.int64)
        number[order] = rank[np.cumsum(new) - 1]
        first = first[by]
        if same(number, first).all():
            return number, first
    return (np.arange(len(hashes)),) * 2


class Lattices:
    """Edges of the lattices of all distinct pre-tokens with their chances. A node is the rest of a pre-token from a character on, so
    pre-tokens of one ending share its nodes; `base` has the node of each pre-token, `end` is that of the empty rest."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, pieces: Pieces, lookup: Lookup, alpha: float) -> None:
        at = np.arange(len(flat))
        room = np.repeat(start[1:], np.diff(start)) - at  # characters up to the pre-token's end

        def same(number: np.ndarray, first: np.ndarray) -> np.ndarray:
            other, after = first[number], np.append(number, 0)
            return (flat == flat[other]) & (room == room[other]) & ((room == 1) | (after[1:] == after[other + 1]))

        number, first = distinct(flat, at, room, same)
        nodes = self.end = len(first)
        self.base, room = number[start[:-1]], room[first]
        number = np.append(number, nodes)
        found = []  # of pieces of k characters: first character, number among its edges, k, token, score
        count = np.zeros(nodes, np.int64)

        def add(at: np.ndarray, k: int, token: np.ndarray, score: np.ndarray | float) -> None:
            found.append((at, count[at], k, token, score))
            count[at] += 1

        value, at = lookup.start(nodes), np.arange(nodes)
        for k in range(1, pieces.longest + 1):
            keep = np.flatnonzero(room[at] >= k)
            if len(keep) < len(at):
                at, value = at[keep], value[keep]
            if not len(at):
                break
            chars = flat[first[at] + k - 1]
            value = lookup.extend(value, chars.astype(np.uint64))
            row = lookup.find(value)
            ok = np.flatnonzero(row >= 0)
            add(at[ok], k, lookup.ids[row[ok]], lookup.scores[row[ok]])
            if k == 1:
                lost = row < 0
                add(at[lost], 1, -1 - chars[lost].astype(np.int64), pieces.unknown)
        self.first = np.concatenate([[0], np.cumsum(count)])
        edge_count = int(self.first[-1])
        source = np.repeat(np.arange(nodes), count)
        self.target, self.token, score = np.zeros(edge_count, np.int64), np.zeros(edge_count, np.int64), np.zeros(edge_count)
        for at, slot, k, token, own in found:
            to = self.first[at] + slot
            self.target[to] = np.where(room[at] == k, nodes, number[first[at] + k])
            self.token[to], score[to] = token, own
        score *= alpha
        # backward sums by distance from the word's end
        total = np.zeros(nodes + 1)
        longest = int(room.max(initial=0))
        far = np.repeat(room.astype(np.uint16 if longest < 1 << 16 else np.int64), count)
        order = np.argsort(far, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=longest + 1))])[1:]
        by_source, by_target, by_score = source[order], self.target[order], score[order]
        heads = np.flatnonzero(np.concatenate([[True], by_source[1:] != by_source[:-1]])) if edge_count else np.zeros(0, np.int64)
        spans = np.diff(np.append(heads, edge_count))
        head_cuts = np.searchsorted(heads, cuts)
        for lo, hi, a, b in zip(cuts.tolist(), cuts[1:].tolist(), head_cuts.tolist(), head_cuts[1:].tolist()):
            if lo < hi:
                starts = heads[a:b] - lo
                mass = by_score[lo:hi] + total[by_target[lo:hi]]
                top = np.maximum.reduceat(mass, starts)
                mass -= np.repeat(top, spans[a:b])
                total[by_source[heads[a:b]]] = top + np.log(np.add.reduceat(np.exp(mass, out=mass), starts))
        chance = np.exp(score + total[self.target] - total[source])
        if edge_count:
            heads = self.first[:-1]
            chance /= np.repeat(np.add.reduceat(chance, heads), count)
            upto = np.cumsum(chance)
            upto -= np.repeat(upto[heads] - chance[heads], count)
            upto[heads + count - 1] = 1.0
        else:
            upto = chance
        self.chance = chance
        with np.errstate(divide="ignore"):
            self.log = np.log(chance)
        self.ladder = source + np.minimum(upto, 1.0)  # rises over all nodes, so one search picks an edge

    def draw(self, word: np.ndarray, key: np.ndarray, number: np.ndarray,
             order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation of each given word: edges one after the other, where each word's begin, and their log chances.

        `order`: the words' places by word, so that neighbouring nodes are searched one after the other."""
        live = np.argsort(word, kind="stable") if order is None else order
        at = self.base[word[live]]
        seed = (key + number.astype(np.uint64) * _DRAW)[live]
        owner, edges, chance, size, turn = [], [], np.zeros(len(word)), np.zeros(len(word), np.int64), 0
        sums = np.zeros(len(live))
        while True:
            on = at < self.end
            if not on.all():
                done = live[~on]
                chance[done], size[done] = sums[~on], turn
                on = np.flatnonzero(on)
                live, at, seed, sums = live[on], at[on], seed[on], sums[on]
            if not len(live):
                break
            use = np.uint64(min(turn, _REST - 1)) + (np.uint64(turn // _REST) << np.uint64(56))
            u = _unit(seed + np.array([use]) * _DRAW)
            u += at
            edge = np.minimum(np.searchsorted(self.ladder, u), self.first[at + 1] - 1)
            owner.append(live)
            edges.append(edge)
            sums = sums + self.log[edge]
            at = self.target[edge]
            turn += 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(offsets[-1], np.int64)
        for turn, (some, edge) in enumerate(zip(owner, edges)):
            out[offsets[some] + turn] = edge
        return out, offsets, chance

    def path_log(self, path: tuple[int, ...]) -> float:
        return sum(map(self.log.item, path))

    def draw_other(self, word: int, known: list[tuple[int, ...]], key: int, number: int) -> tuple[list[int], float]:
        """A segmentation of a word that is none of the known ones, by their remaining chances."""
        at, out, log, left, step = self.base.item(word), [], 0.0, known, 0
        while at < self.end:
            first = self.first.item(at)
            mass = self.chance[first:self.first.item(at + 1)].tolist()
            for path in left:
                mass[path[step] - first] -= math.exp(self.path_log(path[step:]))
            u = uniform_one(key, number + (step << 48)) * sum(max(0.0, m) for m in mass)
            e, run = first + mass.index(max(mass)), 0.0
            for k, m in enumerate(mass):
                run += max(0.0, m)
                if m > 0 and run >= u:
                    e = first + k
                    break
            out.append(e)
            log += self.log.item(e)
            left = [path for path in left if path[step] == e]
            at, step = self.target.item(e), step + 1
        return out, log


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from the bits of `mix(x)`."""
    u = (mix(x) >> np.uint64(12)).astype(np.float64)
    u *= 2.0 ** -52
    u += 2.0 ** -53
    return u


def uniform(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1 from a row key and the number of a draw."""
    return _unit(key + number.astype(np.uint64) * _DRAW)


def uniform_one(key: int, number: int) -> float:
    """The same for one draw."""
    x = (key + number * int(_DRAW)) & _ALL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & _ALL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _ALL
    return ((x ^ x >> 31) >> 12) * 2.0 ** -52 + 2.0 ** -53


def truncated(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbels of the given locations that are at most `most`."""
    with np.errstate(over="ignore"):
        return location - np.log(np.exp(np.minimum(location - most, 700.0)) - np.log(u))


def log_rest(log: np.ndarray) -> np.ndarray:
    """log(1 - exp(log)), -inf where nothing is left."""
    rest = -np.expm1(np.minimum(log, 0.0))
    out = np.full(len(log), -np.inf)
    some = rest > 1e-15
    out[some] = np.log(rest[some])
    return out


def row_key(value: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{value!r}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _number(j: int, i: int, use: int) -> int:
    return (j << 40) + (i << 8) + use


def best_first(lattices: Lattices, words: np.ndarray, starts: np.ndarray, key: np.ndarray, fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
               k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """(edges, log chance, log inclusion) of up to k segmentations of every text.

    Text t has words[starts[t]:starts[t + 1]]; `fresh[j]` is the j-th independent draw of all words. All texts expand together, so a
    round costs a few operations on all words and little Python for each text."""
    texts, counts = len(starts) - 1, np.diff(starts)
    owner = np.repeat(np.arange(texts), counts)
    place = np.arange(len(words)) - starts[owner]
    base = key[owner] + (place.astype(np.uint64) << np.uint64(8)) * _DRAW
    some = np.flatnonzero(counts)
    bounds = list(zip(starts.tolist(), starts[1:].tolist()))
    seeds = key.tolist()
    logs: list[np.ndarray] = []  # of each path's words
    values: list[np.ndarray] = []  # of the regions "another segmentation at this word"
    best = np.full((k, texts), -np.inf)  # value of each path's best region
    paths: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(texts)]  # edges and offsets
    known: dict[tuple[int, int], list[tuple[int, ...]]] = {}

    def expand(log: np.ndarray, after: np.ndarray, most: np.ndarray) -> None:
        location = np.zeros(len(words))
        for a, b in bounds:
            if b - a > 1:
                np.cumsum(log[a:b - 1], out=location[a + 1:b])
        location += log_rest(log)
        value = np.full(len(words), -np.inf)
        open_ = np.flatnonzero(np.isfinite(location) & (place >= after[owner]))
        u = _unit(base[open_] + np.array([_number(len(values), 0, _REST)], np.uint64) * _DRAW)
        value[open_] = truncated(location[open_], most[owner[open_]], u)
        if len(some):
            best[len(values), some] = np.maximum.reduceat(value, starts[some])
        logs.append(log)
        values.append(value)

    most = np.array([-math.log(-math.log(uniform_one(x, _number(0, 0, _ROOT)))) for x in seeds])
    edges, offsets, log = fresh[0]
    for t, (a, b) in enumerate(bounds):
        paths[t].append((edges[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]))
    expand(log, np.zeros(texts, np.int64), most)
    for new in range(1, k):
        log, after = np.zeros(len(words)), np.zeros(texts, np.int64)
        tail_edges, tail_offsets, tail_log = fresh[new]
        parents, most = best[:new].argmax(axis=0).tolist(), best[:new].max(axis=0)
        for t in np.flatnonzero(most > -np.inf).tolist():
            (a, b), j, top = bounds[t], parents[t], most.item(t)
            i = int(values[j][a:b].argmax())
            edges, offsets = paths[t][j]
            lo, hi = offsets.item(i), offsets.item(i + 1)
            gone = known.setdefault((j, a + i), [tuple(edges[lo:hi].tolist())])
            other, chance = lattices.draw_other(words.item(a + i), gone, seeds[t], _number(new, i, _ROOT))
            gone.append(tuple(other))
            share = min(1.0, sum(math.exp(lattices.path_log(path)) for path in gone))
            rest = -math.expm1(math.log(share)) if share > 0 else 1.0
            value = -math.inf
            if rest > 1e-15:
                location = float(logs[j][a:a + i].sum()) + math.log(rest)
                u = uniform_one(seeds[t], _number(new + k, i, _ROOT))
                value = location - math.log(math.exp(min(location - top, 700.0)) - math.log(u))
            values[j][a + i] = value
            best[j, t] = values[j][a:b].max()
            cut = tail_offsets.item(a + i + 1)
            joined = np.concatenate([edges[:lo], np.array(other, np.int64), tail_edges[cut:tail_offsets.item(b)]])
            moved = np.concatenate([offsets[:i + 1], tail_offsets[a + i + 1:b + 1] - cut + (lo + len(other))])
            paths[t].append((joined, moved))
            log[a:a + i] = logs[j][a:a + i]
            log[a + i] = chance
            log[a + i + 1:b] = tail_log[a + i + 1:b]
            after[t] = i + 1
        expand(log, after, most)
    out, limits = [], best.max(axis=0).tolist()
    for t, (a, b) in enumerate(bounds):
        rows, limit = [], limits[t]
        for m, (edges, _) in enumerate(paths[t]):
            total = float(logs[m][a:b].sum())
            gap = total - limit
            share = 0.0 if limit == -math.inf else gap if gap < -30 else math.log(-math.expm1(-math.exp(min(gap, 700.0))))
            rows.append((edges, total, share))
        out.append(rows)
    return out


def _edge_tokens(lattices: Lattices, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all edges one after the other, and where each edge's begin; a lost character has a token for each byte."""
    spelled = {c: [pieces.byte_ids[b] for b in char_bytes(chr(-1 - c))] for c in np.unique(lattices.token[lattices.token < 0]).tolist()}
    count = np.ones(len(lattices.token), np.int64)
    lost = np.flatnonzero(lattices.token < 0)
    count[lost] = [len(spelled[c]) for c in lattices.token[lost].tolist()]
    begin = np.concatenate([[0], np.cumsum(count)])
    flat = np.repeat(lattices.token, count)
    for e in lost.tolist():
        flat[begin[e]:begin[e + 1]] = spelled[int(lattices.token[e])]
    return flat, begin


def _tokens(edges: np.ndarray, flat: np.ndarray, begin: np.ndarray) -> np.ndarray:
    count = begin[edges + 1] - begin[edges]
    if len(edges) and count.max() == 1:
        return flat[begin[edges]]
    return flat[np.repeat(begin[edges] - np.cumsum(count) + count, count) + np.arange(count.sum())]


def sample_texts(keys: list[int], texts: list[str], pieces: Pieces, lookup: Lookup, k: int, alpha: float) -> list[list[tuple[np.ndarray, float, float]]]:
    """For every text up to k of (token ids, log chance, log inclusion)."""
    flat, begin, counts = pretokens(texts, lookup)
    size = np.diff(begin)

    def same(number: np.ndarray, first: np.ndarray) -> np.ndarray:
        if (size != size[first[number]]).any():
            return np.zeros(1, bool)
        return flat == flat[np.arange(len(flat)) + np.repeat(begin[first[number]] - begin[:-1], size)]

    words, first = distinct(flat, begin[:-1], size, same)
    start = np.concatenate([[0], np.cumsum(size[first])])
    flat = flat[np.arange(start[-1]) + np.repeat(begin[first] - start[:-1], size[first])]
    lattices = Lattices(flat, start, pieces, lookup, alpha)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = (np.arange(len(words)) - starts[owner]).astype(np.uint64) << np.uint64(8)
    key = np.array(keys, np.uint64)
    order, _ = in_order(words.astype(np.uint64), np.uint64(len(words).bit_length()))
    draws = [lattices.draw(words, key[owner], place + np.uint64(j << 40), order) for j in range(k)]
    found = best_first(lattices, words, starts, key, draws, k)
    edges = [e for rows in found for e, _, _ in rows]
    flat_edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    ids, begin = _edge_tokens(lattices, pieces)
    upto = np.concatenate([[0], np.cumsum(begin[flat_edges + 1] - begin[flat_edges])])
    cuts = upto[np.cumsum([0, *map(len, edges)])].tolist()
    ids, row = _tokens(flat_edges, ids, begin), iter(zip(cuts, cuts[1:]))
    return [[(ids[slice(*next(row))], p, q) for _, p, q in rows] for rows in found]


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, model_path: str = MODEL_PATH,
                         id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Up to k rows for every document: its id, `rank` in the order of perturbed scores, `ids`, `log_prob` and `log_inclusion`.

    `slice_bytes` of text share one set of lattices: less takes less memory and more time, the rows are the same."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(pieces.value)
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                keys = [row_key(i, seed) for i in part.column("id").to_pylist()]
                found = sample_texts(keys, part.column("text").to_pylist(), pieces.value, lookup, k, alpha)
                flat = [x for rows in found for x in rows]
                offsets = np.concatenate([[0], np.cumsum([len(x[0]) for x in flat])]).astype(np.int32)
                ids = np.concatenate([x[0] for x in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
                which = np.repeat(np.arange(len(found)), [len(rows) for rows in found])
                yield pa.record_batch([
                    part.column("id").take(pa.array(which)), pa.array([r + 1 for rows in found for r in range(len(rows))], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([x[1] for x in flat], pa.float64()),
                    pa.array([x[2] for x in flat], pa.float64())], names=["id", "rank", "ids", "log_prob", "log_inclusion"])

    return source.mapInArrow(run, f"id {kind}, rank int, ids array<int>, log_prob double, log_inclusion double").withColumnRenamed("id", id_col)


def decode_tokens(encoded: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with the text of their token ids in `text_col` (null for null ids)."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    @F.udf("string", useArrow=True)
    def text(ids):
        return None if ids is None else decode([int(i) for i in ids], pieces.value)

    return encoded.withColumn(text_col, text(ids_col))
