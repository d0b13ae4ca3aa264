"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. Sketch (row-local): the distinct word shingles of a whole text become 64-bit hashes; each of `bins` bins keeps the smallest
   hash that falls in it, an empty bin borrows from a bin that a hash of (bin, attempt) picks. `rows` bins make a band key.
   Documents with equal shingle sets share a digest and are one class from here on. A class has a number of its own, given once
   when the classes are stored; ids play no part until the end, when each component takes the smallest one in it.
2. Star: the classes that share a band key are a bucket; its member of smallest random rank is the centre and every other member
   gets one edge to it, so a bucket of m members makes m - 1 edges. Ranks differ from band to band, so centres do too.
3. Edges are confirmed on the full shingle sets, rebuilt from the texts of the classes that have an edge.
4. Rest: a star can miss links between its leaves. A bucket whose members are not one component yet belongs to the home of its most
   frequent component; members outside that component are compared with all members of the buckets of that home, so no link that
   shares a bucket is lost. The comparison goes block by block (at most BLOCK askers and BLOCK others in a group) inside
   tasks, and a row comes out only for a link to another component. Members of one component need no further comparison.
5. Components by merging nodes into their smallest neighbour; every document takes its class's component.

With bands of 6 rows of 64 bands, a pair at similarity 0.8 shares no bucket with probability 4e-9.

Joins put the hot side of a key (a centre, a bucket, a digest) on the probe side of plain equality joins, which adaptive
execution splits; per-key facts are aggregated before they are shuffled. Nothing is collected but counts. Intermediate tables are
written below the session's shared folder, so a lost executor never restarts the loop.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a text of fewer words than a
shingle has one shingle, the whole sequence; repeated ids are one document per row with the same id (each row is returned and
linked by its own text); a null id can never be the smallest, its rows are linked like all others and bridge others, and a component
of null ids only has a null component id; other columns are not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codegauge.llm.words import SPACES, chain, mix, runs, slices, words
from codegauge.session import scratch_path

BINS, ROWS = 384, 6
ATTEMPTS, BLOCK = 32, 512
_REST_SEED, _PICK_SEED, _BAND_SEED = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, sorted by text and hash."""
    number, hashes = words(column, SPACES)
    if not len(hashes):
        return number, hashes
    count = np.bincount(number, minlength=len(column))
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    last = len(hashes) - size + 1
    if last > 0:
        full = np.flatnonzero(number[:last] == number[size - 1:])
        value = hashes[full]
        for k in range(1, size):
            value = chain(value, hashes[full + k])
        text = number[full]
    else:
        text, value = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    extra = []
    for s in short:
        h = hashes[first[s]]
        for k in range(1, count[s]):
            h = chain(np.array([h]), hashes[first[s] + k:first[s] + k + 1])[0]
        extra.append(mix(np.array([h + np.uint64(count[s])]))[0])
    if extra:
        text, value = np.concatenate([text, short]), np.concatenate([value, np.array(extra, np.uint64)])
        by = np.argsort(text, kind="stable")
        text, value = text[by], value[by]
    for start, stop in zip(*runs(text)):
        value[start:stop].sort()
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _slot(value: np.ndarray, bins: int) -> np.ndarray:
    return (((value >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)


def signatures(text: np.ndarray, value: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and a row of `bins` minima for each of them.

    Every bin ranks all bins: first by the attempts of a hash sequence, then, where no attempt met a filled bin, by another hash.
    An empty bin borrows from its first filled one, so two texts borrow alike as far as their filled bins agree.
    """
    which, row = np.unique(text, return_inverse=True)
    sketch = np.zeros((len(which), bins), np.uint64)
    filled = np.zeros((len(which), bins), bool)
    slot = _slot(value, bins)  # rises with the value, so the first of a run is its minimum
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (slot[1:] != slot[:-1])
    sketch[row[new], slot[new]] = value[new]
    filled[row[new], slot[new]] = True
    r, b = np.nonzero(~filled)
    for attempt in range(1, ATTEMPTS + 1):
        donor = _slot(mix((b.astype(np.uint64) << np.uint64(32)) ^ np.uint64(attempt) ^ _PICK_SEED), bins)
        ok = filled[r, donor]
        sketch[r[ok], b[ok]] = sketch[r[ok], donor[ok]]
        r, b = r[~ok], b[~ok]
        if not len(r):
            break
    for start, stop in zip(*runs(r)):
        have, empty = np.flatnonzero(filled[r[start]]), b[start:stop]
        rank = mix((empty.astype(np.uint64)[:, None] << np.uint64(32)) ^ have.astype(np.uint64)[None, :] ^ _REST_SEED)
        sketch[r[start], empty] = sketch[r[start], have[rank.argmin(axis=1)]]
    return which, sketch


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` bins."""
    bands = sketch.shape[1] // rows
    parts = sketch[:, :bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) ^ _BAND_SEED), (len(sketch), bands))
    for k in range(rows):
        key = chain(key, parts[:, :, k])
    return key


def _digests(text: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Set size of every text, and two 64-bit sums that tell different sets apart."""
    count = np.bincount(text, minlength=rows)
    end = np.cumsum(count)
    sums = []
    for seed in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(seed)))])
        sums.append((total[end] - total[end - count]).view(np.int64))
    return count, sums


def _sketches(docs: DataFrame, size: int, bins: int, rows: int) -> DataFrame:
    """id, ref, n (set size), d1 and d2 (digest of the set) and the band keys of every row."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, value = shingle_sets(part.column("text"), size)
                count, sums = _digests(text, value, part.num_rows)
                which, minima = signatures(text, value, bins)
                keys = band_keys(minima, rows).view(np.int64)
                ends = np.zeros(part.num_rows + 1, np.int32)
                ends[which + 1] = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.record_batch([part.column("id"), part.column("ref"), pa.array(count, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), lists],
                                      names=["id", "ref", "n", "d1", "d2", "keys"])

    return docs.mapInArrow(sketch, "id long, ref long, n long, d1 long, d2 long, keys array<long>")


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()


def _sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node and its sorted shingle hashes as bytes, for the given classes.

    A class is rebuilt from a row with its smallest id and the `ref` (hash of the text) that goes with it; other rows with that id
    have another ref, so an id that many rows share multiplies nothing.
    """
    wanted = classes.select("node", "n", "d1", "d2", "id", "ref").join(nodes, "node", "left_semi")
    keyed = lambda df: df.withColumn("id", F.coalesce("id", F.lit(0).cast("long")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: equal rows mostly lie together
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                text, value = shingle_sets(part.column("text"), size)
                count, sums = _digests(text, value, part.num_rows)
                own = (count == part.column("n").to_numpy()) & (sums[0] == part.column("d1").to_numpy()) \
                    & (sums[1] == part.column("d2").to_numpy())
                raw, cut = value.tobytes(), np.concatenate([[0], np.cumsum(count)]) * 8
                nodes, shingles = [], []
                for k, node in enumerate(part.column("node").to_pylist()):
                    if own[k] and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        shingles.append(raw[cut[k]:cut[k + 1]])
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(shingles, pa.binary())], names=["node", "shingles"])

    return keyed(docs).join(keyed(wanted), ["id", "ref"]).mapInArrow(sets, "node long, shingles binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) with 100 * |A and B| >= percent * |A or B|."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b") \
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
    return pairs.mapInArrow(compare, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for the nodes that have an edge.

    Each round merges every node into the smallest of itself and its neighbours and keeps only the edges between different
    merged nodes, so the graph shrinks; the rounds' maps are composed from the last, smallest one back.
    """
    rounds: list[DataFrame] = []
    left = _stored(spark, edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        into = _stored(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
        rounds.append(into)
        ends = left.join(into.select(F.col("node").alias("a"), F.col("label").alias("x")), "a") \
            .join(into.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        left = _stored(spark, ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return spark.createDataFrame([], "node long, label long")
    found = rounds.pop()
    while rounds:
        after = found.select(F.col("node").alias("label"), F.col("label").alias("to"))
        found = _stored(spark, rounds.pop().join(after, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return found


def _merged(spark: SparkSession, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after the links: components of the graph whose nodes are the labels so far."""
    between = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a") \
        .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(spark, between).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return _stored(spark, labels.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _mixed(spark: SparkSession, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their label and the bucket's most frequent one (top)."""
    tagged = members.select("key", "node", "n").join(labels, "node").select("key", "node", "n", "label")
    parts = tagged.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.count(F.lit(1)).alias("labels")) \
        .where("labels > 1").select("key", F.col("top.label").alias("top"))
    return _stored(spark, tagged.join(mixed, "key"), "open")


def _compare_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group: for every asker one link to each other component that has one in the group."""
    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        others = [r for r in rows if not r[1]]
        if not others:
            return []
        flat = np.concatenate([r[4] for r in others])
        sizes = np.array([len(r[4]) for r in others])
        owner = np.repeat(np.arange(len(others)), sizes)
        label = np.array([r[3] for r in others])
        out = []
        for _, asks, node, own, shingles in rows:
            if not asks or not len(shingles):
                continue
            at = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
            common = np.bincount(owner[shingles[at] == flat], minlength=len(others))
            good = np.flatnonzero((label != own) & (100 * common >= percent * (len(shingles) + sizes - common)))
            out += [(node, others[k][2]) for k in good[np.unique(label[good], return_index=True)[1]]]
        return out

    group, key = [], None
    for batch in batches:
        found = []
        columns = [batch.column(c).to_pylist() for c in ("home", "chunk", "part", "asks", "node", "label")]
        for (h, c, p, asks, node, label), raw in zip(zip(*columns), batch.column("shingles")):
            if (h, c, p) != key:
                found += links(group)
                group, key = [], (h, c, p)
            group.append((key, asks, node, label, np.frombuffer(raw.as_py(), np.uint64)))
        yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
    found = links(group)
    yield pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _block_links(spark: SparkSession, left: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that the stars left, from comparing the askers of every home with all its members."""
    members = left.select(F.col("top").alias("home"), "node", "label").distinct()
    members = members.withColumn("asks", F.col("label") != F.col("home"))
    count = members.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("chunks"), F.ceil(F.sum(F.col("asks").cast("int")) / BLOCK).alias("parts"))
    sized = _stored(spark, members.join(count, "home"), "homes")
    side = lambda n: F.pmod(F.xxhash64("node", "home"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    others = sized.select("home", side("chunks").alias("chunk"), all_of("parts").alias("part"), F.lit(False).alias("asks"), "node", "label")
    askers = sized.where("asks").select("home", all_of("chunks").alias("chunk"), side("parts").alias("part"), F.lit(True).alias("asks"), "node", "label")
    sets = _sets(texts, sized.select("node").distinct(), classes, size)
    rows = others.union(askers).join(sets, "node").repartition("home", "chunk", "part").sortWithinPartitions("home", "chunk", "part")
    return rows.mapInArrow(lambda it: _compare_blocks(it, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, `n_shingles` (size of its set) and `component_id` (smallest id reachable, itself included)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("ref"), F.col(text_col).alias("text"))
    sketched = _stored(spark, _sketches(source, shingle, bins, rows), "sketches")
    # classes: documents with the same set; `one` is a row of it, with the smallest id
    digest = ["n", "d1", "d2"]
    one = F.struct(F.col("id").isNull().alias("anon"), "id", "ref")
    grouped = sketched.where("n > 0").groupBy(*digest).agg(F.min_by("keys", one).alias("keys"), F.min(one).alias("one"))
    classes = _stored(spark, grouped.select(*digest, "keys", "one.id", "one.ref", F.monotonically_increasing_id().alias("node")), "classes")
    members = classes.select("node", "n", F.explode("keys").alias("key"))
    mask = F.xxhash64("key")  # ranks the members of a bucket; undone below, so the smallest rank names its member
    shared = members.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("r"), F.count(F.lit(1)).alias("m")) \
        .where("m > 1").select("key", F.col("r").bitwiseXOR(mask).alias("centre"), "m")
    bucketed = _stored(spark, members.join(shared, "key"), "buckets")  # only buckets of two and more
    star = _stored(spark, bucketed.where("node <> centre").select(
        F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), "star")
    links = _stored(spark, confirmed(star, _sets(source, _ends(star), classes, shingle), percent), "links")
    labels = bucketed.select("node").distinct().join(components(spark, links), "node", "left") \
        .select("node", F.coalesce("label", "node").alias("label"))
    labels = _stored(spark, labels, "labels")
    left = _mixed(spark, bucketed.where("m > 2"), labels)
    more = _stored(spark, _block_links(spark, left, source, classes, shingle, percent), "links")
    if not more.isEmpty():
        labels = _merged(spark, labels, more)
    named = labels.join(classes.select("node", F.col("id").alias("own")), "node")
    least = named.join(named.groupBy("label").agg(F.min("own").alias("least")), "label").select("node", "least")
    found = classes.select(*digest, "node", F.col("id").alias("own")).join(least, "node", "left") \
        .select(*digest, F.coalesce("least", "own").alias("component"))
    return sketched.select("id", *digest).join(found, digest, "left") \
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those whose component has a smaller id; all columns as they are.

    Documents are told apart by their id: rows that share an id stay or go together, and go only if each of them is linked to
    a smaller id. Rows without an id stay.
    """
    gone = "gone"
    while gone in {c.lower() for c in docs.columns}:  # a name of its own beside the columns that pass through
        gone += "_"
    found = near_duplicates(docs, id_col=id_col, **options).select(F.col(id_col).cast("long").alias("id"), "component_id")
    later = found.groupBy("id").agg(F.max("component_id").alias("c")).where("id <> c").select(F.col("id").alias(gone))
    return docs.join(later, F.col(id_col).cast("long") == F.col(gone), "left_anti")
