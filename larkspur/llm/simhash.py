"""Near duplicates by SimHash fingerprints and BK-trees.

Every document gets a 64-bit fingerprint over its word shingles.  Distinct fingerprints are
dealt to shards by pairs of equal bit bands: of ``bands`` bands, a difference of at most r bits
leaves ``bands - r`` bands equal, so each link meets in some shard.  In a shard a BK-tree (the
children of a node keyed by their Hamming distance to it) is searched along the edges that the
radius allows.  A tree is built in the task that holds its shard, as no proven size would let it
be broadcast.  Shards give the star of each group they find, not all its pairs, and the stars
are joined into components.

By similarity (the pipeline's stage) two documents are linked if the Jaccard similarity of their
sets of five-word shingles is 0.8 or more.  A 64-bit fingerprint cannot bound that: such pairs
differ in some ten bits and more.  So candidates share all minima of one of ``BANDS`` bands of
``ROWS`` min-hashes, which a pair of similarity 0.8 fails with probability (1 - 0.8^5)^32 = 3e-6.
Documents that candidates connect make a block, whose texts meet in one task; there the exact
similarity decides.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link
to one another; equal fingerprints are one class, and a bit that half of the hashes have is not
set; a null id takes no part and gets a null component; rows that share an id, repeated ones too,
are one document; a very long text is hashed whole; an empty table gives no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, durable, slices, small_batches, table, words
from .components import components

SEED = 42
#: Fingerprints that a shard holds on average, at most.
SHARD = 64
#: Words of a shingle where similarity counts, and min-hashes: bands of so many rows.
WORDS, BANDS, ROWS = 5, 32, 5
_FLIP, _TIMES = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of each word shingle of a text in order; a text of fewer words is one shingle, no word none."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(found)
    n = len(found)
    if n <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    ends = list(accumulate(map(len, found)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends[: n - shingle]))]
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(line[a : ends[i + shingle - 1] + i + shingle - 1], SEED) for i, a in enumerate(starts)], dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """Bit majority over hashes; 0 without any."""
    h = h.astype(">u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bit majority over the XXH64 of all word shingles of a text; 0 without words."""
    return majority(shingles(text, shingle))


def bands(h: np.ndarray) -> np.ndarray:
    """For each band a hash of its min-hashes over a set of shingles; none for an empty set."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(h), 256):
        np.minimum(least, ((h[None, at : at + 256] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return _signed([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))])


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each in order."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed 64-bit integer."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = _signed([fingerprint(t, shingle) for t in as_bytes(part.column("text"))])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    return rows.mapInArrow(run, schema)


class BKTree:
    """A BK-tree over 64-bit integers whose found nodes can be taken out."""

    def __init__(self, values: list[int]) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        self.parent = [-1] * len(values)
        self.alive = [1] * len(values)  # nodes not taken, at and below
        self.taken = [False] * len(values)
        for n in range(1, len(values)):
            at = 0
            while True:
                self.alive[at] += 1
                d = (values[at] ^ values[n]).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = n
                    self.parent[n] = at
                    break
                at = below

    def take(self, n: int) -> None:
        self.taken[n] = True
        while n >= 0:
            self.alive[n] -= 1
            n = self.parent[n]

    def near(self, value: int, radius: int) -> list[int]:
        """The nodes not taken that are within ``radius``; follows only edges that can hold one."""
        out, todo = [], [0] if self.alive and self.alive[0] else []
        while todo:
            n = todo.pop()
            d = (self.values[n] ^ value).bit_count()
            if d <= radius and not self.taken[n]:
                out.append(n)
            for edge, child in self.children[n].items():
                if d - radius <= edge <= d + radius and self.alive[child]:
                    todo.append(child)
        return out


def stars(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(first, other) for the members of each group of values linked within ``radius``."""
    if len(values) == 2:
        return [(0, 1)] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, at, out = BKTree(values), list(range(len(values))), []
    place = list(at)  # of each value in the tree
    done = [False] * len(values)
    for first in range(len(values)):
        if done[first]:
            continue
        done[first] = True
        tree.take(place[first])
        todo = [first]
        while todo:
            for n in tree.near(values[todo.pop()], radius):
                tree.take(n)
                done[at[n]] = True
                todo.append(at[n])
                out.append((first, at[n]))
            if tree.alive and tree.alive[0] * 2 < len(tree.values) and len(tree.values) > 64:
                # Most of the tree is taken: what is left gets a new one.
                at = [n for n, t in zip(at, tree.taken, strict=True) if not t]
                tree = BKTree([values[n] for n in at])
                for i, n in enumerate(at):
                    place[n] = i
    return out


def band_keys(bands: int, radius: int) -> list[tuple[int, ...]]:
    """Masks over 64 bits: every choice of bands that a difference of ``radius`` bits may leave equal."""
    cuts = [64 * b // bands for b in range(bands + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, bands - radius)]


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): stars over class ids that connect all ``classes(fp, id)`` linked within ``radius``."""
    n = classes.count()
    bands = radius + 1
    while bands < radius + 5 and n > SHARD << (64 * (bands - radius) // bands):
        bands += 1
    masks = band_keys(bands, radius)
    deal = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")).alias("k")) for i, m in enumerate(masks)]))
    dealt = classes.select("fp", "id", deal.alias("s")).select(F.xxhash64("s.m", "s.k").alias("shard"), "s.m", "s.k", "fp", "id")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "m", "k", "id").drop("shard")
    schema = T.StructType([T.StructField("u", classes.schema["id"].dataType), T.StructField("v", classes.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the shard that may go on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            m, k = batch.column("m").to_numpy(), batch.column("k").to_numpy()
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            if held and (m[0], k[0]) != last:
                yield from shards(pa.Table.from_batches(held), np.zeros(0, dtype=np.int64))
                held = []
            if len(cut):
                head = sum(b.num_rows for b in held)
                yield from shards(pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))]), cut[:-1] + head)
                held, batch = [], batch.slice(int(cut[-1]))
            held.append(batch)
            last = (m[-1], k[-1])
        if held:
            yield from shards(pa.Table.from_batches(held), np.zeros(0, dtype=np.int64))

    def shards(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, ids = rows.column("fp").to_numpy().view(np.uint64), rows.column("id").to_numpy()
        edges = np.concatenate(([0], cuts, [len(fps)])).astype(np.int64)
        found: list[tuple[int, int]] = []
        for s in np.flatnonzero(np.diff(edges) > 1):
            a, b = int(edges[s]), int(edges[s + 1])
            found += [(a + x, a + y) for x, y in stars(fps[a:b].tolist(), radius)]
        if found:
            at = np.array(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["u", "v"])

    return dealt.mapInArrow(run, schema)


def marks(docs: DataFrame, text: str, key: str, shingle: int) -> DataFrame:
    """(id, fp, same, bands): fingerprint, digest of the set of five-word shingles and its bands, of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps, same, found = [], [], []
                for t in as_bytes(part.column("text")):
                    h = shingles(t, WORDS)
                    fps.append(majority(h) if shingle == WORDS else fingerprint(t, shingle))
                    h = np.unique(h)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    found.append(bands(h))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(_signed(fps)), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def similar(texts: list[bytes], least: float) -> list[tuple[int, int]]:
    """Links that connect all texts of a block that share a band and have the similarity; pairs connected already are left out."""
    sets = [np.unique(shingles(t, WORDS)) for t in texts]
    root, out = list(range(len(sets))), []
    buckets: dict[int, dict[int, list[int]]] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, mine in enumerate(sets):
        seen: set[int] = set()
        held = [buckets.setdefault(k, {}) for k in bands(mine).tolist()]
        for bucket in held:
            for r in list(bucket):
                if find(r) == find(i):
                    continue
                for j in bucket[r]:
                    if j in seen:
                        continue
                    seen.add(j)
                    if similarity_of(sets[j], mine) >= least:
                        root[find(i)] = find(r)
                        out.append((j, i))
                        break
        for bucket in held:
            for r in [r for r in bucket if find(r) != r]:
                bucket.setdefault(find(r), []).extend(bucket.pop(r))
            bucket.setdefault(find(i), []).append(i)
    return out


def similar_links(docs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect all ``classes(id, bands)`` whose texts in ``docs(id, text)`` have the similarity."""
    keys = classes.select("id", F.explode("bands").alias("k"))
    first = keys.groupBy("k").agg(F.min("id").alias("u"), F.count("*").alias("n")).where("n > 1").select("k", "u")
    blocks = durable(components(keys.join(first, "k").where("id <> u").select("u", F.col("id").alias("v")).distinct()), "blocks")
    blocks = blocks.select(F.col("node").alias("id"), F.col("component").alias("block")).distinct()
    kind = classes.schema["id"].dataType
    schema = T.StructType([T.StructField("u", kind), T.StructField("v", kind)])

    def run(rows: pa.Table) -> pa.Table:
        ids, texts = rows.column("id"), [t for c in rows.column("text").chunks for t in as_bytes(c)]
        found = np.array(similar(texts, least), dtype=np.int64).reshape(-1, 2)
        return pa.table([ids.take(pa.array(found[:, 0])), ids.take(pa.array(found[:, 1]))], names=["u", "v"])

    return docs.join(blocks, "id").select("block", "id", "text").groupBy("block").applyInArrow(run, schema)


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, radius: int = 4, similarity: float | None = 0.8) -> DataFrame:
    """(id, fp, component): every document's fingerprint and the smallest id it can reach.

    Links are pairs of that similarity of five-word shingles; without one, pairs of fingerprints
    within ``radius``.
    """
    by = "fp" if similarity is None else "same"
    marked = durable(fingerprints(docs, text, key, shingle) if similarity is None else marks(docs, text, key, shingle), "fingerprints")
    known = marked.where("id is not null").groupBy(by)
    if similarity is None:
        classes = durable(known.agg(F.min("id").alias("id")), "classes")
        found = components(links(classes, radius))
    else:
        classes = durable(known.agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "classes")
        rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        found = components(similar_links(rows, classes, similarity))
    joined = classes.join(found, classes["id"] == found["node"], "left").select(by, F.coalesce("component", "id").alias("component"))
    out = marked.join(joined, by, "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"), similarity=None)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (similarity 0.8) the document with the smallest id stays.

    Rows that share that id, repeated ones too, all stay, as do rows with a null id; texts without
    words are one group; see the module for long texts and an empty table; all columns are kept.
    """
    gone = groups(docs, shingle=WORDS).where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
