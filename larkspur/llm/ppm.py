"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ``ORDER`` symbols with the counts of the symbols
that follow each, learned from all training texts.  A symbol that a context has not seen costs
the context's escape (method C: distinct / (total + distinct)), and the next shorter context
predicts it with all symbols excluded that longer ones have seen; below the empty context all
remaining symbols are alike.  An end symbol closes each text, so the probabilities of all texts
sum to 1.

Every context of the training texts counts.  Contexts are dealt to shards by their last three
symbols, so a shard has all longer forms of its contexts; counts after contexts of fewer symbols
are at most 257^3 numbers, which are broadcast.  A batch of documents sends each shard its
distinct contexts with the symbol that follows and their training counts; the shard adds all
batches' counts and sends back each one's probability.  The base score's word counts take the
same way, by range of the words' hashes.

Defined results: a null or empty text has one token, the end; without training texts every
count is 0 and the model is uniform; an empty table gives no rows; a null id counts as training;
rows that share an id, or repeat, are scored apart and alike; a very long text is one batch of
its own, some 100 bytes of memory for each of its bytes; no result depends on an order, so ties
do not matter; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_list, durable, held_out, interned, settle, slices, small_batches, table, words

ORDER = 5
END = 256
SYMBOLS = 257
#: Text of a batch of documents; training text for each shard.
BATCH_BYTES = 2 << 20
SHARD_BYTES = 3 << 20


def symbols(texts: list[bytes]) -> np.ndarray:
    """All texts as symbols, each closed by the end symbol."""
    n = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    out = np.full(int(n.sum()), END, dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(n) - 1] = False
    out[inside] = np.frombuffer(b"".join(texts), dtype=np.uint8)
    return out


@dataclass
class Trie:
    """``child[k][c, s]``: the context of order k + 1 that is context c of order k followed by s, or -1.

    ``counts[k][c]``: how often each symbol follows context c of order k.  No context holds the
    end symbol, so none reaches across two texts.
    """

    child: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    log: list[np.ndarray] = field(default_factory=list)
    steps: list[np.ndarray] = field(default_factory=list)

    def contexts(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """For each order the context before each symbol, or the number of that order's contexts."""
        before = np.zeros(len(text), dtype=np.int32)
        yield before
        for k, child in enumerate(self.child):
            n = int(child.max(initial=-1)) + 1
            # The context of order k + 1 before i is that of order k before i - 1, and symbol i - 1.
            if k == len(self.steps):
                self.steps.append(np.concatenate((np.where(child < 0, n, child), np.full((1, SYMBOLS), n))).astype(np.int32).ravel())
            now = np.empty(len(text), dtype=np.int32)
            now[:1] = n
            now[1:] = self.steps[k].take(before[:-1] * SYMBOLS + text[:-1])
            before = now
            yield before

    def size(self) -> int:
        """Contexts of the highest order."""
        return int(self.child[-1].max(initial=-1)) + 1 if self.child else 1

    def grow(self, counts: np.ndarray, last: bool) -> None:
        """Add the counts of the longest contexts; their extensions that occur become contexts."""
        counts = counts.astype(np.float64)
        self.counts.append(counts)
        if not last:
            occurs = counts > 0
            occurs[:, END] = False
            child = np.full(counts.shape, -1, dtype=np.int32)
            child[occurs] = np.arange(int(occurs.sum()))
            self.child.append(child)

    def finish(self) -> None:
        """log10 of each symbol's probability after each context."""
        shorter = self._shorter()
        done = []
        for k, counts in enumerate(self.counts):
            out = np.empty((len(counts), SYMBOLS), dtype=np.float32)
            for a in range(0, len(counts), 2048):
                out[a : a + 2048] = np.log10(self._blend(k, np.arange(a, min(a + 2048, len(counts))), shorter))
            done.append(out)
        self.log = done

    def _shorter(self) -> list[np.ndarray]:
        """For each order the context without its first symbol, in the next lower order."""
        strings: list[list[tuple[int, ...]]] = [[()]]
        for child in self.child:
            longer: list[tuple[int, ...]] = [()] * (int(child.max(initial=-1)) + 1)
            for c, s in np.argwhere(child >= 0):
                longer[child[c, s]] = (*strings[-1][c], int(s))
            strings.append(longer)
        out = [np.zeros(1, dtype=np.int64)]
        for k in range(1, len(strings)):
            index = {x: i for i, x in enumerate(strings[k - 1])}
            out.append(np.array([index.get(x[1:], -1) for x in strings[k]], dtype=np.int64))
        return out

    def _blend(self, order: int, at: np.ndarray, shorter: list[np.ndarray]) -> np.ndarray:
        p = np.zeros((len(at), SYMBOLS))
        free = np.ones((len(at), SYMBOLS), dtype=bool)
        mass = np.ones(len(at))
        for k in range(order, -1, -1):
            have = at >= 0
            counts = np.where(have[:, None] & free, self.counts[k][np.maximum(at, 0)], 0.0)
            total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
            left = free.sum(axis=1) - kinds
            under = np.where(left > 0, total + kinds, total)
            share = np.divide(mass, under, out=np.zeros_like(mass), where=under > 0)
            p += counts * share[:, None]
            mass = np.where(total > 0, np.where(left > 0, share * kinds, 0.0), mass)
            free &= counts == 0
            at = np.where(have, shorter[k][np.maximum(at, 0)], at) if k else at
        rest = free.sum(axis=1)
        p += free * np.divide(mass, rest, out=np.zeros_like(mass), where=rest > 0)[:, None]
        return p

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        text = symbols(texts)
        row, base = np.zeros(len(text), dtype=np.int32), 0
        for log, before in zip(self.log, self.contexts(text), strict=True):
            row = np.where(before < len(log), before + np.int32(base), row)
            base += len(log)
        out = self.flat.take(row.astype(np.int64) * SYMBOLS + text)
        ends = np.flatnonzero(text == END)
        return np.diff(np.concatenate(([0.0], np.cumsum(out, dtype=np.float64)[ends])))

    @cached_property
    def flat(self) -> np.ndarray:
        return np.concatenate(self.log).ravel()


#: Contexts whose counts travel together.
GROUP = 256
#: Tasks whose counts meet first, before all do.
TASKS = 32


def _grouped(counts: np.ndarray, task: int) -> pa.RecordBatch:
    """Flat counts as rows (group, tasks, blob of places and times) without zeros."""
    at = np.flatnonzero(counts)
    group = at // (GROUP * SYMBOLS)
    cuts = np.flatnonzero(np.diff(group)) + 1
    rows = [(int(g[0]), zstandard.compress(x.astype("<i8").tobytes() + counts[x].astype("<i8").tobytes(), 1)) for g, x in zip(np.split(group, cuts), np.split(at, cuts), strict=True) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([task // TASKS] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["g", "t", "blob"])


def _added(blobs: list[bytes], size: int, base: int = 0) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for blob in blobs:
        raw = np.frombuffer(zstandard.decompress(blob), dtype="<i8")
        out[raw[: len(raw) // 2] - base] += raw[len(raw) // 2 :]
    return out


def _sum_group(rows: pa.Table) -> pa.Table:
    g = rows.column("g")[0].as_py()
    base = g * GROUP * SYMBOLS
    sums = _added(rows.column("blob").to_pylist(), GROUP * SYMBOLS, base)
    at = np.flatnonzero(sums)
    blob = zstandard.compress((at + base).astype("<i8").tobytes() + sums[at].tobytes(), 1)
    return pa.table([pa.array([g], pa.int32()), rows.column("t").slice(0, 1), pa.array([blob], pa.binary())], names=["g", "t", "blob"])


def _counted(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sums over all tasks of what ``make`` counts in each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                new = make(symbols(as_bytes(part.column("text"))))
                sums = new.astype(np.int64) if sums is None else np.add(sums, new, out=sums)
        if sums is not None:
            yield _grouped(sums, TaskContext.get().partitionId())

    kind = "g int, t int, blob binary"
    got = rows.mapInArrow(run, kind).groupBy("g", "t").applyInArrow(_sum_group, kind).groupBy("g").applyInArrow(_sum_group, kind).toArrow()
    return _added(got.column("blob").to_pylist(), size)


def fit(docs: DataFrame, text: str = "text", order: int = ORDER) -> Trie:
    """A trie of all texts in memory: two orders in the first scan, then one scan for each longer order."""
    small_batches(docs.sparkSession)
    trie = Trie()
    rows = docs.select(F.col(text).alias("text"))
    low = min(order, 1)

    def short(sym: np.ndarray) -> np.ndarray:
        key, size = sym.astype(np.int64), SYMBOLS
        out = [np.bincount(key, minlength=size)]
        for _ in range(low):
            # A context of fewer symbols at a text's start is none of this order: its key holds an end.
            key, size = key[1:] + sym[: len(sym) - len(out)].astype(np.int64) * size, size * SYMBOLS
            out.append(np.bincount(key, minlength=size))
        return np.concatenate(out)

    sizes = [SYMBOLS ** (k + 1) for k in range(low + 1)]
    counts = np.split(_counted(rows, short, sum(sizes)), np.cumsum(sizes)[:-1])
    kept = np.zeros(1, dtype=np.int64)
    for k, c in enumerate(counts):
        trie.grow(c.reshape(-1, SYMBOLS)[kept], last=k == order)
        if k < order:
            context, symbol = np.nonzero(trie.child[-1] >= 0)
            kept = kept[context] * SYMBOLS + symbol
    for k in range(low + 1, order + 1):
        shared, n = docs.sparkSession.sparkContext.broadcast(trie.child), trie.size()

        def longer(sym: np.ndarray, shared=shared, n=n, own=Trie()) -> np.ndarray:
            own.child = shared.value
            *_, before = own.contexts(sym)
            has = np.flatnonzero(before < n)
            return np.bincount(before[has].astype(np.int64) * SYMBOLS + sym[has], minlength=n * SYMBOLS)

        trie.grow(_counted(rows, longer, n * SYMBOLS).reshape(-1, SYMBOLS), last=k == order)
    trie.finish()
    return trie


def grams(text: np.ndarray) -> np.ndarray:
    """Each symbol below the ``ORDER`` before it, the nearest on top, nine bits each; the end stands for what is before a text."""
    key, none = text.astype(np.int64), np.zeros(len(text), dtype=bool)
    for k in range(1, ORDER + 1):
        x = np.full(len(text), END, dtype=np.int64)
        x[k:] = text[:-k]
        none |= x == END
        x[none] = END
        key |= x << 9 * (ORDER + 1 - k)
    return key


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the last three symbols of the context."""
    last = (keys >> 9 * (ORDER - 2)).astype(np.uint64)
    return ((last * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


@dataclass
class Low:
    """Counts after contexts of no, one and two symbols: at most 257^3 numbers.

    ``pairs`` has each two symbols and the one that follows, as ``grams`` packs them, in order.
    """

    none: np.ndarray
    after: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def low_orders(model: Trie) -> Low:
    """What a trie of order 2 has counted."""
    after = np.zeros((SYMBOLS, SYMBOLS))
    has = np.flatnonzero(model.child[0][0] >= 0)
    after[has] = model.counts[1][model.child[0][0][has]]
    first = np.zeros(len(model.counts[1]), dtype=np.int64)
    first[model.child[0][0][has]] = has
    context, symbol = np.nonzero(model.child[1] >= 0)
    names = np.zeros(len(model.counts[2]), dtype=np.int64)
    names[model.child[1][context, symbol]] = symbol << 9 | first[context]
    row, symbol = np.nonzero(model.counts[2])
    pairs = names[row] << 9 | symbol
    order = np.argsort(pairs)
    return Low(model.counts[0][0], after, pairs[order], model.counts[2][row, symbol][order])


def gram_logs(keys: np.ndarray, counts: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of each gram, of a shard's distinct grams in order with their training counts."""
    symbol, oldest = keys & 511, lambda k: keys >> 9 * (ORDER + 1 - k) & 511
    none, after = low.none, low.after
    totals, kinds = {0: np.array([none.sum()]), 1: after.sum(axis=1)}, {0: np.array([(none > 0).sum()]), 1: (after > 0).sum(axis=1)}
    known, times, names = {}, {}, {}
    #: For a context of order k, what its symbols count in the context of order k - 1.
    covered = {0: np.zeros(1), 1: ((after > 0) * none).sum(axis=1)}

    def count(k: int, context: np.ndarray, s: np.ndarray) -> np.ndarray:
        if k < 2:
            return after[context, s] if k else none[s]
        if not len(known[k]):
            return np.zeros(len(s))
        want = context << 9 | s
        at = np.minimum(np.searchsorted(known[k], want), len(known[k]) - 1)
        return np.where(known[k][at] == want, times[k][at], 0.0)

    for k in range(2, ORDER + 1):
        if k == 2:
            known[k], times[k] = low.pairs, low.times
        else:
            has = (counts > 0) & (oldest(k) != END)
            known[k], of = np.unique(keys[has] >> 9 * (ORDER + 1 - k) << 9 | symbol[has], return_inverse=True)
            times[k] = np.bincount(of, weights=counts[has], minlength=len(known[k]))
        names[k], of = np.unique(known[k] >> 9, return_inverse=True)
        totals[k], kinds[k] = np.bincount(of, weights=times[k]), np.bincount(of)
        covered[k] = np.bincount(of, weights=count(k - 1, known[k] >> 18, known[k] & 511))

    p, mass, left = np.zeros(len(keys)), np.ones(len(keys)), np.ones(len(keys), dtype=bool)
    gone_kinds, gone = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(ORDER, -1, -1):
        context = keys >> 9 * (ORDER + 1 - k)
        if k < 2:
            at = context if k else np.zeros(len(keys), dtype=np.int64)
            there = totals[k][at] > 0
        elif not len(names[k]):
            continue
        else:
            at = np.minimum(np.searchsorted(names[k], context), len(names[k]) - 1)
            there = names[k][at] == context
        if k:
            there &= oldest(k) != END
        n, total, kind = count(k, context, symbol), totals[k][at] - gone, kinds[k][at]
        under = np.where(kind < SYMBOLS, total + kind - gone_kinds, total)
        hit = left & there & (n > 0)
        p[hit] = mass[hit] * n[hit] / under[hit]
        left &= ~hit
        miss = left & there & (total > 0)
        mass[miss] *= (kind - gone_kinds)[miss] / under[miss]
        gone_kinds, gone = np.where(there, kind, gone_kinds), np.where(there, covered[k][at], 0.0)
    p[left] = mass[left] / (SYMBOLS - kinds[0][0])
    return np.log10(p)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first, which compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str, count: int, at: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=width * count, offset=at).reshape(width, count).T).view(kind).ravel()


def _request(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Distinct keys in order and their training counts in a batch."""
    return zstandard.compress(_planes(np.diff(keys, prepend=keys.dtype.type(0)).astype("<u8")) + _planes(counts.astype("<u4")), 1)


def _requested(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(_unplanes(raw, "<u8", n), dtype=np.uint64), _unplanes(raw, "<u4", n, 8 * n)


#: ``part`` is the shard of words, from the number of shards on that of grams, or -1 for the documents themselves.
_ANSWER = "batch long, kinds long, blob binary, part int"


def answer(rows: pa.Table, shards: int, low: Low) -> pa.Table:
    """A shard: for each batch the training count of its words, or the log probability of its grams."""
    shard, names = rows.column("shard")[0].as_py(), rows.column("batch").to_pylist()
    found, counts = zip(*map(_requested, rows.column("blob").to_pylist()), strict=True)
    sizes = [len(x) for x in found]
    every, of = np.unique(np.concatenate(found), return_inverse=True)
    found = None
    total = np.bincount(of, weights=np.concatenate(counts), minlength=len(every))
    counts, kinds = None, 0
    if shard < shards:
        values, kinds = total.astype("<u8"), int((total > 0).sum())
    else:
        values = gram_logs(every.astype(np.int64), total, low).astype("<f4")
    out, at = [], 0
    for name, n in zip(names, sizes, strict=True):
        out.append((name, 0, zstandard.compress(_planes(values[of[at : at + n]]), 1), shard))
        at += n
    if kinds:
        out.append((-1 - shard, kinds, None, shard))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int32()))], names=["batch", "kinds", "blob", "part"])


@dataclass
class Batch:
    """Some documents, as they travel."""

    ids: list[int | None]
    held: np.ndarray
    texts: list[bytes]

    def pack(self) -> bytes:
        sizes = np.array([len(t) for t in self.texts], dtype="<i8")
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        return np.array([len(sizes)], dtype="<i8").tobytes() + null.tobytes() + self.held.tobytes() + ids.tobytes() + sizes.tobytes() + b"".join(self.texts)

    @staticmethod
    def unpack(blob: bytes) -> Batch:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
        null, held = np.frombuffer(raw, dtype=np.uint8, count=2 * n, offset=8).reshape(2, n)
        ids, sizes = np.frombuffer(raw, dtype="<i8", count=2 * n, offset=8 + 2 * n).reshape(2, n)
        ends = (np.cumsum(sizes) + 8 + 18 * n).tolist()
        return Batch([None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)], held, [raw[b - a : b] for a, b in zip(sizes.tolist(), ends, strict=True)])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct word hashes in order, each word's place among them, and the words of each document."""
        distinct, flat, counts = interned([words(t) for t in self.texts])
        hashes, of = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct)), return_inverse=True)
        return hashes, of[flat], counts

    def asked(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """(shard, blob) of its distinct words, then, from ``shards`` on, of its distinct grams."""
        hashes, flat, counts = self.words()
        train = np.repeat(self.held == 0, counts)
        many = np.bincount(flat[train], minlength=len(hashes))
        cuts = np.searchsorted(word_shard(hashes, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            yield int(s), _request(hashes[cuts[s] : cuts[s + 1]], many[cuts[s] : cuts[s + 1]])
        sizes = np.array([len(t) + 1 for t in self.texts], dtype=np.int64)
        key, uses = np.unique(grams(symbols(self.texts)) << 1 | np.repeat(self.held == 0, sizes), return_counts=True)
        new = np.concatenate(([True], key[1:] >> 1 != key[:-1] >> 1))
        many = np.bincount(np.cumsum(new) - 1, weights=uses * (key & 1))
        key = key[new] >> 1
        shard = shard_of(key, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            x = order[cuts[s] : cuts[s + 1]]
            yield int(s) + shards, _request(key[x].astype(np.uint64), many[x])


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def packed(docs: DataFrame) -> DataFrame:
    """Rows (batch, blob) of ``docs(id, text, held_out)``: whole documents, some 2 MB of text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                raw = Batch(part.column("id").to_pylist(), np.asarray(part.column("held_out").to_pylist(), dtype=np.uint8), as_bytes(part.column("text"))).pack()
                # Named by content; batches that are alike ask and get the same.
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(raw) >> 1], pa.int64()), pa.array([zstandard.compress(raw, 1)], pa.binary())], names=["batch", "blob"])

    return docs.mapInArrow(run, "batch long, blob binary")


def requests(batches_: DataFrame, shards: int) -> DataFrame:
    """Rows (shard, batch, blob): what each batch asks of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, blob in zip(rows.column("batch").to_pylist(), rows.column("blob"), strict=True):
                out = list(Batch.unpack(blob.as_py()).asked(shards))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([name] * len(out), pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["shard", "batch", "blob"])

    return batches_.mapInArrow(run, "shard int, batch long, blob binary")


_DOCS = "doc_id long, held_out boolean, n_words long, n_known long, log_sum double, score double, kinds long"


def add_shards(rows: pa.Table, shards: int) -> pa.Table:
    """A batch: its documents with what the shards answered; or a shard's number of distinct training words."""
    settle()
    blobs, parts = rows.column("blob"), rows.column("part").to_pylist()
    mine = [i for i, o in enumerate(parts) if o < 0]
    if not mine:
        none = [None] * rows.num_rows
        values = [none] * 6 + [rows.column("kinds").to_pylist()]
        return pa.table([pa.array(x, t) for x, t in zip(values, _KINDS, strict=True)], names=_NAMES)
    batch = Batch.unpack(blobs[mine[0]].as_py())
    # Batches that are alike share a name and each answer comes once for each of them.
    got = {o: i for i, o in enumerate(parts) if o >= 0}
    hashes, flat, counts = batch.words()
    cuts = np.searchsorted(word_shard(hashes, shards), np.arange(shards + 1))
    times = np.zeros(len(hashes))
    for s in np.flatnonzero(np.diff(cuts)):
        times[cuts[s] : cuts[s + 1]] = _unplanes(zstandard.decompress(blobs[got[int(s)]].as_py()), "<u8", int(cuts[s + 1] - cuts[s]))
    sums = by_list(np.log10(times + 1)[flat], counts)
    known = by_list((times > 0)[flat], counts).astype(np.int64)
    text = symbols(batch.texts)
    keys, of = np.unique(grams(text), return_inverse=True)
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    logs = np.zeros(len(keys))
    for s in np.flatnonzero(np.diff(cuts)):
        logs[order[cuts[s] : cuts[s + 1]]] = _unplanes(zstandard.decompress(blobs[got[int(s) + shards]].as_py()), "<f4", int(cuts[s + 1] - cuts[s]))
    score_ = np.diff(np.concatenate(([0.0], np.cumsum(logs[of])[text == END])))
    values = [batch.ids, batch.held.astype(bool), counts, known, sums, score_, [0] * len(counts)]
    one = pa.table([pa.array(x, t) for x, t in zip(values, _KINDS, strict=True)], names=_NAMES)
    return pa.concat_tables([one] * len(mine))


_NAMES = [x.split()[0] for x in _DOCS.split(", ")]
_KINDS = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", held=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), (held_out(key, 7, 2) if held is None else held).alias("held_out"))
    low = low_orders(fit(rows.where("not held_out"), order=2))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(low.none.sum()) // SHARD_BYTES)
    shared = spark.sparkContext.broadcast(low)

    def run(part: pa.Table) -> pa.Table:
        settle()
        return answer(part, shards, shared.value)

    whole = durable(packed(rows), "batches")
    answers = requests(whole, shards).groupBy("shard").applyInArrow(run, _ANSWER)
    both = answers.unionByName(whole.select("batch", F.lit(0).cast("long").alias("kinds"), "blob", F.lit(-1).alias("part")))
    out = durable(both.groupBy("batch").applyInArrow(lambda part: add_shards(part, shards), _DOCS), "sums")
    trained = F.col("held_out") == F.lit(False)
    sums = out.agg(F.sum("kinds"), F.count(F.when(trained, 1)), F.sum(F.when(trained, F.col("n_words")))).first()
    kinds, n_docs = sums[0] or 0, sums[1]
    n = (sums[2] or 0) + n_docs
    under = float(np.log10(n + kinds + (n_docs > 0) + 1))
    end = float(np.log10(n_docs + 1))
    tokens = F.col("n_words") + 1
    return out.where("n_words is not null").select("doc_id", "held_out", tokens.alias("n_tokens"), (F.col("n_known") + (1 if n_docs else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("log_sum") + F.lit(end) - tokens * F.lit(under)).alias("base_score"), "score")


def op4_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ppm_scoring": op4_ppm_scoring}
