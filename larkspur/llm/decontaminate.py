"""Benchmark decontamination by the q-gram lemma.

Both sides are lower-cased (A-Z) and each run of white space becomes one space.  An item of n
bytes that lies in a document with k edits at most keeps n + 1 - q - k q of its q-grams, on
diagonals at most k apart.  The q-grams that a document shares with an item are counted in
overlapping bands of diagonals; bands that reach the bound are retained, and a banded alignment
verifies them.

Defined results: a null text has no leaks, nor does an empty one; null and empty items match
nothing; an item of under q bytes is not filtered: it matches exactly, between spaces, at every
place; repeated items each match; every copy of a document is marked; a very long text is
searched whole; regions that tie in start are in the order of their items; an empty table gives
no rows, an empty benchmark no leaks; other columns, whatever their names, pass through
unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, add_columns, as_bytes, durable, fresh, table

Q = 8
#: Edits allowed as a share of an item's bytes.
EDITS = 0.1
#: Bytes of benchmark text whose index one pass broadcasts, some 32 bytes for each; more items take more passes, one after another.
PASS_BYTES = 2 << 20

LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
_BITS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Between texts; in no UTF-8 text.
_GAP = b"\xff" * (2 * Q)


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split())


def grams(buffer: bytes) -> np.ndarray:
    """All q-grams as 64-bit integers, one for each start."""
    return np.ndarray((max(0, len(buffer) - Q + 1),), dtype="<u8", buffer=buffer, strides=(1,)) if len(buffer) >= Q else np.zeros(0, dtype=np.uint64)


def align(item: bytes, region: bytes, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """(edits, end) of the best alignment of the whole item within ``region``, if within budget.

    Only diagonals (region offset less item offset) from ``low - budget`` to ``high + budget``.
    """
    first, width = low - budget, high - low + 2 * budget + 1
    a, b = np.frombuffer(item, dtype=np.uint8), np.frombuffer(region, dtype=np.uint8)
    far = np.int64(1 << 30)
    steps = np.arange(width)
    at = steps + first
    row = np.where((at >= 0) & (at <= len(b)), 0, far)
    for i in range(1, len(a) + 1):
        at = steps + first + i
        inside = (at >= 0) & (at <= len(b))
        char = b[np.clip(at - 1, 0, max(len(b) - 1, 0))] if len(b) else np.zeros(width, dtype=np.uint8)
        change = np.where((at >= 1) & inside, row + (char != a[i - 1]), far)
        drop = np.append(row[1:] + 1, far)
        row = np.minimum(change, drop)
        row = np.where(inside, np.minimum.accumulate(np.where(inside, row, far) - steps) + steps, far)
        if row.min() > budget:
            return None
    best = int(np.argmin(row))
    return (int(row[best]), best + first + len(a)) if row[best] <= budget else None


class Items:
    """The q-grams of some benchmark items, ready for lookup."""

    def __init__(self, rows: list[tuple[int, bytes]], share: float) -> None:
        rows = sorted((i, normal(t)) for i, t in rows if i is not None and t is not None)
        self.short = [(i, t) for i, t in rows if 0 < len(t) < Q]
        rows = [(i, t) for i, t in rows if len(t) >= Q]
        self.ids, self.texts = [i for i, _ in rows], [t for _, t in rows]
        n = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.budget = np.minimum((n * share).astype(np.int64), np.maximum(0, (n - Q) // Q)) if len(n) else n
        self.least = n + 1 - Q - self.budget * Q
        every = [grams(t) for t in self.texts]
        keys = np.concatenate(every) if every else np.zeros(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(every)), [len(g) for g in every]) if every else np.zeros(0, dtype=np.int64)
        place = np.concatenate([np.arange(len(g)) for g in every]) if every else np.zeros(0, dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.keys, self.first, self.times = np.unique(keys[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[self.slot(self.keys)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MULTIPLIER) >> np.uint64(64 - _BITS)

    def shared(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place in the buffer, index of the q-gram) of every q-gram that some item has."""
        if not len(self.keys):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        g = grams(buffer)
        at = np.flatnonzero(self.seen[self.slot(g)])
        found = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[found] == g[at]
        return at[same], found[same]

    def leaks(self, texts: list[bytes]) -> list[list[dict]]:
        texts = [normal(t) for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        for d, t in enumerate(texts):
            for i, s in self.short:
                line, at = b" " + t + b" ", 0
                while (at := line.find(b" " + s + b" ", at)) >= 0:
                    out[d].append({"item_id": i, "start": at, "end": at + len(s), "edits": 0})
                    at += 1
        buffer = _GAP.join(texts)
        starts = np.cumsum([0, *(len(t) + len(_GAP) for t in texts)])[:-1]
        at, gram = self.shared(buffer)
        doc = np.searchsorted(starts, at, side="right") - 1
        # Ten times a typical text's hits are expanded at once.
        edges = [0]
        while edges[-1] < len(at):
            edges.append(min(len(at), int(np.searchsorted(doc, doc[min(len(at) - 1, edges[-1] + (1 << 18))], side="right"))))
        for a, b in zip(edges, edges[1:], strict=False):
            self._bands(texts, doc[a:b], at[a:b] - starts[doc[a:b]], gram[a:b], out)
        for x in out:
            x.sort(key=lambda m: (m["item_id"], m["start"]))
        return out

    def _bands(self, texts: list[bytes], doc: np.ndarray, at: np.ndarray, gram: np.ndarray, out: list[list[dict]]) -> None:
        many = self.times[gram]
        hit = np.repeat(np.arange(len(gram)), many)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many) + self.first[gram[hit]]
        item, place, doc, at = self.item[entry].astype(np.int64), self.place[entry].astype(np.int64), doc[hit], at[hit]
        pair = doc * len(self.ids) + item
        low = int(pair.min()) if len(pair) else 0
        enough = np.bincount(pair - low, minlength=1)[pair - low] >= self.least[item] if len(pair) and int(pair.max()) - low < 1 << 26 else np.ones(len(pair), dtype=bool)
        item, place, pair, at, doc = item[enough], place[enough], pair[enough], at[enough], doc[enough]
        if not len(pair):
            return
        diagonal = at - place
        width = self.budget[item] + 1  # two overlapping bands of twice this width hold any spread of k
        band = np.floor_divide(diagonal, width)
        key = np.concatenate((pair, pair))
        bands = np.concatenate((band, band - 1))
        n = len(pair)
        order = np.lexsort((bands, key))
        new = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (bands[order][1:] != bands[order][:-1]))))
        sizes = np.diff(np.append(new, len(order)))
        done: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for s in np.flatnonzero(sizes >= self.least[item[order[new] % n]]):
            rows = order[new[s] : new[s] + sizes[s]] % n
            i, d = int(item[rows[0]]), int(doc[rows[0]])
            if len(np.unique(place[rows])) < self.least[i]:
                continue
            self._verify(texts[d], d, i, int(diagonal[rows].min()), int(diagonal[rows].max()), done.setdefault((d, i), []), out)

    def _verify(self, text: bytes, d: int, i: int, low: int, high: int, had: list[tuple[int, int]], out: list[list[dict]]) -> None:
        item, k = self.texts[i], int(self.budget[i])
        a, b = max(0, low - k), min(len(text), high + len(item) + k)
        region = text[a:b]
        exact = region.find(item)
        if exact >= 0:
            edits, start, end = 0, a + exact, a + exact + len(item)
        else:
            found = align(item, region, low - a, high - a, k)
            if found is None:
                return
            edits, end = found[0], a + found[1]
            back = align(item[::-1], text[a:end][::-1], 0, 0, edits)
            start = end - back[1] if back else max(0, end - len(item))
        if any(start < y and x < end for x, y in had):
            return
        had.append((start, end))
        out[d].append({"item_id": self.ids[i], "start": start, "end": end, "edits": edits})


def passes(benchmark: DataFrame, text: str = "text", key: str = "item_id", limit: int = PASS_BYTES) -> list[DataFrame]:
    """The benchmark dealt by hash into parts whose text has a bounded size."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = -(-size * 2 // limit) if size > limit else 1
    rows = benchmark.select(F.col(key).cast("long").alias("i"), F.col(text).alias("t"))
    return [rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == p) if n > 1 else rows for p in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks", share: float = EDITS) -> DataFrame:
    """``docs`` with every region of its normalised text that holds a benchmark item.

    One scan without a shuffle for each bounded part of the benchmark; the parts' regions are added up.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    out, parts, had = docs, passes(benchmark), None
    for n, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(Items([(r.i, r.t.encode("utf-8", "replace")) for r in part.collect() if r.t is not None], share))
        name = fresh(out, "leaks_")

        def make(batch: pa.RecordBatch, shared=shared) -> list[pa.Array]:
            return [pa.array(shared.value.leaks(as_bytes(batch.column(text))), to_arrow_type(LEAKS))]

        out = add_columns(out, text, [T.StructField(name, LEAKS)], make)
        if had:
            out = out.withColumn(name, F.concat(had, name)).drop(had)
        had = name
        if n + 1 < len(parts):
            # What was found is written, so that no plan holds two parts' indexes.
            out = durable(out, "leaks")
            shared.unpersist()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.array_sort(had).alias(leaks))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.col("leaks.item_id")))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), ids.alias("item_ids"), F.size("leaks").cast("long").alias("n_regions"), F.col("leaks.start").alias("starts"), F.col("leaks.end").alias("ends"), F.col("leaks.edits").alias("edits"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark passage go, all copies of each.

    Null and empty texts stay; see the module for long texts, ties, empty tables and columns.
    """
    name = fresh(docs, "leaks")
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), leaks=name).where(F.size(name) == 0).drop(name)


QUERIES = {"op8_decontamination": op8_decontamination}
