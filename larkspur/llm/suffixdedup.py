"""Repeats across documents by an enhanced suffix array and its common-prefix interval tree.

All strings of ``LENGTH`` bytes (windows) of all documents are covered, as follows.

1. Every window has an anchor: the least hash of the 20-byte strings in it.  Equal windows have
   equal anchors, and neighbouring windows mostly share one; such a run of windows is a segment.
2. Each part of the documents (some ``PART_BYTES`` of text) sends its distinct anchors, by range
   of the hash, to shards, which answer with one bit for each: does another document have it too?
3. The distinct segments of such anchors go to the shards, with their bytes and the least and
   greatest id that has them in the part, so a shard's load does not depend on how often a
   segment occurs.
4. A shard sorts the suffixes of its distinct segments by prefix doubling, takes the common
   prefixes of neighbours, and scans them with a stack: every interval of the tree is a repeat.
   An interval whose places can all be extended by one same byte to the left is a part of
   another repeat and is dropped before the scan.
5. The repeats go back to the parts, with the least id of each; a part has the places.

Segments bound a repeat in a shard, so a long repeat is a chain of overlapping ones.  Where all
segments of an anchor are equal, they are the one repeat (a leaf of the tree) and need no sorting.

Defined results: a null text is empty; a document with a null id takes no part; rows that share
an id are one document, so none of them removes from another, and each row loses what a smaller
id has of its own text; repeated rows get repeated results; texts that tie (equal bytes) are told
apart by id alone; an empty table gives no rows; texts of under ``LENGTH`` bytes lose nothing; a
very long text is hashed in pieces but stays in one part; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, settle, small_batches, table

LENGTH = 50
ANCHOR = 20
#: Windows of a segment, at most; with it no segment is longer than ``DEPTH`` bytes.
RUN = 63
DEPTH = RUN + LENGTH - 1
#: Bytes of a document hashed at once.
PIECE = 1 << 20
#: Bytes of segments sorted at once, but for the segments of one anchor, which stay together.
SORTED = 1 << 19
#: Text of a part of the documents, on average.
PART_BYTES = 6 << 20
#: Shards for each part of the documents; a shard is the larger in memory.
SHARDS = 4
#: Bytes of an anchor that are compared in step 2; a chance hit only costs time.
KEY_BYTES = 6

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _hashes(buffer: bytes) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes from every byte on."""
    g = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    m = len(buffer) - ANCHOR + 1
    h = g[:m] * _C[0]
    for at, c in ((8, _C[1]), (ANCHOR - 8, _C[2])):
        h ^= h >> np.uint64(29)
        h *= c
        h += g[at : at + m]
    h ^= h >> np.uint64(32)
    h *= _C[0]
    h ^= h >> np.uint64(29)
    return h


def _window_least(h: np.ndarray) -> np.ndarray:
    width, w = LENGTH - ANCHOR + 1, 1
    while 2 * w <= width:
        h = np.minimum(h[:-w], h[w:])
        w *= 2
    h = np.minimum(h[: len(h) - (width - w)], h[width - w :]) if width > w else h
    # The least of many hashes is small; spread over all numbers, it deals evenly to shards.
    h = (h ^ h >> np.uint64(31)) * _C[1]
    return (h ^ h >> np.uint64(33)) * _C[0]


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, windows, anchor) of every segment of every text."""
    out: list[tuple[np.ndarray, ...]] = []
    hand: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal hand, held
        if not hand:
            return
        buffer = b"".join(p for _, _, p in hand)
        least = _window_least(_hashes(buffer))
        sizes = np.array([len(p) for _, _, p in hand], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        inside = np.zeros(len(buffer) + 1, dtype=np.int8)
        inside[starts] = 1
        np.subtract.at(inside, starts + sizes - LENGTH + 1, 1)
        valid = np.cumsum(inside[: len(least)], dtype=np.int8) > 0
        first = np.zeros(len(buffer), dtype=bool)
        first[starts] = True
        new = valid & (first[: len(least)] | np.concatenate(([True], least[1:] != least[:-1])))
        at = np.flatnonzero(new)
        piece = np.searchsorted(starts, at, side="right") - 1
        end = np.minimum(np.append(at[1:], len(buffer)), starts[piece] + sizes[piece] - LENGTH + 1)
        runs = end - at
        if len(runs) and runs.max() > RUN:
            many = -(-runs // RUN)
            row = np.repeat(np.arange(len(at)), many)
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            at, runs, piece = at[row] + part * RUN, np.minimum(runs[row] - part * RUN, RUN), piece[row]
        text = np.array([t for t, _, _ in hand], dtype=np.int64)
        base = np.array([b for _, b, _ in hand], dtype=np.int64)
        out.append((text[piece], base[piece] + at - starts[piece], runs, least[at]))
        hand, held = [], 0

    for n, text in enumerate(texts):
        for a in range(0, len(text) - LENGTH + 1, PIECE):
            p = text[a : a + PIECE + LENGTH - 1]
            hand.append((n, a, p))
            held += len(p)
            if held >= PIECE:
                flush()
    flush()
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty, empty.astype(np.uint64))


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _key_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _keys(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), dtype=np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEY_BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF ^ ((1 << (64 - 8 * KEY_BYTES)) - 1))


class Part:
    """The documents of one part, in an order that does not depend on how they came."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = rows.column("id").to_numpy()
        self.texts = as_bytes(rows.column("text").combine_chunks())
        self.text, self.start, self.runs, self.anchor = segments(self.texts)

    def asked(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each shard its segments here, their distinct keys, and each segment's key."""
        shard = _shard(self.anchor, shards)
        order = np.argsort(shard, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            keys, of = np.unique(self.anchor[rows] & _MASK, return_inverse=True)
            yield int(shard[rows[0]]), rows, keys, of

    def contents(self, rows: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The distinct bytes of some segments, and each one's place among them."""
        index: dict[bytes, int] = {}
        of = np.zeros(len(rows), dtype=np.int32)
        for i, (t, a, n) in enumerate(zip(self.text[rows].tolist(), self.start[rows].tolist(), self.runs[rows].tolist(), strict=True)):
            of[i] = index.setdefault(self.texts[t][a : a + n + LENGTH - 1], len(index))
        return list(index), of

    def places(self, spans: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(spans, segments): which segments here have the content of which of ``spans``, in batches.

        A span names its content by the first segment that has it.
        """
        heads, of = np.unique(spans[0], return_inverse=True)
        mine = np.flatnonzero(np.isin(self.anchor, self.anchor[heads]))
        _, content = self.contents(mine)
        order = np.argsort(content, kind="stable")
        first = np.searchsorted(content[order], np.arange(int(content.max(initial=-1)) + 2))
        wanted = content[np.searchsorted(mine, heads)][of]
        many = first[wanted + 1] - first[wanted]
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, side="right")))
            row = np.repeat(np.arange(at, to), many[at:to])
            shift = np.arange(len(row)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
            yield row, mine[order[first[wanted[row]] + shift]]
            at = to


#: Places that are worked on at once.
PLACES = 1 << 18


def _ask(shards: int):
    def run(rows: pa.Table) -> pa.Table:
        settle()
        part, out = rows.column("part")[0].as_py(), []
        docs = Part(rows)
        for s, mine, keys, of in docs.asked(shards):
            ids = docs.ids[docs.text[mine]]
            low = np.full(len(keys), np.iinfo(np.int64).max)
            high = np.full(len(keys), np.iinfo(np.int64).min)
            np.minimum.at(low, of, ids)
            np.maximum.at(high, of, ids)
            out.append((s, part, _key_bytes(keys), np.packbits(low != high).tobytes()))
        return _table(out, ["shard", "part", "keys", "many"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()])

    return run


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _answer(rows: pa.Table) -> pa.Table:
    shard = rows.column("shard")[0].as_py()
    parts = rows.column("part").to_pylist()
    keys = [_keys(x) for x in rows.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    every = np.concatenate(keys)
    many = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(rows.column("many").to_pylist(), sizes, strict=True)]).astype(bool)
    _, of, times = np.unique(every, return_inverse=True, return_counts=True)
    repeated = times > 1
    repeated[of[many]] = True
    cut = np.split(repeated[of], np.cumsum(sizes)[:-1])
    return _table([(p, shard, np.packbits(bits).tobytes()) for p, bits in zip(parts, cut, strict=True) if bits.any()], ["part", "shard", "bits"], [pa.int32(), pa.int32(), pa.binary()])


def _send(shards: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        settle()
        out = []
        if rows.num_rows and answers.num_rows:
            part, docs = rows.column("part")[0].as_py(), Part(rows)
            bits = dict(zip(answers.column("shard").to_pylist(), answers.column("bits").to_pylist(), strict=True))
            for s, mine, keys, of in docs.asked(shards):
                if s not in bits:
                    continue
                mine = mine[np.unpackbits(np.frombuffer(bits[s], dtype=np.uint8), count=len(keys)).astype(bool)[of]]
                contents, seg = docs.contents(mine)
                ids = docs.ids[docs.text[mine]]
                low, high = np.full(len(contents), np.iinfo(np.int64).max), np.full(len(contents), np.iinfo(np.int64).min)
                np.minimum.at(low, seg, ids)
                np.maximum.at(high, seg, ids)
                first = mine[np.unique(seg, return_index=True)[1]]
                head = np.array([len(first)], dtype="<i8").tobytes()
                raw = head + docs.anchor[first].astype("<u8").tobytes() + low.astype("<i8").tobytes() + high.astype("<i8").tobytes() + first.astype("<i4").tobytes() + docs.runs[first].astype(np.uint8).tobytes() + b"".join(contents)
                out.append((s, part, zstandard.compress(raw, 1)))
        return _table(out, ["shard", "part", "blob"], [pa.int32(), pa.int32(), pa.binary()])

    return run


def _opened(blob: bytes) -> tuple:
    """(anchor, least id, greatest id, first segment, windows) of each content, and the contents."""
    raw = zstandard.decompress(blob)
    k = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    at, out = 8, []
    for kind in ("<u8", "<i8", "<i8", "<i4", np.uint8):
        out.append(np.frombuffer(raw, dtype=kind, count=k, offset=at))
        at += out[-1].nbytes
    ends = at + np.cumsum(out[-1].astype(np.int64) + LENGTH - 1)
    contents = [raw[a:b] for a, b in zip([at, *ends[:-1].tolist()], ends.tolist(), strict=True)] if k else []
    return *out, contents


class SuffixArray:
    """The suffixes of some segments that have at least ``LENGTH`` bytes, sorted, with common prefixes."""

    def __init__(self, contents: list[bytes]) -> None:
        sizes = np.array([len(c) for c in contents], dtype=np.int64)
        text = np.frombuffer(b"".join(contents), dtype=np.uint8)
        n = len(text)
        begin = np.cumsum(sizes) - sizes
        self.left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes to the segment's end
        # Seven bytes a key, 0 beyond the end, then doubling: ranks of 7, 14, 28, 56 and 112 bytes.
        key = np.zeros(n, dtype=np.uint64)
        for t in range(7):
            char = np.zeros(n, dtype=np.uint64)
            char[: max(0, n - t)] = text[t:].astype(np.uint64) + np.uint64(1)
            char[self.left <= t] = 0
            key = key << np.uint64(9) | char
        self.key = key
        ranks = [self._rank(key)]
        width = 7
        while width < DEPTH:
            r = ranks[-1]
            next_ = np.zeros(n, dtype=np.uint64)
            next_[: max(0, n - width)] = r[width:]
            next_[self.left <= width] = 0
            ranks.append(self._rank(r << np.uint64(32) | next_))
            width *= 2
        offset = np.arange(n) - np.repeat(begin, sizes)
        windows = np.flatnonzero(self.left >= LENGTH)
        order = np.argsort(ranks[-1][windows], kind="stable")
        self.suffix = windows[order]
        self.segment = np.repeat(np.arange(len(contents)), sizes)[self.suffix]
        self.offset = offset[self.suffix]
        self.before = np.where(self.offset > 0, text[np.maximum(self.suffix - 1, 0)].astype(np.int16), -1)
        self.common = self._common(ranks)

    @staticmethod
    def _rank(key: np.ndarray) -> np.ndarray:
        """Ranks from 1, as 64-bit integers."""
        order = np.argsort(key)
        sorted_ = key[order]
        rank = np.empty(len(key), dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1]))[: len(key)]).astype(np.uint64)
        return rank

    def _common(self, ranks: list[np.ndarray]) -> np.ndarray:
        """Common prefix of each suffix and the one before it."""
        a, b = self.suffix[:-1], self.suffix[1:]
        most = np.minimum(self.left[a], self.left[b])
        n = len(self.key)
        got = np.zeros(len(a), dtype=np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            width = 7 << level
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += np.where((got < most) & (ranks[level][x] == ranks[level][y]), width, 0)
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        rest = np.where(got < most, self.key[x] ^ self.key[y], 0)
        for t in range(7):
            same = (rest >> np.uint64(9 * (6 - t))) == 0
            got += np.where((got < most) & same, 1, 0)
        return np.concatenate(([0], np.minimum(got, most)))

    def maximal(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of each interval that no one byte extends to the left.

        ``first`` and ``last`` are places in the sorted suffixes.  Where a segment begins, what
        stands before is in another shard, which counts as a difference.
        """
        n = len(self.suffix)
        deep = self.common >= LENGTH
        starts = np.flatnonzero(~deep)
        ends = np.append(starts[1:], n)
        keep = ends - starts > 1
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return
        edges = np.stack([starts, ends], axis=1).ravel()
        edges = np.minimum(edges, n - 1)
        low = np.minimum.reduceat(self.before, edges)[::2]
        high = np.maximum.reduceat(self.before, edges)[::2]
        last = ends == n  # reduceat at the clipped end leaves out the last suffix
        low[last] = np.minimum(low[last], self.before[-1])
        high[last] = np.maximum(high[last], self.before[-1])
        for s in np.flatnonzero((low < 0) | (low != high)):
            a, b = int(starts[s]), int(ends[s])
            if b - a == 2:
                yield int(self.common[a + 1]), a, a + 1
                continue
            common, before = self.common[a:b].tolist(), self.before[a:b].tolist()
            # Each entry: length, first, least and greatest byte before.
            stack: list[list[int]] = []
            for i in range(1, b - a + 1):
                now = common[i] if i < b - a else 0
                first, low_, high_ = i - 1, before[i - 1], before[i - 1]
                while stack and stack[-1][0] > now:
                    length, first, x, y = stack.pop()
                    low_, high_ = min(low_, x), max(high_, y)
                    if low_ < 0 or low_ != high_:
                        yield length, a + first, a + i - 1
                if stack and stack[-1][0] == now:
                    stack[-1][2], stack[-1][3] = min(stack[-1][2], low_), max(stack[-1][3], high_)
                elif now:
                    stack.append([now, first, low_, high_])


def _batches(segments_: np.ndarray, anchor: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """``segments_``, in the order of their anchors, in runs of about ``SORTED`` bytes that split no anchor."""
    ends = np.append(np.flatnonzero(np.diff(anchor)) + 1, len(anchor)) if len(anchor) else np.zeros(0, dtype=np.int64)
    bytes_, at = np.cumsum(size), 0
    while at < len(segments_):
        done = bytes_[at - 1] if at else 0
        to = ends[min(np.searchsorted(bytes_[ends - 1], done + SORTED), len(ends) - 1)]
        yield segments_[at:to]
        at = int(to)


@dataclass
class Members:
    """Of some repeats, every content of a part that has it."""

    repeat: np.ndarray
    length: np.ndarray
    #: Place of the repeat in the content.
    shift: np.ndarray
    #: Which blob, and the first segment with the content there.
    origin: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray


def shard_repeats(blobs: list[bytes]) -> Iterator[Members]:
    """Every repeat of a shard, in batches that split none."""
    index: dict[bytes, int] = {}
    anchors: list[np.ndarray] = []
    of_, low_, high_, first_, origin_ = [], [], [], [], []
    for o, blob in enumerate(blobs):
        anchor, low, high, head, _, contents = _opened(blob)
        known = len(index)
        here = np.fromiter((index.setdefault(c, len(index)) for c in contents), dtype=np.int32, count=len(contents))
        anchors.append(anchor[here >= known])  # contents of one blob are distinct
        of_.append(here)
        low_.append(low)
        high_.append(high)
        first_.append(head)
        origin_.append(np.full(len(here), o, dtype=np.int32))
    contents = list(index)
    del index
    seg, low, high, head, origin = (np.concatenate(x) for x in (of_, low_, high_, first_, origin_))
    del of_, low_, high_, first_, origin_
    order = np.argsort(seg, kind="stable")
    first = np.searchsorted(seg[order], np.arange(len(contents) + 1))
    low, high, head, origin = low[order], high[order], head[order], origin[order]
    size = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    _, of, times = np.unique(np.concatenate(anchors), return_inverse=True, return_counts=True)
    alone = times[of] == 1
    done = 0

    def members(length: np.ndarray, count: np.ndarray, where: np.ndarray, shift: np.ndarray) -> Members:
        """Of repeats in ``count`` distinct contents each, all that have those contents."""
        nonlocal done
        many = first[where + 1] - first[where]
        row = np.repeat(np.arange(len(where)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[where[row]]
        repeat = np.repeat(np.arange(len(count)), count)[row]
        out = Members(repeat + done, length[repeat], shift[row], origin[at], head[at], low[at], high[at])
        done += len(count)
        return out

    # A content that several documents have is a repeat, whatever overlaps it.
    whole = np.flatnonzero(np.minimum.reduceat(low, first[:-1]) < np.maximum.reduceat(high, first[:-1])) if len(contents) else np.zeros(0, dtype=np.int64)
    for at in range(0, len(whole), 4_000):
        some = whole[at : at + 4_000]
        yield members(size[some], np.ones(len(some), dtype=np.int64), some, np.zeros(len(some), dtype=np.int64))
    mixed = np.flatnonzero(~alone)
    mixed = mixed[np.argsort(of[mixed], kind="stable")]
    for some in _batches(mixed, of[mixed], size[mixed]):
        array = SuffixArray([contents[s] for s in some])
        found = np.array(list(array.maximal()), dtype=np.int64).reshape(-1, 3)
        count = found[:, 2] - found[:, 1] + 1
        # Some repeats at a time: nested ones name the same places again.
        for rows in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum(count) // PLACES)) + 1) if len(found) else []:
            n = count[rows]
            at = np.repeat(found[rows, 1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield members(found[rows, 0], n, some[array.segment[at]], array.offset[at])


def _returned(origin: np.ndarray, spans: np.ndarray, parts: list[int], kind: str) -> list[tuple]:
    """(part, blob) of ``spans``, a column for each, by origin."""
    order = np.argsort(origin, kind="stable")
    cuts = np.searchsorted(origin[order], np.arange(len(parts) + 1))
    return [(p, zstandard.compress(np.ascontiguousarray(spans[:, order[a:b]]).astype(kind).tobytes(), 1)) for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True) if b > a]


def _find(rows: pa.Table) -> pa.Table:
    """For each part, (first segment, shift, length, least id) of the repeats that a greater id has there."""
    settle()
    parts = rows.column("part").to_pylist()
    kept: list[np.ndarray] = []
    for m in shard_repeats(rows.column("blob").to_pylist()):
        repeat = m.repeat - m.repeat[0]
        least = np.full(int(repeat.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, repeat, m.low)
        least = least[repeat]
        gone = np.flatnonzero(m.high > least)
        kept.append(_longest(np.stack([m.origin[gone].astype(np.int64), m.first[gone], m.shift[gone], m.length[gone], least[gone]])))
    spans = _longest(np.concatenate(kept, axis=1)) if kept else np.zeros((5, 0), dtype=np.int64)
    return _table(_returned(spans[0], spans[1:], parts, "<i8"), ["part", "blob"], [pa.int32(), pa.binary()])


def _name(rows: pa.Table) -> pa.Table:
    """For each part, (first segment, shift, length, shard, repeat) of all repeats."""
    settle()
    parts, shard = rows.column("part").to_pylist(), rows.column("shard")[0].as_py()
    out = []
    for m in shard_repeats(rows.column("blob").to_pylist()):
        out += _returned(m.origin, np.stack([m.first.astype(np.int64), m.shift, m.length, np.full(len(m.repeat), shard), m.repeat]), parts, "<i8")
    return _table(out, ["part", "blob"], [pa.int32(), pa.binary()])


def _all_spans(spans: pa.Table, width: int) -> np.ndarray:
    got = [np.frombuffer(zstandard.decompress(x), dtype="<i8").reshape(width, -1) for x in spans.column("blob").to_pylist()]
    return np.concatenate(got, axis=1) if got else np.zeros((width, 0), dtype=np.int64)


def _place(rows: pa.Table, spans: pa.Table) -> pa.Table:
    """(shard, repeat, length, id, start) of every place in a part."""
    settle()
    out, types = [], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    if rows.num_rows and spans.num_rows:
        docs, got = Part(rows), _all_spans(spans, 5)
        for span, seg in docs.places(got):
            out.append(np.stack([got[3, span], got[4, span], got[2, span], docs.ids[docs.text[seg]], docs.start[seg] + got[1, span]]))
    flat = np.concatenate(out, axis=1) if out else np.zeros((5, 0), dtype=np.int64)
    return pa.table([pa.array(x, pa.int64()).cast(t) for x, t in zip(flat, types, strict=True)], names=["shard", "repeat", "length", "id", "start"])


def _longest(spans: np.ndarray) -> np.ndarray:
    """(origin, first, shift, length, least id) in order, without those inside the one before that has no greater id."""
    spans = spans[:, np.lexsort((spans[4], -spans[3], spans[2], spans[1], spans[0]))]
    if spans.shape[1] < 2:
        return spans
    ends = spans[2] + spans[3]
    inside = (spans[0, 1:] == spans[0, :-1]) & (spans[1, 1:] == spans[1, :-1]) & (ends[1:] <= ends[:-1]) & (spans[4, 1:] >= spans[4, :-1])
    return spans[:, np.concatenate(([True], ~inside))]


def _cut(rows: pa.Table, spans: pa.Table) -> pa.Table:
    """Each document without the bytes of its spans."""
    settle()
    out: list[tuple] = []
    if rows.num_rows:
        docs = Part(rows)
        sizes = np.array([len(t) for t in docs.texts], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        # Where spans begin less where they end, over all texts of the part; one more place for each text's end.
        change = np.zeros(int(sizes.sum()) + len(sizes) + 1, dtype=np.int32)
        got = _all_spans(spans, 4)
        if got.shape[1]:
            for span, seg in docs.places(got):
                text = docs.text[seg]
                gone = docs.ids[text] > got[3, span]
                start = (begin[text] + text + docs.start[seg] + got[1, span])[gone]
                np.add.at(change, start, 1)
                np.add.at(change, start + got[2, span][gone], -1)
        for i, text in enumerate(docs.texts):
            n, at = len(text), int(begin[i]) + i
            mine = change[at : at + n + 1]
            if not mine.any():
                out.append((int(docs.ids[i]), n, 0, 0, text))
                continue
            gone = np.cumsum(mine)[:n] > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(docs.ids[i]), n, int(gone.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()))
    return _table(out, ["id", "n_bytes", "n_removed", "n_spans", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])


def _hashed(rows: pa.Table, spans: pa.Table) -> pa.Table:
    done = _cut(rows, spans)
    sums = pa.array([hashlib.sha256(x).hexdigest() for x in done.column("kept").to_pylist()], pa.string())
    return done.drop_columns(["kept"]).append_column("kept_sha256", sums)


class Dedup:
    """The operator's tables over one table of documents; all are lazy."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", parts: int | None = None) -> None:
        small_batches(docs.sparkSession)
        rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        n = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)
        self.loose = rows.where("id is null")
        # By text too, so that rows that share an id spread.
        self.docs = rows.where("id is not null").withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int")).repartition(n, "part")
        asked = self.docs.groupBy("part").applyInArrow(_ask(SHARDS * n), "shard int, part int, keys binary, many binary").repartition(n, "shard")
        self.answers = asked.groupBy("shard").applyInArrow(_answer, "part int, shard int, bits binary")
        self.sent = self.docs.groupBy("part").cogroup(self.answers.groupBy("part")).applyInArrow(_send(SHARDS * n), "shard int, part int, blob binary").repartition(n, "shard")

    def places(self) -> DataFrame:
        """(shard, repeat, length, id, start): every place of every repeat; (shard, repeat) names a repeat."""
        named = self.sent.groupBy("shard").applyInArrow(_name, "part int, blob binary")
        return self.docs.groupBy("part").cogroup(named.groupBy("part")).applyInArrow(_place, "shard int, repeat long, length long, id long, start long")

    def repeats(self) -> DataFrame:
        """(shard, repeat, length, places): every repeat with all its places (id, start) in one row; ``places`` has them apart."""
        place = F.sort_array(F.collect_set(F.struct("id", "start"))).alias("places")
        return self.places().groupBy("shard", "repeat", "length").agg(place)

    def spans(self) -> DataFrame:
        return self.sent.groupBy("shard").applyInArrow(_find, "part int, blob binary")

    def kept(self) -> DataFrame:
        """(id, n_bytes, n_removed, n_spans, kept): every document's remaining bytes."""
        out = self.docs.groupBy("part").cogroup(self.spans().groupBy("part")).applyInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
        return out.unionByName(self.loose.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept")))

    def digests(self) -> DataFrame:
        out = self.docs.groupBy("part").cogroup(self.spans().groupBy("part")).applyInArrow(_hashed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        return out.unionByName(self.loose.select("id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dedup(table(spark, sf_dir, "documents")).digests().withColumnRenamed("id", "doc_id")


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
