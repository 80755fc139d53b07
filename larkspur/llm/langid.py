"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces, which a forward
recursion gives; that of a text is the product over its words.  Every piece of the vocabulary
that holds no white space after its first byte counts, as words hold none.

Defined results: a null or empty text, or one with no letter, is ``und`` with score 0; an empty
training set makes every text ``und``, an empty table gives no rows; ties go to the language that
sorts first; rows that repeat are scored alike; very long texts and words are scored whole, but
texts of over ``FIT_BYTES`` bytes are not learned from; other columns, whatever their names,
pass through unchanged, and one named like an added column is replaced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import add_columns, as_bytes, by_list, fresh, held_out, interned, table

UND = "und"
#: Documents per language that the fit reads, chosen by the hash of their id, and the bytes of each at most.
FIT_DOCS = 300
FIT_BYTES = 1 << 16
#: Words from this many bytes on are scored one by one.
LONG_WORD = 64
EM_ROUNDS = 3
SMOOTHING = 0.1

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RADIX = np.uint64(0xD6E8FEB86659FD93)
#: log of the probability of no piece.
_NEVER = -1e30
_LETTER = re.compile(r"[^\W\d_]+")


def byte_level_pieces(path: str) -> list[bytes]:
    """The byte strings of a byte-level BPE vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return sorted({bytes(back[c] for c in piece) for piece in vocabulary if all(c in back for c in piece)})


class Pieces:
    """Finds every piece that starts at every byte of a buffer, by vectorised hashing.

    Pieces are known by a 64-bit polynomial of their bytes, which is unlike for all of them.
    """

    BITS = 18

    def __init__(self, pieces: list[bytes]) -> None:
        single = {bytes([b]) for b in range(256)}
        self.pieces = sorted({p for p in pieces if p and not any(b in b" \t\n\r\x0b\x0c" for b in p[1:])} | single)
        while len(self.pieces) * 2 > 1 << self.BITS:
            self.BITS += 1
        self.longest = max(map(len, self.pieces))
        self.sizes = sorted({len(p) for p in self.pieces})
        size = 1 << self.BITS
        self.keys = np.zeros(size, dtype=np.uint64)
        self.ids = np.full(size, -1, dtype=np.int32)
        self.probes = 1
        seen = set()
        for n, piece in enumerate(self.pieces):
            key = self._key(piece)
            assert key not in seen
            seen.add(key)
            slot, step = int((key * int(_MULTIPLIER) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)), 1
            while self.ids[slot] >= 0:
                slot, step = (slot + 1) % size, step + 1
            self.keys[slot], self.ids[slot], self.probes = key, n, max(self.probes, step)

    @staticmethod
    def _key(piece: bytes) -> int:
        key = 0
        for b in piece:
            key = (key * int(_RADIX) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def find(self, keys: np.ndarray) -> np.ndarray:
        slots = ((keys * _MULTIPLIER) >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = np.where(self.keys[slots] == keys, self.ids[slots], -1)
        open_ = np.flatnonzero((out < 0) & (self.ids[slots] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & (len(self.ids) - 1)
            out[open_] = np.where(self.keys[at] == keys[open_], self.ids[at], -1)
            open_ = open_[(out[open_] < 0) & (self.ids[at] >= 0)]
        return out

    def starts(self, buffer: np.ndarray, lengths: np.ndarray) -> dict[int, np.ndarray]:
        """By size, for each byte the piece of that many bytes that starts there, or the number of pieces.

        The buffer holds words of these lengths one after another; no piece reaches across two.
        Sizes of which no piece occurs are left out.
        """
        none, n = len(self.pieces), len(buffer)
        out = {}
        wide = buffer.astype(np.uint64) + np.uint64(1)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)  # bytes to the word's end
        at, key = np.arange(n), np.zeros(n, dtype=np.uint64)
        for size in range(1, min(int(lengths.max(initial=0)), self.longest) + 1):
            on = left[at] >= size
            at, key = at[on], key[on]
            key = key * _RADIX + wide[at + (size - 1)]
            if size not in self.sizes:
                continue
            found = self.find(key)
            some = found >= 0
            if some.any():
                out[size] = np.full(n, none, dtype=np.int32)
                out[size][at[some]] = found[some]
        return out


def _layout(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words from long to short: their order, lengths, starts in the buffer, and the buffer."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(-lengths, kind="stable")
    buffer = np.frombuffer(b"".join(words), dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return order, lengths[order], starts[order], buffer


def forward(words: list[bytes], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """log of the sum over all segmentations, for each word and language.

    ``p`` has a row for each piece and one of zeros.
    """
    order, lengths, starts, buffer = _layout(words)
    langs = p.shape[1]
    log = np.zeros((len(words), langs))
    # Long words one by one, all sizes at once; the others side by side, one size at a time.
    long = int((lengths >= LONG_WORD).sum())
    for w in range(long):
        log[w] = _forward_long(buffer[starts[w] : starts[w] + lengths[w]], pieces, p)
    rest, at = lengths[long:], starts[long:]
    longest = int(rest[0]) if len(rest) else 0
    by_place = np.empty(len(words), dtype=np.int64)
    by_place[order] = lengths
    found = pieces.starts(buffer, by_place)
    history = max(found, default=1)
    alphas = [np.ones((len(rest), langs))]
    active = len(rest) - np.searchsorted(rest[::-1], np.arange(longest + 2), side="left")
    dense, sparse = _parted(found, at, rest, len(p) - 1)
    for j in range(1, longest + 1):
        n = int(active[j])
        now = np.zeros((n, langs))
        for size, ids in dense.items():
            if size > j:
                break
            now += alphas[-size][:n] * p[ids[at[:n] + (j - size)]]
        for size, (ends, rows, ids) in sparse.items():
            a, b = ends[j], ends[j + 1]
            if a < b:
                now[rows[a:b]] += alphas[-size][rows[a:b]] * p[ids[a:b]]
        if j % 16 == 0:
            scale = now.copy()
            log[long : long + n] += np.log(scale)
            alphas = [a[:n] / scale for a in alphas[-history:]]
            now = np.ones((n, langs))
        alphas.append(now)
        alphas = alphas[-history:]
        done = int(active[j + 1])
        if done < n:
            log[long + done : long + n] += np.log(now[done:n])
    out = np.empty_like(log)
    out[order] = log
    return out


def _parted(found: dict[int, np.ndarray], starts: np.ndarray, lengths: np.ndarray, none: int) -> tuple[dict[int, np.ndarray], dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Sizes whose pieces occur at many places as they are; of the others the places alone.

    Of those (first of each end, words, pieces) in the order of the piece's end in its word.
    """
    dense, sparse = {}, {}
    order = np.argsort(starts)
    longest = int(lengths.max(initial=0))
    for size, ids in found.items():
        at = np.flatnonzero(ids != none)
        if len(at) * 8 > len(ids):
            dense[size] = ids
            continue
        word = order[np.maximum(np.searchsorted(starts[order], at, side="right") - 1, 0)] if len(order) else at[:0]
        at = at[: len(word)]
        end = at - starts[word] + size
        inside = (end >= size) & (end <= lengths[word])
        at, word, end = at[inside], word[inside], end[inside]
        by = np.argsort(end, kind="stable")
        sparse[size] = np.searchsorted(end[by], np.arange(longest + 2)), word[by], ids[at[by]]
    return dense, sparse


def _forward_long(word: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    found = pieces.starts(word, np.array([len(word)]))
    sizes = np.array(list(found), dtype=np.int64)
    history, n = int(sizes.max()), len(word)
    table_ = np.stack(list(found.values()))  # by size and start
    which = np.arange(len(sizes))
    window = np.zeros((n + 1 + history, p.shape[1]))  # the sums up to each byte, zeros before the word
    window[history] = 1.0
    log = np.zeros(p.shape[1])
    for j in range(1, n + 1):
        begin = j - sizes
        now = (window[begin + history] * p[table_[which, np.maximum(begin, 0)]]).sum(axis=0)
        if j % 16 == 0:
            log += np.log(now)
            window[j : j + history] /= now
            now = np.ones_like(now)
        window[j + history] = now
    return log + np.log(window[n + history])


def expected(words: list[bytes], weights: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations (one language), for an EM step; by logarithms, so for words of any length."""
    order, lengths, starts, buffer = _layout(words)
    weights = weights[order]
    longest = int(lengths[0]) if len(lengths) else 0
    found = pieces.starts(buffer, np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    active = len(words) - np.searchsorted(lengths[::-1], np.arange(longest + 2), side="left")
    with np.errstate(divide="ignore"):
        logp = np.maximum(np.log(p[:, 0]), _NEVER)

    def total(terms: list[np.ndarray]) -> np.ndarray:
        every = np.stack(terms)
        top = every.max(axis=0)
        return top + np.log(np.exp(every - top).sum(axis=0))

    alphas = [np.zeros(len(words))]
    whole = np.zeros(len(words))
    for j in range(1, longest + 1):
        n, done = int(active[j]), int(active[j + 1])
        alphas.append(total([alphas[j - size][:n] + logp[ids[starts[:n] + (j - size)]] for size, ids in found.items() if size <= j]))
        whole[done:n] = alphas[j][done:n]
    out = np.zeros(len(p))
    betas: dict[int, np.ndarray] = {}
    for j in range(longest, -1, -1):
        n = int(active[max(j, 1)]) if j else len(words)
        beta = np.full(n, _NEVER)
        if j:
            beta[int(active[j + 1]) : n] = 0.0
        for size, ids in found.items():
            if j + size > longest:
                break
            m = int(active[j + size])
            if not m:
                continue
            here = ids[starts[:m] + j]
            flow = logp[here] + betas[j + size]
            beta[:m] = np.logaddexp(beta[:m], flow)
            out += np.bincount(here, weights=np.exp(alphas[j][:m] + flow - whole[:m]) * weights[:m], minlength=len(p))
        betas[j] = beta
        betas.pop(j + pieces.longest, None)
    out[-1] = 0
    return out


def spaced(text: bytes) -> list[bytes]:
    """The words of a lower-cased text, each with a space before it."""
    return [b" " + w for w in text.decode("utf-8", "replace").lower().encode().split()]


@dataclass
class Model:
    langs: list[str]
    pieces: Pieces
    p: np.ndarray

    @staticmethod
    def fit(texts: dict[str, list[bytes]], vocabulary: list[bytes], rounds: int = EM_ROUNDS) -> Model:
        pieces = Pieces(vocabulary)
        langs = sorted(texts)
        p = np.zeros((len(pieces.pieces) + 1, len(langs)))
        for k, lang in enumerate(langs):
            distinct, flat, _ = interned([spaced(t) for t in texts[lang]])
            weights = np.bincount(flat, minlength=len(distinct)).astype(float)
            q = np.full((len(p), 1), 1.0 / len(pieces.pieces))
            q[-1] = 0
            for _ in range(rounds if distinct else 0):
                uses = expected(distinct, weights, pieces, q) + SMOOTHING
                uses[-1] = 0
                q = (uses / uses.sum())[:, None]
            p[:, k] = q[:, 0]
        return Model(langs, pieces, p)

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        letters = [any(m.group().isalpha() for m in _LETTER.finditer(t.decode("utf-8", "replace"))) for t in texts]
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts)
        distinct, flat, counts = interned([spaced(t) if ok else [] for t, ok in zip(texts, letters, strict=True)])
        logs = forward(distinct, self.pieces, self.p) if distinct else np.zeros((0, len(self.langs)))
        sums = np.stack([by_list(logs[flat, k], counts) for k in range(len(self.langs))], axis=1)
        best = np.argmax(sums, axis=1)
        share = 1.0 / np.exp(np.minimum(sums - sums.max(axis=1, keepdims=True), 0)).sum(axis=1)
        return (
            [self.langs[b] if ok else UND for b, ok in zip(best, letters, strict=True)],
            [float(s) if ok else 0.0 for s, ok in zip(share, letters, strict=True)],
        )


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", vocabulary: str | None = None, fit_docs: int = FIT_DOCS) -> Model:
    """Fit on at most ``fit_docs`` whole texts of each language, those whose ids hash lowest, of texts up to ``FIT_BYTES``."""
    rows = docs.select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(key).cast("string").alias("k"))
    rows = rows.where(F.col("l").isNotNull() & (F.octet_length("t") <= FIT_BYTES))
    # Ids first: a top-k per language that Spark cuts in each task before it shuffles.
    lowest = F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))
    marks = rows.select("l", "h", "k").withColumn("n", lowest).where(F.col("n") <= fit_docs).groupBy("l").agg(F.max("h").alias("top"))
    tops = {r.l: r.top for r in marks.collect()}
    texts: dict[str, list[bytes]] = {x: [] for x in tops}
    if tops:
        keep = F.lit(False)
        for x, top in tops.items():
            keep = keep | ((F.col("l") == x) & (F.col("h") <= top))
        for r in rows.where(keep).orderBy("l", "h", "k").toLocalIterator():
            if len(texts[r.l]) < fit_docs:
                texts[r.l].append(r.t.encode("utf-8", "replace"))
    return Model.fit(texts, byte_level_pieces(vocabulary or public_vocabulary()))


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with its predicted language and that language's share of the likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = shared.value.predict(as_bytes(part.column(text)))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return add_columns(docs, text, [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())], make)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no known language go, those without a letter (null and empty texts too).

    Repeated rows stay or go together; see the module for long texts, ties and an empty table;
    columns of any name are kept.
    """
    model = fit(docs.where(~held_out("doc_id", 3, 1)))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return identify(docs, model, pred=pred, score=score).where(F.col(pred) != UND).drop(pred, score)


QUERIES = {"op6_language_id": op6_language_id}
