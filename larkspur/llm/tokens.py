"""Token-id output as ORC with run-length encoded integers, row indexes and Bloom filters.

Documents are range-partitioned and sorted by id, encoded with a public tokenizer, and written
as one ORC file per range.  ORC run-length encodes the integer columns; each stripe carries a
row index (least and greatest id of every ``ROW_STRIDE`` rows) and a Bloom filter on the id, so
readers skip stripes and files by their metadata and read stripes in parallel.

A text that spells a special token of the vocabulary has that token's id, as the library gives it.

Defined results: a null or empty text has only the end id; a null document id sorts first; rows
that share an id, or repeat, are written one after another, in no defined order; a very long
text is one row, encoded whole; an empty table gives an empty folder and no rows; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_path, slices, small_batches, table

END = 0
STRIPE_BYTES = 64 << 20
ROW_STRIDE = 1_000
#: Words whose ids a worker remembers; it starts afresh beyond this.
CACHE = 800_000

_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than space and line feed; a text that has any is cut with more care.
_OTHER_SPACE = [c for c in map(chr, [*range(9, 10), *range(11, 14), *range(28, 32), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF])]
#: A word that ends with a letter and then marks: the letters and the marks are encoded apart.
_MARKED = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-^`{-~]+)", re.S)


class _Memo(dict):
    """Ids of words that stand after a space, or after none; learned on the first use of each."""

    def __init__(self, tokenizer, space: bool, marks: dict | None = None) -> None:
        super().__init__()
        self.tokenizer, self.model, self.space = tokenizer, tokenizer.model, space
        self.marks = self if marks is None else marks
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        text = " " + word if self.space else word
        if word.isalpha():
            # One piece for the splitter, so the model can have it as it is, in the vocabulary's letters for bytes.
            out = array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin1").translate(self.shown))]).tobytes()
        elif found := _MARKED.fullmatch(word):
            out = self[found[1]] + self.marks[found[2]]
        else:
            out = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        self[word] = out
        return out


class Encoder:
    """Whole texts to ids.

    A byte-level BPE splits a text before every single space between other characters, around
    every single line feed between them, and between a letter and a mark, whatever stands
    around; so words are encoded once and remembered.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.first = _Memo(self.tokenizer, space=False)
        self.known = _Memo(self.tokenizer, space=True, marks=self.first)
        self.feed = self.first["\n"]

    @staticmethod
    def _cut(text: str) -> list[list[str]]:
        """Lines of words, or one line of longer pieces where white space runs together."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _OTHER_SPACE):
            return [_PLAIN_SPACE.split(text)]
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids and the end id, as little-endian 32-bit integers."""
        get, first, end = self.known.__getitem__, self.first, np.array([END], dtype="<u4").tobytes()
        return [(self._whole(t) if any(x in t for x in self.special) else self.feed.join([first[line[0]] + b"".join(map(get, line[1:])) for line in self._cut(t)])) + end for t in texts]

    def _whole(self, text: str) -> bytes:
        """A text that holds one of the vocabulary's special tokens, which may span words."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder, which remembers its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def write_token_table(docs: DataFrame, path: str, tokenizer: str | None = None, text: str = "text", key: str = "doc_id", partitions: int | None = None) -> None:
    """Write (doc_id, n_tokens, part, start_in_part, ids) of every row to ORC files at ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = tokenizer or public_tokenizer()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("start_in_part", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, part = encoder(where), 0, TaskContext.get().partitionId()
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                made = own.encode([x or "" for x in piece.column("text").to_pylist()])
                n = np.array([len(m) // 4 for m in made], dtype=np.int64)
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(np.frombuffer(b"".join(made), dtype="<i4")))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n), pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at + ends - n), ids], names=schema.names)
                at += int(ends[-1])

    out = rows.mapInArrow(run, schema).write.format("orc")
    for name, value in {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": ROW_STRIDE, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.encoding.strategy": "SPEED"}.items():
        out = out.option(name, str(value))
    out.save(path)


def read_token_table(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each."""
    rows = spark.read.orc(path)
    # One row for each file written: their number is that of the write's partitions.
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p"), before.alias("before"))
    return rows.join(F.broadcast(parts), F.col("part") == F.col("p")).withColumn("start", F.col("before") + F.col("start_in_part")).drop("p", "before", "start_in_part", "part")


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids that were read back."""
    rows = tokens.select("doc_id", "start", "ids")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(values)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_token_table(table(spark, sf_dir, "documents"), path)
    return digests(read_token_table(spark, path))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' token files, and a row for each document in them, repeated rows too.

    See the module for nulls, empty and long texts, ties, an empty table and other columns.
    """
    path = shared_path(spark, "tokens")
    write_token_table(docs, path)
    return digests(read_token_table(spark, path))


QUERIES = {"op5_token_output": op5_token_output}
