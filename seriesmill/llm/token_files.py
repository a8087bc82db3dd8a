"""Token ids in ORC files: written in document order, read by stripe, pruned by metadata."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.llm.bpe import CACHE, byte_letters, lists, slices
from seriesmill.llm.common import remembered, text_or_empty

#: Row index entries every STRIDE rows; Bloom filters with a false-positive rate of FPP; stripes of about STRIPE bytes.
STRIDE, FPP, STRIPE = 1000, 0.01, 64 << 20
FILES = 100_000  # files whose bases may be broadcast
LONG = 256  # bytes of the longest pieces whose ids outlast a window
#: Letters of ASCII and Latin-1, then marks of ASCII other than those of contractions and special tokens.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\\[-`{}~]*)")
SCHEMA = "doc_id long, local_start long, n_tokens long, ids array<int>"


class _Ids(dict):
    """The ids of words by word; one that is not there is learned."""

    def __init__(self, learn: Callable[[bytes], bytes]):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        return self.learn(word)


class WordEncoder:
    """A tokenizer whose words never cross ASCII white space, with the ids of recent words kept.

    Normalizing and splitting act on each run of other characters alone, so a
    text's ids are those of its runs in order. A run of plain letters and marks
    is one piece of each, and the merges take such a piece without the rest.
    Once CACHE words are kept a new table begins, and words of the one
    before move there as they are met, so frequent words are learned once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.merges, self.alphabet = self.whole.model, dict(enumerate(byte_letters()))
        self.known, self.before, self.pieces, self.long = _Ids(self._learn), {}, {}, []

    def _letters(self, piece: str) -> bytes:
        plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("i", [t.id for t in self.merges.tokenize(plain)]).tobytes()

    def _encoded(self, text: str) -> bytes:
        return array("i", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str, encoded: Callable[[str], bytes]) -> bytes:
        found = encoded(piece)
        if len(piece) <= LONG:
            self.pieces[piece] = found
        return found

    def _learn(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            text = word.decode()
            if m := _PLAIN.fullmatch(text):
                letters, marks = m[1].lower(), m[2]
                found = self.pieces.get(letters) or self._piece(letters, self._letters)
                if marks:
                    found += self.pieces.get(marks) or self._piece(marks, self._encoded)
            else:
                found = self._encoded(text)
        self.known[word] = found
        if len(word) > LONG:
            self.long.append(word)
        return found

    def encode(self, text: bytes, window: int = 1 << 20) -> bytes:
        """Little-endian 32-bit ids of a text in UTF-8."""
        out, at = [], 0
        while at < len(text):
            end = at + window
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            words, at = text[at:end].split(), end
            if len(self.known) > CACHE:
                self.before, self.known = self.known, _Ids(self._learn)
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            out.append(b"".join(map(self.known.__getitem__, words)))
            while self.long:
                self.known.pop(self.long.pop(), None)
        return b"".join(out)


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes ORC files of SCHEMA under ``path``, a row per document, in ascending doc_id order over files and rows.

    Documents are dealt out by ranges of doc_id and a hash of the text before
    they are encoded, so each task streams its range into one file, and rows
    that share an id, or have none, spread over several; ``local_start`` counts
    the ids before a document in its file. ORC run-length encodes the ids; every
    stripe has row indexes, and a Bloom filter on doc_id. ``end_id`` ends each
    document; null and empty texts have nothing else. Null ids come first, rows
    that share a doc_id are ordered by their texts' hash, then text. An empty
    table writes no row. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, at, end = remembered(("words", tokenizer), lambda: WordEncoder(tokenizer)), 0, np.int32(end_id).tobytes()
        for batch in batches:
            for b in slices(batch, 1):
                ids = [np.frombuffer(encoder.encode(x.as_py()) + end, dtype="<i4") for x in b.column(1)]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.record_batch([b.column(0), pa.array(starts), pa.array(n), lists(ids)], names=["doc_id", "local_start", "n_tokens", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    rows = rows.withColumn("salt", F.xxhash64("body")).repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "body").drop("salt")
    writer = rows.mapInArrow(run, SCHEMA).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FPP)
    writer.option("orc.row.index.stride", STRIDE).option("orc.stripe.size", STRIPE).option("compression", "zstd").orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids, file) of the files under ``path``.

    ``start`` adds the ids of earlier files, by the numbers in their names, a
    sum over one row a file; up to FILES of them are broadcast, more are joined
    in a shuffle. Filters on doc_id reach the files' statistics, row indexes and
    Bloom filters.
    """
    name = F.element_at(F.split("file", "/"), -1)
    number = [F.regexp_extract(name, pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)")]
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    files = spark.read.schema(SCHEMA).orc(path).select(F.col("_metadata.file_path").alias("file"), "n_tokens").groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy(*number, "file").rowsBetween(W.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = F.broadcast(base) if len(rows.inputFiles()) <= FILES else base
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids", "file")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b.column(3).values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), b.column(3).offsets.to_numpy()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crc, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
