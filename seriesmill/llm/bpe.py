"""Byte-pair encoding and decoding of whole texts with a public vocabulary, and tree concatenation of long pieces."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import remembered, text_or_empty

LEAF = 2048  # characters of a piece encoded on their own
CACHE = 500_000  # chunks whose ids a worker remembers
WINDOW = 1 << 20  # characters of a text split at a time
THREADS = 2  # that encode the leaves of one piece
FIRST = 8  # tokens on either side of a join that are encoded again at first

#: The white space of the vocabulary's splitting pattern.
SPACES = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


#: Letters of ASCII and Latin-1 with a blank before them or not, then marks of ASCII other than those of contractions and special tokens.
_PLAIN = re.compile("( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\\[-`{}~]*)")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def joined(a: list[int], b: list[int], letters: list[str], encode) -> list[int]:
    """The encoding of a piece from those of its two parts.

    The last tokens of the one and the first of the other are encoded again
    together; once the result begins and ends with the same tokens as the parts
    do there, every pair of neighbours is one that the merges leave apart: pairs
    within a part or the window because those are encodings themselves, pairs
    at the window's edges because they stand in a part. With merges by rank a
    sequence is its text's encoding exactly if each pair of neighbours is, since
    the first merge that crossed a boundary would also cross it in the pair
    alone. Otherwise the window doubles, in the end to the whole piece.
    """
    k = FIRST
    while True:
        left, right = a[-k:], b[:k]
        window = encode("".join(letters[t] for t in left + right))
        begins = k >= len(a) or window[0] == left[0]
        ends = k >= len(b) or window[-1] == right[-1]
        if begins and ends:
            return a[:-k] + window + b[k:]
        k *= 2


class Encoder:
    """A byte-level BPE tokenizer from a file, with the ids of recent chunks kept.

    A text is cut where the vocabulary's own pattern always cuts: before a run
    of other than white space, with one blank before it, and around white space.
    Each chunk is encoded once; chunks longer than LEAF go through the tree.
    """

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.leaf = leaf
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.core = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None, "decoder": None, "truncation": None, "padding": None}))
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.letters = [self.whole.id_to_token(i) for i in range(size)]
        value = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [bytes(value[c] for c in t) if i not in self.special.values() else t.encode() for i, t in enumerate(self.letters)]
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.merges, self.alphabet = self.whole.model, byte_letters()
        self.known: dict[str, bytes] = {}

    def _core(self, piece: str) -> list[int]:
        return self.core.encode(piece, add_special_tokens=False).ids

    def tree(self, piece: str) -> list[int]:
        """A long piece in the byte alphabet: its halves' leaves in parallel, then neighbours joined level by level."""
        leaves = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        with ThreadPoolExecutor(THREADS) as pool:  # the library leaves the interpreter's lock while it encodes
            halves = [leaves[i * len(leaves) // THREADS : (i + 1) * len(leaves) // THREADS] for i in range(THREADS)]
            found = pool.map(lambda part: self.core.encode_batch_fast(part, add_special_tokens=False), halves)
            level = [e.ids for part in found for e in part]
        while len(level) > 1:
            pairs = [joined(level[i], level[i + 1], self.letters, self._core) for i in range(0, len(level) - 1, 2)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0]

    def _long(self, chunk: str) -> list[int]:
        pieces = self.whole.pre_tokenizer.pre_tokenize_str(chunk)
        return [t for p, _ in pieces for t in (self.tree(p) if len(p) > self.leaf else self._core(p))]

    def _merged(self, piece: str) -> bytes:
        """The ids of one piece that the pattern leaves whole."""
        found = self.known.get(piece)
        if found is None:
            plain = piece if piece.isascii() and piece.isalnum() else "".join(self.alphabet[b] for b in piece.encode())
            found = self.known[piece] = array("i", [t.id for t in self.merges.tokenize(plain)] if plain else []).tobytes()
        return found

    def _learn(self, chunks: set[str]) -> None:
        rest = []
        for c in chunks:
            if len(c) > self.leaf:
                self.known[c] = array("i", self._long(c)).tobytes()
            elif m := _PLAIN.fullmatch(c):
                self.known[c] = self._merged(m[1]) + self._merged(m[2])
            else:
                rest.append(c)
        for c, e in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[c] = array("i", e.ids).tobytes()

    def _windows(self, text: str) -> Iterator[list[str]]:
        at, width = 0, WINDOW
        while at < len(text):
            chunks = _CHUNK.findall(text, at, at + width)
            if at + width < len(text):
                if len(chunks) < 2:  # no cut in the window
                    width *= 2
                    continue
                chunks.pop()  # what follows may change the last one
            at, width = at + sum(map(len, chunks)), WINDOW
            yield chunks

    def encode(self, text: str) -> np.ndarray:
        parts, out = self.marks.split(text) if self.marks else [text], []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            for chunks in self._windows(part):
                if len(self.known) > CACHE:
                    self.known.clear()
                if new := {c for c in set(chunks) if c not in self.known}:
                    self._learn(new)
                out.append(b"".join(map(self.known.__getitem__, chunks)))
                for c in (c for c in new if len(c) > self.leaf):
                    self.known.pop(c, None)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """An Arrow list array of int32 arrays."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts take about ``limit`` bytes."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // limit
    for start in np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []:
        yield batch.slice(start, int((part == part[start]).sum()))


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row with the byte-level BPE tokenizer at ``path``.

    As the tokenizers library encodes whole texts without special tokens added;
    a special token's own string in a text is that token. Null and empty texts
    give no ids. Texts of any length are split in windows; a run without white
    space is encoded in leaves and joined. Repeated rows and null ids stay as
    they are, other columns are not read, an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = remembered(("bpe", path), lambda: Encoder(path))
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.record_batch([b.column(0), lists([encoder.encode(x.as_py()) for x in b.column(1)])], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; special tokens are kept, null counts as no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(("bpe", path), lambda: Encoder(path))
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            texts = [encoder.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in column]
            yield pa.record_batch([*b.columns, pa.array(texts, type=pa.string())], names=[*b.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
