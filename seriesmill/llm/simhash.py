"""SimHash near-duplicate detection: pigeonhole blocks, then Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import components, stored, text_or_empty

BITS = 64
SEED = 42
PIECE = 1 << 16  # shingles hashed at a time
TILE = 512  # fingerprints of a block's part; a block above 2 * TILE is dealt out as pairs of parts


def fingerprint(text: bytes, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, zero where it has no word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = ends[width - 1 :] - 1 if len(words) >= width else ends[-1:] - 1
    n, ones, digest = len(last), np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        pairs = zip(starts[at : at + PIECE].tolist(), last[at : at + PIECE].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += _bit_sums(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) of every row; null text has the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width) for x in b.column(1)], dtype=np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _layout(distance: int) -> tuple[list[int], int]:
    """Block edges and how many blocks a close pair must share: two blocks more than the distance, thus two in common."""
    blocks = distance + 2
    return [round(i * BITS / blocks) for i in range(blocks + 1)], 2


def _keys(distance: int) -> list[F.Column]:
    edges, share = _layout(distance)
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(len(edges) - 1)]
    out = []
    for number, picked in enumerate(combinations(masks, share)):
        mask = sum(picked)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(number).cast("short").alias("part"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("bits")))
    return out


def _near(distance: int):
    """Over rows sorted by (part, bits, left, right): a spanning set of the links within each run of equal keys."""

    def spanning(fp: np.ndarray, rep: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(run)
        rest = (np.cumsum(size) - 1)[run] - np.arange(len(run))  # rows of the run that follow
        heads, tails, at, step = [], [], np.flatnonzero(rest > 0), 1
        while len(at):
            close = np.bitwise_count(fp[at] ^ fp[at + step]) <= distance
            heads.append(at[close])
            tails.append(at[close] + step)
            step += 1
            at = at[rest[at] >= step]
        if not heads:
            return rep[:0], rep[:0]
        a, b = np.concatenate(heads), np.concatenate(tails)
        low = np.arange(len(fp))
        while True:  # the first row of each component
            before = low.copy()
            least = np.minimum(low[a], low[b])
            np.minimum.at(low, a, least)
            np.minimum.at(low, b, least)
            low = low[low]
            if (low == before).all():
                break
        linked = np.flatnonzero(low != np.arange(len(fp)))
        return rep[low[linked]], rep[linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            new = _starts(t)
            cut = int(np.flatnonzero(new)[-1])  # the last run may go on in the next batch
            kept = t.slice(cut)
            if cut:
                yield out(t.slice(0, cut), new[:cut])
        if kept is not None:
            yield out(kept, _starts(kept))

    def _starts(t: pa.Table) -> np.ndarray:
        keys = [t.column(c).to_numpy() for c in ("part", "bits", "left", "right")]
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return new

    def out(t: pa.Table, new: np.ndarray) -> pa.RecordBatch:
        a, b = spanning(t.column("fp").to_numpy().view(np.uint64), t.column("rep").to_numpy(), np.cumsum(new) - 1)
        return pa.record_batch([pa.array(a), pa.array(b)], names=["src", "dst"])

    return run


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (src, dst) that connect the rows of ``prints`` (fp, rep; one a fingerprint) as all pairs within ``distance`` would.

    The 64 bits are split into distance + 2 blocks, so a close pair agrees on
    two of them; each pair of blocks is a key, and rows meet by key. A key of up
    to 2 * TILE fingerprints is compared in one place. A larger one is cut into
    parts by hash, and each pair of parts is a tile of its own, so that no task
    takes a key whole and no pair is missed. Within a tile only a spanning set
    of the links found is returned.
    """
    keyed = prints.select("fp", "rep", F.explode(F.array(*_keys(distance))).alias("k")).select("fp", "rep", "k.part", "k.bits")
    sizes = keyed.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = keyed.join(sizes, ["part", "bits"])
    cuts = F.when(F.col("n") > 2 * TILE, F.ceil(F.col("n") / TILE)).otherwise(1).cast("int")
    mine = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    tiles = met.select("part", "bits", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "fp", "rep")
    tiles = tiles.repartition("part", "bits", "left", "right").sortWithinPartitions("part", "bits", "left", "right", "fp")
    return tiles.mapInArrow(_near(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row; component_id is the smallest doc_id reachable over links.

    Words are split at ASCII white space and ASCII letters lower-cased;
    ``width`` words make a shingle, repeats count, a shorter text is one
    shingle. Null, empty and blank texts have fingerprint zero and are linked
    like any other. Each distinct fingerprint is one node, whatever ids it has,
    so copies are never paired and rows without an id link others like any; a
    null doc_id gets its component like any other row, null if no row in it has
    an id. Repeated rows stay. An empty table gives an empty table; other
    columns are not read.
    """
    prints = stored(fingerprints(docs, width, doc_id, text), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(stored(links(nodes.select("fp", F.col("fp").alias("rep")), distance), "near")).toDF("fp", "node")
    named = nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("node", "fp").alias("node"))
    found = named.groupBy("node").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "node").join(found, "node").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
