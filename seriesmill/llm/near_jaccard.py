"""Near-duplicate detection by Jaccard similarity: SimHash fingerprints and MinHash bands give candidates, exact shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmill.llm import simhash
from seriesmill.llm.common import components, stored, text_or_empty

SEED = 42
DISTANCE = 6  # bits by which fingerprints of candidates differ at most; keys of two blocks then have 16 bits, so few rows share one by chance
BANDS, ROWS = 40, 5  # a pair at 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 40 = 1.2e-7
ALIKE = 120  # of the 200 bytes of two sketches so many are equal; fewer at 0.8 have a chance of about 1e-11
PIECE = 512  # shingles permuted at a time
TILE = 512  # sets of a part; a group above 2 * TILE is dealt out as pairs of parts

_draw = np.random.default_rng(SEED)
MIX = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
MULTIPLY = _draw.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a shorter text is one shingle, a blank one has none."""
    words = text.lower().split()
    last = max(1, len(words) - width + 1) if words else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(last)], dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash under each of BANDS * ROWS permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), PIECE):
        mixed = (hashes[at : at + PIECE, None] ^ MIX) * MULTIPLY
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(axis=0))
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sets is ``percent`` or more, in whole numbers."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, fp, print, keys, sketch) of rows (doc_id, digest, body): a hash of the set, the SimHash fingerprint, a hash of each band, and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, prints, keys, marks = [], [], [], []
            for x in b.column(2):
                hashes = shingles(x.as_py(), width)
                least = minima(hashes)
                fps.append(_key(hashes))
                prints.append(simhash.fingerprint(x.as_py(), width))
                keys.extend(xxhash.xxh64_intdigest(part.tobytes(), i) for i, part in enumerate(least.reshape(BANDS, ROWS)))
                marks.append(least.astype(np.uint8).tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1, dtype=np.int32) * BANDS), pa.array(_signed(keys)))
            columns = [b.column(0), b.column(1), pa.array(_signed(fps)), pa.array(_signed(prints)), lists, pa.array(marks, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "digest", "fp", "print", "keys", "sketch"])

    return rows.mapInArrow(run, "doc_id long, digest binary, fp long, print long, keys array<long>, sketch binary")


def _spanning(percent: int | None):
    """Over rows sorted by (k, left, right): links that span each run's pairs of like sketches, with ``percent`` those whose sets are similar."""

    def pairs(table: pa.Table) -> list[tuple[int, int]]:
        marks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("body").to_pylist()] if percent else None
        top, out = np.arange(len(marks)), []
        for i in range(1, len(marks)):
            equal = np.count_nonzero(marks[:i] == marks[i], axis=1)
            found = np.flatnonzero(equal >= ALIKE)
            for j in found[np.argsort(-equal[found], kind="stable")]:
                if top[i] != top[j] and (sets is None or similar(sets[i], sets[j], percent)):
                    top[top == top[j]] = top[i]
                    out.append((i, int(j)))
        return out

    def linked(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        fp, src, dst = table.column("fp").to_numpy(), [], []
        for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
            if b - a > 1:
                found = pairs(table.slice(a, b - a))
                src.extend(fp[a + i] for i, _ in found)
                dst.extend(fp[a + j] for _, j in found)
        return pa.record_batch([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        new[1:] = np.logical_or.reduce([(k := t.column(c).to_numpy())[1:] != k[:-1] for c in ("k", "left", "right")])
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in batches:
            if not len(b):
                continue
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            at = starts(t)
            kept = t.slice(at[-1])  # the last run may go on in the next batch
            if at[-1]:
                yield linked(t.slice(0, at[-1]), at[:-1])
        if kept is not None:
            yield linked(kept, np.array([0]))

    return run


def _links(rows: DataFrame, percent: int | None = None) -> DataFrame:
    """Spanning links (src, dst) of fp over rows (k, n, fp, ...), n the rows of k; large groups are dealt as tiles, as in simhash.links."""
    cuts = F.when(F.col("n") > 2 * TILE, F.ceil(F.col("n") / TILE)).otherwise(1).cast("int")
    met = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    tiles = met.withColumn("left", F.least("mine", "other")).withColumn("right", F.greatest("mine", "other")).drop("n", "mine", "other")
    tiles = tiles.repartition("k", "left", "right").sortWithinPartitions("k", "left", "right", "fp")
    return tiles.mapInArrow(_spanning(percent), "src long, dst long")


def _by_prints(prints: DataFrame, distance: int) -> DataFrame:
    """Links (src, dst) of fp that connect the sets as all pairs of SimHash fingerprints within ``distance`` would, by simhash.links."""
    held = prints.select("print", "fp").distinct()
    reps = stored(held.groupBy("print").agg(F.min("fp").alias("rep")), "prints")
    equal = held.join(reps, "print").where("fp <> rep").select(F.col("fp").alias("src"), F.col("rep").alias("dst"))
    return equal.union(simhash.links(reps.select(F.col("print").alias("fp"), "rep"), distance))


def _by_bands(nodes: DataFrame) -> DataFrame:
    """Links (src, dst) of fp that span the sets which share a band of minima and have like sketches."""
    keyed = nodes.select("fp", F.explode("keys").alias("k"))
    shared = stored(keyed.join(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "k"), "shared")
    return _links(shared.join(nodes.select("fp", "sketch"), "fp"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, class_id, component_id) of every row; component_id is the smallest doc_id reachable over pairs of similar texts.

    Two texts are similar if the Jaccard similarity of their sets of ``width``
    words is ``percent`` (80 at least) or more. Words are split at ASCII white
    space and ASCII letters lower-cased; a shorter text is one shingle. Equal
    sets are one node, whatever ids they have. Nodes are linked where SimHash
    fingerprints of their texts' shingles differ in ``distance`` bits or fewer,
    and, since similar texts may differ in more, where they share a band of
    minima and have like sketches. All pairs within each component of these
    links are decided by their whole sets, so no dissimilar pair is linked; a
    similar one is missed with a chance of 1.2e-7 at most. Null, empty
    and blank texts have no shingle and are one node. ``class_id`` names the
    component, ``digest`` is the SHA-256 of the row's text. component_id is null
    where no row of the component has an id. Repeated rows stay. An empty table
    gives an empty table; other columns are not read.
    """
    if percent < 80:
        raise ValueError("bands and sketches are laid out for 80 percent or more")
    body = text_or_empty(text).cast("binary")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(body, 256)).alias("digest"), body.alias("body"))
    prints = stored(sketches(rows, width), "sketches")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("digest").alias("rep"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    like = components(stored(_by_prints(prints, distance).union(_by_bands(nodes)), "like")).toDF("fp", "k")

    sizes = like.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    members = stored(like.join(sizes, "k").join(nodes.select("fp", "rep", "sketch"), "fp"), "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(x.as_py(), width) for x in b.column(1)]
            yield pa.record_batch([pa.array(_signed([_key(x) for x in found])), pa.array([x.tobytes() for x in found], pa.binary())], names=["fp", "body"])

    chosen = rows.join(members.select(F.col("rep").alias("digest")).distinct(), "digest", "left_semi").select("digest", "body")
    bodies = chosen.groupBy("digest").agg(F.first("body").alias("body")).mapInArrow(sets, "fp long, body binary")
    labels = components(stored(_links(members.drop("rep").join(bodies, "fp"), percent), "near")).toDF("fp", "k")

    named = nodes.select("fp", "least").join(labels, "fp", "left").select("fp", "least", F.coalesce("k", "fp").alias("k"))
    least = named.groupBy("k").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "k").join(least, "k").select("fp", F.col("k").alias("class_id"), "component_id")
    return prints.select("doc_id", "digest", "fp").join(ids, "fp").select("doc_id", "digest", "class_id", "component_id")
