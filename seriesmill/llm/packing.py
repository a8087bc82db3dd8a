"""Conflict-constrained best-fit packing of documents into fixed-length bins."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import stored, text_or_empty

CAPACITY = 8192  # length of a bin
SHARD_PIECES = 4096  # pieces packed together, about


class Bins:
    """Open bins ordered by residual, then number; each carries the bitmap of its sources and duplicate clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.order, self.bits, self.fill = capacity, [], [], []

    def put(self, length: int, mask: int) -> tuple[int, int]:
        """(bin, offset) in the bin of least residual that has room and shares no bit; a new bin if none does."""
        at = bisect_left(self.order, (length, -1))
        while at < len(self.order) and self.bits[self.order[at][1]] & mask:
            at += 1  # the next looser bin
        if at == len(self.order):
            number, offset = len(self.bits), 0
            self.bits.append(mask)
            self.fill.append(length)
        else:
            number = self.order.pop(at)[1]
            offset = self.fill[number]
            self.bits[number] |= mask
            self.fill[number] += length
        if self.fill[number] < self.capacity:
            insort(self.order, (self.capacity - self.fill[number], number))
        return number, offset


def pack_shard(rows: list[tuple], capacity: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) of each row (length, source, cluster), longest first, ties in the order given.

    Only sources and clusters that two rows of the shard share need a bit.
    """
    sources, clusters = Counter(r[1] for r in rows), Counter(r[2] for r in rows)
    shared = [("s", k) for k, n in sources.items() if n > 1 and k is not None] + [("c", k) for k, n in clusters.items() if n > 1 and k is not None]
    bit = {key: 1 << i for i, key in enumerate(shared)}
    bins, out = Bins(capacity), [None] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: -rows[i][0]):
        length, source, cluster = rows[i]
        out[i] = bins.put(length, bit.get(("s", source), 0) | bit.get(("c", cluster), 0))
    return out


def cluster_of(text: Column) -> Column:
    """The default duplicate cluster: a hash of the words in lower case."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(text), r"\s+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, source: str | None = "source", cluster: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every document: doc_id, piece, start, length, bin_id, offset, residual.

    ``length`` is a document's length, by default its UTF-8 bytes and an end
    mark. One longer than ``capacity`` fills bins of its own with whole pieces,
    and its rest is packed as a piece; ``start`` is where a piece begins. No bin
    holds two documents of one ``source`` or one ``cluster`` (default:
    cluster_of the text); null is in conflict with nothing. Pieces go, longest
    first, to the compatible bin with least room left, ties to the oldest.

    Rows are dealt into shards of about SHARD_PIECES by hash of what they are
    (id, length, source, cluster) and a number among rows alike in all of it,
    which cuts up any hot source, cluster or row and depends on neither order nor
    partitions. Shards are packed apart, so bins stay open at their ends only
    once a shard. Null and empty texts take one unit. An empty table gives an
    empty table. Other columns are not read.
    """
    body = text_or_empty(text)
    size = (F.octet_length(body) + 1 if length is None else length).cast("long")
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.greatest(size, F.lit(1)).alias("size"),
        (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"),
        (cluster_of(body) if cluster is None else F.when(cluster.isNotNull(), F.xxhash64(cluster))).alias("cluster"),
    )
    what = ["doc_id", "size", "source", "cluster"]
    rows = stored(rows.groupBy(what).agg(F.count(F.lit(1)).alias("n")), "lengths")
    shards = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // SHARD_PIECES))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SHARD_PIECES).cast("long"))))
    rows = rows.withColumn("number", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + SHARD_PIECES, F.col("n")) - 1))).drop("n", "step")
    whole = F.floor(F.col("size") / capacity)
    full = rows.where(F.col("size") >= capacity).select(*what, "number", F.explode(F.sequence(F.lit(0), whole.cast("int") - 1)).alias("piece"))
    own = F.concat_ws("-", F.lit("w"), F.hex(F.xxhash64(*what)), F.col("doc_id"), F.col("number"), F.col("piece"))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("length"), own.alias("bin_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.withColumn("length", F.col("size") % capacity).where("length > 0").withColumns({"piece": whole.cast("int"), "start": whole.cast("long") * capacity, "shard": F.pmod(F.xxhash64(*what, "number"), F.lit(shards)).cast("int")})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size", "source", "cluster", "number"], na_position="first", kind="stable")
        null = lambda column: [None if x is None or x != x else x for x in column]
        placed = pack_shard(list(zip(pdf["length"].tolist(), null(pdf["source"]), null(pdf["cluster"]), strict=True)), capacity)
        out = pdf[["doc_id", "piece", "start", "length"]].copy()
        out["bin_id"] = [f"{s}-{b}" for s, (b, _) in zip(pdf["shard"], placed, strict=True)]
        out["offset"] = [o for _, o in placed]
        out["residual"] = out.groupby("bin_id")["length"].transform("sum").rsub(capacity)
        return out

    fields = "doc_id long, piece int, start long, length long, bin_id string, offset long"
    packed = rest.groupBy("shard").applyInPandas(run, fields + ", residual long")
    return packed.unionByName(full.withColumn("residual", F.lit(0).cast("long")))
