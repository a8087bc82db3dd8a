"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesmill.llm.common import least_hashes, stored

PIVOTS = 256  # at most; drawn by hash of the id from a sample of 4 * PIVOTS vectors
APART = 0.8  # largest cosine of two pivots' vectors, so that a crowd of vectors takes one place
PREFIX = 64  # nearest pivots that represent a vector, 255 at most
RECALL = 0.96  # share of the sample queries' true neighbours that the reranked part of a block must hold
SAMPLE = 64  # queries that are compared with all vectors to find that part
LEAST = 100  # vectors of a block that are reranked at least
BLOCK = 8192  # vectors of a block, about
QUERIES = 4096  # queries that meet a block at a time, about


def _usable(vectors: DataFrame, is_query: Column, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v, n, q) of the vectors that take part: finite, not zero, with an id; n rows are alike, q if one is a query."""
    v = F.col(embedding).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("q"))


def _level(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a component more that makes all as long as the longest, so that inner products order them as angles do."""
    return np.c_[x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))]


def _pivots(usable: DataFrame, longest: float) -> np.ndarray:
    rows = least_hashes(usable, "vec_id", 4 * PIVOTS, "vec_id", "v").collect()
    if not rows:
        return np.zeros((0, 0))
    sizes = np.bincount([len(r.v) for r in rows])
    found = np.unique(np.array([r.v for r in rows if len(r.v) == sizes.argmax()]), axis=0)
    found = found[np.random.default_rng(0).permutation(len(found))]
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    chosen: list[int] = []
    for i, v in enumerate(unit):
        if len(chosen) < PIVOTS and (not chosen or np.max(unit[chosen] @ v) <= APART):
            chosen.append(i)
    pivots = _level(found[chosen], longest)
    return pivots / np.linalg.norm(pivots, axis=1, keepdims=True)


def _order(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype("<u2")


class Block:
    """A shard of the index: vectors, and the inverted file of each pivot with every vector's places left in its prefix."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray, near: np.ndarray, pivots: int):
        self.ids, self.times, self.x, self.prefix = ids, times, x, near.shape[1]
        self.unit = (x / max(np.sqrt((x * x).sum(axis=1).max()), 1e-300)).astype(np.float32)
        self.files = np.zeros((pivots, len(ids)), np.uint8)
        self.left = np.repeat(np.arange(self.prefix, 0, -1, dtype=np.uint8)[:, None], len(ids), axis=1)  # whole rows: twice as fast as numbers
        for rank in range(self.prefix):
            self.files[near[:, rank], np.arange(len(ids))] = self.prefix - rank

    @classmethod
    def of(cls, row, dim: int, prefix: int, pivots: int) -> Block:
        ids = np.frombuffer(row.ids, "<i8")
        return cls(ids, np.frombuffer(row.times, "<i8"), np.frombuffer(row.x, "<f8").reshape(len(ids), dim), np.frombuffer(row.near, "<u2").reshape(len(ids), prefix), pivots)

    def shared(self, near: np.ndarray) -> np.ndarray:
        """What a query's pivots and each vector's have in common; prefix * (prefix + 1) less twice this is the footrule distance."""
        total, part, least = np.zeros(len(self.ids), np.uint16), np.zeros(len(self.ids), np.uint8), np.empty(len(self.ids), np.uint8)
        room = 255 // self.prefix  # places that a byte has room for
        for rank, pivot in enumerate(near):
            np.minimum(self.files[pivot], self.left[rank], out=least)
            np.add(part, least, out=part)
            if rank % room == room - 1 or rank == len(near) - 1:
                total += part
                part[:] = 0
        return total

    def best(self, query: np.ndarray, own: int, chosen: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` largest inner products among ``chosen``, rows repeated as often as they occur; the query's own row once less."""
        if len(chosen) > 2 * k + 2:  # only what may be among the k, by single precision, is scored in double
            rough = self.unit[chosen] @ (query / np.sqrt((query * query).sum())).astype(np.float32)
            edge = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            chosen = chosen[rough >= edge - 1e-6 * len(query)]
        times = np.minimum(self.times[chosen], k + 1)
        same = np.flatnonzero((self.ids[chosen] == own) & (self.x[chosen] == query).all(axis=1))
        times[same[:1]] -= 1
        score = _scores(query, self.x[chosen])
        order = np.lexsort((self.ids[chosen], -score))
        rows = np.repeat(order, times[order])[:k]
        return chosen[rows], score[rows]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed by component in order, so that a pair's score depends on it alone."""
    return np.cumsum(x * q, axis=1)[:, -1]


def _most(shared: np.ndarray, ids: np.ndarray, take: int) -> np.ndarray:
    """The ``take`` rows of largest ``shared``, ties to smaller ids."""
    if take >= len(shared):
        return np.arange(len(shared))
    above = np.cumsum(np.bincount(shared)[::-1])  # vectors that have as much in common or more, from the most
    edge = len(above) - 1 - int(np.searchsorted(above, take))
    sure, tied = np.flatnonzero(shared > edge), np.flatnonzero(shared == edge)
    tied = tied[np.argsort(ids[tied], kind="stable")]
    return np.r_[sure, tied[: take - len(sure)]]


def _table(found: Iterable[tuple[int, Block, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """One table of what queries found in a block: (query, block, rows, scores) each."""
    ids, blocks, rows, scores = zip(*found, strict=True)
    n = [len(r) for r in rows]
    return pd.DataFrame({"query_id": np.repeat(ids, n), "vec_id": np.concatenate([b.ids[r] for b, r in zip(blocks, rows, strict=True)]), "score": np.concatenate(scores), "copy": np.concatenate([np.arange(k) for k in n])})


def _first(found: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows; cut before and after the shuffle."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query row, by largest inner product: query_id, rank from 1, vec_id, score.

    All vectors get a further component that makes them equally long, so that
    the order by angle is that by inner product; a vector is then represented by
    its PREFIX nearest pivots in order. Vectors are dealt into blocks by hash of
    the row, which cuts up any crowded region; a block is stored with an
    inverted file for each pivot, which has every vector's rank. A query reads
    its own pivots' files, adds up the footrule distance (a pivot outside a
    prefix counts as one past its end), and the block's nearest share, at least
    LEAST and ``k``, are scored with the original vectors. That share follows
    the data: SAMPLE queries are compared with all vectors, and the share is the
    one within which ``recall`` of their true neighbours lie; one block of work
    a query is thus as small as the data allow. A query's best of all blocks are
    merged by score, then vec_id.

    Pivots come from a sample of at most 4 * PIVOTS vectors. Queries and blocks
    meet in tiles of bounded size. Rows with equal id and vector are stored once
    with their number and returned as often as they occur. A query's own row is
    no candidate; other rows of its id are. Where an id repeats with several
    vectors, the least of them is the query. Vectors null, zero, holding null or
    non-finite components, of another length than the pivots' or without an id
    take no part. Fewer candidates than ``k`` give them all; an empty table gives
    an empty table.
    """
    usable = stored(_usable(vectors, is_query, vec_id, embedding), "vectors")
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest = usable.agg(F.max(size).alias("n")).first().n or 0.0
    pivots = _pivots(usable, longest)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    prefix, dim = min(PREFIX, len(pivots)), pivots.shape[1] - 1
    usable = usable.where(F.size("v") == dim)
    blocks = max(1, -(-usable.count() // BLOCK))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy())
        order = sorted(range(len(x)), key=lambda i: (pdf["vec_id"].iat[i], x[i].tobytes()))
        x = x[order]
        near = _order(_level(x, longest), pivots, prefix)
        row = {"block": int(pdf["block"].iloc[0]), "ids": pdf["vec_id"].to_numpy("<i8")[order].tobytes(), "times": pdf["n"].to_numpy("<i8")[order].tobytes(), "x": x.astype("<f8").tobytes(), "near": near.tobytes()}
        return pd.DataFrame([row])

    placed = usable.select("vec_id", "v", "n", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"))
    index = stored(placed.groupBy("block").applyInPandas(build, "block int, ids binary, times binary, x binary, near binary"), "blocks")
    queries = stored(usable.where("q").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    share = _share(index, queries, pivots, prefix, longest, k, recall)
    parts = max(1, -(-queries.count() // QUERIES))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        return pd.DataFrame([{"part": int(pdf["part"].iloc[0]), "queries": pdf["vec_id"].to_numpy("<i8").tobytes(), "q": np.stack(pdf["v"].to_numpy()).astype("<f8").tobytes()}])

    asked = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(pack, "part int, queries binary, q binary")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(blocks * parts, "block", "part")
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(blocks * parts, "block", "part")

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                block = Block.of(row, dim, prefix, len(pivots))
                ids = np.frombuffer(row.queries, "<i8")
                q = np.frombuffer(row.q, "<f8").reshape(len(ids), dim)
                near = _order(np.c_[q, np.zeros(len(q))], pivots, prefix)
                take = max(int(np.ceil(share * len(block.ids))), LEAST, k + 1)
                yield _table((ids[i], block, *block.best(q[i], ids[i], _most(block.shared(near[i]), block.ids, take), k)) for i in range(len(ids)))

    found = left.join(right, ["block", "part"]).mapInPandas(meet, "query_id long, vec_id long, score double, copy long")
    return _first(found, k).select("query_id", "rank", "vec_id", "score")


def _share(index: DataFrame, queries: DataFrame, pivots: np.ndarray, prefix: int, longest: float, k: int, recall: float) -> float:
    """The share of a block, nearest first by footrule distance, that holds ``recall`` of sample queries' true neighbours."""
    sample = least_hashes(queries, "vec_id", SAMPLE, "vec_id").collect()
    if not sample:
        return 1.0
    dim = pivots.shape[1] - 1
    q = np.array([r.v for r in sample])
    near = _order(np.c_[q, np.zeros(len(q))], pivots, prefix)

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                block, found, places = Block.of(row, dim, prefix, len(pivots)), [], []
                for i, r in enumerate(sample):
                    place = np.empty(len(block.ids))
                    place[np.lexsort((block.ids, -block.shared(near[i]).astype(np.int32)))] = np.arange(1, len(place) + 1) / len(place)
                    rows, score = block.best(q[i], r.vec_id, np.arange(len(place)), k)
                    found.append((r.vec_id, block, rows, score))
                    places.append(place[rows])
                yield _table(found).assign(place=np.concatenate(places))

    found = index.mapInPandas(compare, "query_id long, vec_id long, score double, copy long, place double")
    return _first(found, k).agg(F.percentile("place", recall).alias("share")).first().share or 1.0
