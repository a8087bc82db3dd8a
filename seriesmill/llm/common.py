"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.shared import shared_dir

#: Keys holding more than 1/HOT_PARTS of all rows count as hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1000


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, so that lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remembered(key: tuple, make: Callable):
    """What ``make`` gave for ``key``, kept by a worker process from task to task."""
    store = sys.modules.setdefault("seriesmill_worker", types.ModuleType("seriesmill_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(rows: DataFrame, key: str, limit: int, *order: Column | str) -> DataFrame:
    """At most ``limit`` rows, those of smallest hash of ``key``, ties by ``order``.

    Of many rows only those with a hash in the share that holds about four times
    the limit are sorted, so tasks send few rows to the driver.
    """
    n, hashed = rows.count(), F.xxhash64(key)
    if n > 4 * limit:
        rows = rows.where(hashed < F.lit(int(-(2**63) + 2**64 * 4 * limit / n)).cast("long"))
    return rows.orderBy(hashed, *order).limit(limit)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (src, dst long): one row (id, component) per node, component the smallest id.

    Each round maps every node to the smallest id among itself and its
    neighbours, follows those maps to their roots, a step four times as far as
    the one before, and contracts the links by the roots. Of the nodes left at
    least half go each time, for a root with a link has a neighbour that is
    none; a chain in order takes one round. Steps are written to the shared
    folder. Only minima are grouped, so a node of any degree costs one row a
    task. Null ends, loops and repeated links change nothing; no links give an
    empty table.
    """
    links = links.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst")
    both = stored(links.select("src", "dst").union(links.select("dst", "src")).distinct(), "links")
    labels = None
    while True:
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        parents = _roots(stored(low.select(F.col("src").alias("id"), F.least("src", "low").alias("component")), "parents"))
        if labels is None:
            labels = parents
        else:
            labels = stored(_followed(labels, parents), "labels")
        left, right = parents.toDF("src", "a"), parents.toDF("dst", "b")
        both = stored(both.join(left, "src").join(right, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
        if both.isEmpty():
            return labels


def _followed(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """``labels`` with each component replaced by its own in ``parents``; roots need no row there."""
    inner = parents.where("id <> component").select(F.col("id").alias("component"), F.col("component").alias("next"))
    return labels.join(inner, "component", "left").select("id", F.coalesce("next", "component").alias("component"))


def _roots(parents: DataFrame) -> DataFrame:
    """``parents`` (id, component <= id) with each component followed to its root, by composing the map with itself."""
    while True:
        inner = parents.where("id <> component")
        deep = inner.join(inner.select(F.col("id").alias("component")), "component", "left_semi")
        if deep.isEmpty():
            return parents
        parents = stored(_followed(parents, parents), "parents")
        parents = stored(_followed(parents, parents), "parents")


def with_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key, ``size`` its number of rows) on ``key``.

    Groups above total/HOT_PARTS rows, of which there are fewer than HOT_PARTS,
    are broadcast; rows of all others meet their group in a shuffle whose
    largest key is that small.
    """
    hot = groups.where(F.col(size) > total / HOT_PARTS).limit(HOT_PARTS)
    names = [c for c in groups.columns if c != key]
    first = rows.join(F.broadcast(hot), key, "left")
    rest = groups.where(F.col(size) <= total / HOT_PARTS)
    was_hot = F.col(size).isNotNull()
    hit = first.where(was_hot)
    miss = first.where(~was_hot).drop(*names).join(rest, key, "left")
    return hit.unionByName(miss)
