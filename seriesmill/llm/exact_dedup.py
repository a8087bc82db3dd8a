"""Exact deduplication against an immutable snapshot screened by static binary-fuse filters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.llm.common import stored, text_or_empty, with_hot

SHARD_KEYS = 500_000  # keys of a filter; a task builds or probes one filter at a time
SALT_ROWS = 256  # rows of a group that meet one copy of its representative
SEMI_KEYS = 1_000_000  # groups whose 8-byte keys may be broadcast to keep other texts out of the shuffle


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of multiplications and shifts over key + seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


class BinaryFuse8:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints over distinct 64-bit keys.

    Every stored key is found; another key passes with a chance of 1/256. The
    array is solved by peeling: slots held by one key are taken off in rounds of
    whole arrays, then filled in reverse.
    """

    def __init__(self, seed: int, segment: int, count: int, cells: np.ndarray):
        self.seed, self.segment, self.count, self.cells = seed, segment, count, cells

    @staticmethod
    def _slots(mixed: np.ndarray, segment: int, count: int) -> np.ndarray:
        start = ((mixed >> np.uint64(32)) * np.uint64(count) >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        offsets = [(mixed >> np.uint64(s) & mask).astype(np.int64) for s in (0, 18, 36)]
        return np.stack([start + i * segment + o for i, o in enumerate(offsets)], axis=1)

    @staticmethod
    def _prints(mixed: np.ndarray) -> np.ndarray:
        return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        segment = 1 << min(18, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
        for seed in range(1, 200):
            room = int(n * factor * (1 + 0.01 * (seed // 8))) + 3 * segment
            count = max(1, -(-room // segment) - 2)
            if (cells := cls._solve(keys, seed, segment, count)) is not None:
                return cls(seed, segment, count, cells)
        raise RuntimeError(f"no binary-fuse filter found for {n} keys")

    @classmethod
    def _solve(cls, keys: np.ndarray, seed: int, segment: int, count: int) -> np.ndarray | None:
        n, size = len(keys), (count + 2) * segment
        mixed = _mixed(keys, seed)
        slots, prints = cls._slots(mixed, segment, count), cls._prints(mixed)
        degree = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, dtype=np.int64)  # the xor of a slot's keys' numbers is the key once it is alone
        for column in slots.T:
            np.bitwise_xor.at(held, column, np.arange(n))
        alone = np.flatnonzero(degree == 1)
        rounds, left = [], n
        while len(alone):
            owner = held[alone]
            owner, first = np.unique(owner, return_index=True)
            own = alone[first]
            rounds.append((owner, own))
            left -= len(owner)
            touched = slots[owner].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(held, touched, np.repeat(owner, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if left:
            return None
        cells = np.zeros(size, dtype=np.uint8)
        for owner, own in reversed(rounds):
            at = slots[owner]
            cells[own] = prints[owner] ^ cells[at[:, 0]] ^ cells[at[:, 1]] ^ cells[at[:, 2]] ^ cells[own]
        return cells

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mixed = _mixed(np.asarray(keys, dtype=np.uint64), self.seed)
        at = self._slots(mixed, self.segment, self.count)
        return self._prints(mixed) == (self.cells[at[:, 0]] ^ self.cells[at[:, 1]] ^ self.cells[at[:, 2]])


def digest_sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Snapshot:
    """An immutable set of digests: ``buckets`` (digest, key, shard, n, keep_id), ``filters`` (shard, seed, segment, count, cells)."""

    def __init__(self, buckets: DataFrame, filters: DataFrame, shards: int):
        self.buckets, self.filters, self.shards = buckets, filters, shards


def grouped(digests: DataFrame) -> DataFrame:
    """One row a digest: n, keep_id. Rows of a digest are counted before they are shuffled."""
    return digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))


def _sharded(groups: DataFrame, shards: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.select("*", key.alias("key"), F.pmod(key, F.lit(shards)).cast("int").alias("shard"))


def build_snapshot(digests: DataFrame, shard_keys: int = SHARD_KEYS) -> Snapshot:
    """Buckets and filters over (doc_id, digest); shards follow the number of distinct digests."""
    groups = stored(grouped(digests), "snapshot-groups")
    shards = max(12, -(-groups.count() // shard_keys))
    buckets = _sharded(groups, shards)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuse8.build(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "count": [f.count], "cells": [f.cells.tobytes()]})

    filters = buckets.select("shard", "key").groupBy("shard").applyInPandas(build, "shard int, seed int, segment int, count int, cells binary")
    return Snapshot(buckets, stored(filters, "snapshot-filters"), shards)


def screen(snapshot: Snapshot, incoming: DataFrame) -> DataFrame:
    """Marks each row of ``incoming`` (one a digest) with ``maybe``: whether its shard's filter holds its key."""

    def probe(filters: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        maybe = np.zeros(len(rows), dtype=bool)
        for f in filters.itertuples():
            maybe |= BinaryFuse8(f.seed, f.segment, f.count, np.frombuffer(f.cells, np.uint8)).contains(rows["key"].to_numpy().view(np.uint64))
        return rows.assign(maybe=maybe)

    keyed = _sharded(incoming, snapshot.shards)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return snapshot.filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(probe, f"{fields}, maybe boolean")


def exact_dedup(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = digest_sha256, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups equal texts of a snapshot and an incoming batch; of each group the largest doc_id stays.

    ``in_snapshot`` tells the snapshot's rows (null: incoming). Returns one row
    per input row: doc_id, keep_id, group_size, kept, digest. The snapshot's
    digests are built into binary-fuse filters; the batch's own copies are
    grouped first, each of its digests is screened, and only positives are
    joined to the exact buckets. All members of groups of two or more are then
    compared byte by byte with the representative, salted by group size; rows
    whose bytes differ under an equal digest are grouped by text instead.
    Null text counts as empty, so all empty and null texts are one group. A
    null doc_id is kept only in a group without any other. Rows that repeat a
    doc_id and text form a group, and each row with the largest doc_id counts as
    kept. An empty table gives an empty table; other columns are not read.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(in_snapshot, F.lit(False)).alias("old"), digest(body).alias("digest"))
    rows = stored(rows, "digests")
    total = rows.count()
    snapshot = build_snapshot(rows.where("old"))
    batch = stored(screen(snapshot, grouped(rows.where("NOT old"))), "screened")
    mine = batch.select("digest", "maybe", F.col("n").alias("new_n"), F.col("keep_id").alias("new_keep"))
    known = mine.where("maybe").join(snapshot.buckets.select("digest", "n", "keep_id"), "digest", "full")
    merged = known.select("digest", (F.coalesce("n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias("group_size"), F.greatest("keep_id", "new_keep").alias("keep_id"))
    groups = merged.union(mine.where("NOT maybe").select("digest", F.col("new_n").alias("group_size"), F.col("new_keep").alias("keep_id")))
    groups = stored(groups.where("group_size > 1"), "copies")
    members = with_hot(rows.select("doc_id", "digest"), groups, "digest", "group_size", total)
    single = members.where("group_size IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")

    # Bytes: only members of groups travel with their texts.
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("body"), digest(body).alias("digest"))
    if groups.count() <= SEMI_KEYS:
        keys = groups.select(F.xxhash64("digest").alias("key"))
        texts = texts.withColumn("key", F.xxhash64("digest")).join(F.broadcast(keys), "key", "left_semi").drop("key")
    member = with_hot(texts, groups, "digest", "group_size", total).where("group_size IS NOT NULL")
    member = stored(member, "members")
    lead = member.where("doc_id <=> keep_id").groupBy("digest", "group_size").agg(F.min("body").alias("lead")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    member = member.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.length("body")), salts).cast("int"))
    checked = member.join(lead.select("digest", "salt", "lead"), ["digest", "salt"]).withColumn("same", F.col("body") == F.col("lead"))
    odd = stored(checked.where("NOT same").select("doc_id", "digest", "body"), "odd")
    if odd.isEmpty():
        return single.union(checked.select("doc_id", "keep_id", "group_size", "digest")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    evens = checked.where("same").select("doc_id", "digest")
    by_digest = evens.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    by_text = odd.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    evens = evens.join(by_digest, "digest").select("doc_id", "keep_id", "group_size", "digest")
    odds = odd.join(by_text, ["digest", "body"]).select("doc_id", "keep_id", "group_size", "digest")
    return single.union(evens).union(odds).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
