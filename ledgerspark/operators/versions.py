"""Append-only revisions with point-in-time reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


class StaleHead(ValueError):
    """The expected head of an owner is not its current one (SQLSTATE 40001)."""


def latest(versions: DataFrame, at=None) -> DataFrame:
    """The last revision per owner, of those recorded until `at`. max_by reduces before the shuffle, unlike a window."""
    seen = versions if at is None else versions.where(F.col("recorded") <= F.lit(at))
    return seen.groupBy("owner").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "owner"]), "revision_no").alias("v")).select("owner", "v.*")


def append(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: owner, expected (revision or null for new owners) and payload columns. Returns the new revisions.

    A single writer is assumed; any stale expectation refuses the whole batch.
    """
    heads = latest(versions).select("owner", F.col("revision_no").alias("head"))
    d = changes.join(heads, "owner", "left")
    if not d.where(~F.col("head").eqNullSafe(F.col("expected"))).isEmpty():
        raise StaleHead("40001")
    if not d.groupBy("owner").count().where("count > 1").isEmpty():
        raise ValueError("two changes of one owner in a batch")
    return d.withColumn("revision_no", F.coalesce("head", F.lit(0)) + 1).drop("head", "expected")


def chain_faults(versions: DataFrame) -> DataFrame:
    """Owners whose revision numbers are not 1, 2, 3 and so on."""
    w = W.partitionBy("owner").orderBy("revision_no")
    d = versions.withColumn("before", F.coalesce(F.lag("revision_no").over(w), F.lit(0)))
    return d.where(F.col("revision_no") != F.col("before") + 1).select("owner", "revision_no")


def snapshot(versions: DataFrame, at) -> DataFrame:
    """Members as of a time, with the digest of each owner's member."""
    members = latest(versions, at)
    return members.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(members.columns))), 256))


def idempotent(seen: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Created, replay or conflict for each incoming key."""
    known = seen.select(key, F.col(content).alias("__known"))
    answer = F.when(F.col("__known").isNull(), "created").when(F.col("__known") == F.col(content), "replay").otherwise("conflict")
    return incoming.join(known, key, "left").withColumn("answer", answer).drop("__known")
