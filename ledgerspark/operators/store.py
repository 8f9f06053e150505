"""The versioned store around revisions: typed writers, identities, observations, seals, receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import exact_decimal, strict_date, utc_text
from .versions import append, latest

#: Per kind the payload's fields: name, kind of value, whether it may be missing.
KINDS = {
    "supplier": (("name", "text", False), ("country_code", "text", False), ("status", "text", True), ("tier", "text", True)),
    "department": (("name", "text", False), ("code", "text", True)),
    "line": (("description", "text", False), ("po_date", "date", False), ("quantity", "number", False), ("unit_price", "number", False), ("amount", "number", False)),
}


class Refused(ValueError):
    """A payload, identity or seal that the store does not take; the message names the rule."""


def _field(kind: str, value: Column) -> Column:
    if kind == "date":
        return F.date_format(strict_date(value), "yyyy-MM-dd")
    if kind == "number":
        return exact_decimal(value, 20, 6).cast("string")
    return F.when(F.length(F.trim(value)) > 0, value)


def normalised(payloads: DataFrame, kind: str, column: str = "payload") -> DataFrame:
    """JSON payloads in full and in one form; `fault` names what is wrong and is null if nothing is.

    Every field has to be there (null where it may be missing), no other may be;
    values are strict texts, dates and decimals, which are written at six places.
    """
    fields = KINDS[kind]
    json = F.col(column)
    keys = F.array_sort(F.json_object_keys(json))
    fault = F.when(keys.isNull(), "not_an_object").when(keys != F.array(*[F.lit(n) for n in sorted(n for n, *_ in fields)]), "fields")
    values = []
    for name, form, may_miss in fields:
        raw = F.get_json_object(json, f"$.{name}")
        value = _field(form, raw)
        bad = raw.isNotNull() & value.isNull()
        fault = fault.when(bad if may_miss else value.isNull(), name)
        values.append(value.alias(name))
    made = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    return payloads.withColumn("fault", fault).withColumn(column, F.when(F.col("fault").isNull(), made).otherwise(json))


def write(versions: DataFrame, changes: DataFrame, kind: str) -> DataFrame:
    """Changes (owner, expected, payload) of one kind as new revisions; one fault or stale head refuses them all."""
    clean = normalised(changes, kind)
    first = clean.where(F.col("fault").isNotNull()).select("fault").first()
    if first:
        raise Refused(first["fault"])
    return append(versions, clean.drop("fault"))


def identities(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per incoming identity (namespace, external, entity) what becomes of it.

    registered: new; same: known with this entity, or an open one without a claim;
    resolved: known without entity, now given one; refused: resolved before to
    another entity, or claimed twice here.
    """
    key = ["namespace", "external"]
    claims = incoming.groupBy(*key).agg(F.count_distinct("entity").alias("claims"), F.max("entity").alias("entity"))
    d = claims.join(known.select(*key, F.col("entity").alias("before"), F.lit(True).alias("known")), key, "left")
    answer = (
        F.when(F.col("claims") > 1, "refused").when(F.col("known").isNull(), "registered").when(F.col("before").isNull() & F.col("entity").isNotNull(), "resolved")
        .when(F.col("entity").isNull() | F.col("entity").eqNullSafe(F.col("before")), "same").otherwise("refused")
    )
    return d.select(*key, F.when(answer == "refused", F.col("before")).otherwise(F.coalesce("before", "entity")).alias("entity"), answer.alias("answer"))


def observe(observations: DataFrame, incoming: DataFrame) -> DataFrame:
    """Source observations appended, each (source, external, content hash) once."""
    key = ["source", "external", "content_hash"]
    d = incoming.withColumn("content_hash", F.sha2("content", 256)).dropDuplicates(key)
    return observations.unionByName(d.join(observations, key, "left_anti").select(*observations.columns))


def snapshot_digest(members: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Per snapshot the SHA-256 of its members' owners and revisions as an ordered JSON list."""
    listed = F.array_sort(F.collect_list(F.struct("owner", "revision_no")))
    return members.groupBy(snapshot).agg(F.count("*").alias("members"), F.sha2(F.to_json(listed), 256).alias("digest"))


def sealed(snapshots: DataFrame, members: DataFrame, ident: str) -> DataFrame:
    """The open snapshot `ident` with its digest and the state `sealed`; a sealed or unknown one is refused."""
    row = snapshots.where(F.col("snapshot_id") == ident).select("state").first()
    if row is None or row["state"] != "open":
        raise Refused("unknown snapshot" if row is None else "sealed already")
    digests = snapshot_digest(members.where(F.col("snapshot_id") == ident)).select("snapshot_id", F.col("digest").alias("new"))
    return snapshots.join(digests, "snapshot_id", "left").withColumn("state", F.when(F.col("snapshot_id") == ident, "sealed").otherwise(F.col("state"))).withColumn("digest", F.coalesce("new", "digest")).drop("new")


def add_members(snapshots: DataFrame, members: DataFrame, new: DataFrame) -> DataFrame:
    """Members of open snapshots only, none recorded after the cutoff."""
    d = new.join(snapshots.select("snapshot_id", "state", "cutoff"), "snapshot_id", "left")
    first = d.where((F.coalesce("state", F.lit("unknown")) != "open") | (F.col("recorded") > F.col("cutoff"))).first()
    if first:
        raise Refused("late member" if first["state"] == "open" else "not open")
    return members.unionByName(new.select(*members.columns))


def rebuilt(versions: DataFrame) -> Column:
    """The receipt's JSON as the version's own columns give it."""
    return F.to_json(F.struct(F.col("version_id").alias("id"), F.col("owner"), F.col("revision_no").alias("revision"), F.col("status"), F.col("cents")))


def receipts(versions: DataFrame) -> DataFrame:
    """One receipt per version, under a key, with the hash of its content."""
    body = rebuilt(versions)
    return versions.select(F.concat_ws("/", F.col("owner").cast("string"), F.col("revision_no").cast("string")).alias("key"), "version_id", body.alias("body"), F.sha2(body, 256).alias("hash"))


def receipt_faults(issued: DataFrame, versions: DataFrame) -> DataFrame:
    """Receipts whose body is not what their version gives, or whose hash is not that of their body."""
    now = receipts(versions).select("version_id", F.col("body").alias("want"))
    d = issued.join(now, "version_id", "left")
    fault = F.when(F.col("want").isNull(), "no version").when(~F.col("body").eqNullSafe(F.col("want")), "body").when(F.col("hash") != F.sha2("body", 256), "hash")
    return d.withColumn("fault", fault).where(F.col("fault").isNotNull()).select("key", "fault")


def lookup(issued: DataFrame, asked: DataFrame, key: str = "key") -> DataFrame:
    """For each asked key or id the receipt, or `absent`."""
    d = asked.select(key).join(issued, key, "left")
    return d.withColumn("answer", F.when(F.col("hash").isNull(), "absent").otherwise("found"))


def history_page(versions: DataFrame, size: int, after: tuple | None = None) -> tuple[list, tuple | None]:
    """A page of the newest versions and the cursor of the next; their order is checked."""
    d = versions
    if after:
        d = d.where(F.struct("recorded", "version_id") < F.struct(F.lit(after[0]), F.lit(after[1])))
    rows = d.orderBy(F.desc("recorded"), F.desc("version_id")).limit(size + 1).collect()
    page = rows[:size]
    if any((a["recorded"], a["version_id"]) <= (b["recorded"], b["version_id"]) for a, b in zip(page, page[1:])):
        raise Refused("order")
    return page, (page[-1]["recorded"], page[-1]["version_id"]) if len(rows) > size else None


def provision(catalog: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Per wanted entry create, keep or conflict, by comparing all other fields."""
    rest = [c for c in wanted.columns if c != key]
    d = wanted.join(catalog.select(F.col(key), F.struct(*rest).alias("__old")), key, "left")
    answer = F.when(F.col("__old").isNull(), "create").when(F.col("__old").eqNullSafe(F.struct(*rest)), "keep").otherwise("conflict")
    return d.withColumn("answer", answer).drop("__old")


def audit_events(versions: DataFrame) -> DataFrame:
    """The audit event of each version: create for the first, revise for later ones, with the instant in UTC."""
    first = F.row_number().over(W.partitionBy("owner").orderBy("revision_no")) == 1
    return versions.select("version_id", F.when(first, "create").otherwise("revise").alias("operation"), utc_text(F.col("recorded").cast("timestamp")).alias("at"))


def heads(versions: DataFrame) -> DataFrame:
    """The last revision of each owner."""
    return latest(versions)
