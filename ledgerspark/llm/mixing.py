"""Time-varying source mixing by inverted cumulative token demand (DataFrame functions only).

Every source has a target number of words (water-filled from its weight, at
most ``max_passes`` times its own size) and a weight schedule over training
time t in [0, 1]. Integrating the schedule gives the source's cumulative
demand D(t), scaled so that D(1) is the target. The source's documents, in a
seeded order, form a token stream that repeats as often as the target asks;
the word at stream offset x is trained on at t = D^-1(x). Sorting by t by range
partitions gives the training order.

Defined cases: a null text counts 0 words and is never taken; a null source is
a source of its own, last in order; equal rows are interchangeable and each is
placed; an empty table gives an empty result; the sums are exact integers, so
reruns agree.

Scale: the offset of a document needs a prefix sum over its source, and one
source may hold a third of all rows. Each source is therefore cut into
16^``bucket_digits`` hash buckets; bucket totals (one row per source and bucket) are
prefix-summed, and rows only meet the rows of their own bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Knots (t, relative weight) of piecewise-linear schedules, by rank of the source, repeating.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.5), (0.7, 0.5), (1.0, 2.5)),
)
_KEY = ["__null", "__source"]


def inverse_demand(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """t with (integral of the schedule up to t) / (whole integral) = x, for x in [0, 1]."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        areas.append(areas[-1] + (t1 - t0) * (w0 + w1) / 2)
    if areas[-1] <= 0 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule needs weights of at least 0 and a positive integral")
    y, out = x * F.lit(areas[-1]), F.lit(float(knots[-1][0]))
    for j in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[j], knots[j + 1]
        if areas[j + 1] == areas[j]:
            continue
        rest, slope = y - F.lit(areas[j]), (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + rest * F.lit(2 * slope)))
        out = F.when(y < F.lit(areas[j + 1]), F.lit(t0) + F.coalesce(F.try_divide(rest * 2, F.lit(w0) + root), F.lit(0.0))).otherwise(out)
    return out


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = 3) -> DataFrame:
    """Water-fill the words of all sources by weight, none above max_passes times its size.

    sources has one row per source: __null, __source, source_size. Sorted by
    size/weight, a source is capped exactly if the level left by the capped ones
    before it reaches its own cap, so running sums replace the iteration.
    """
    rank = F.row_number().over(W.orderBy(*_KEY)) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    before = W.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    cap = F.col("source_size") * F.lit(float(max_passes))
    ranked = sources.withColumn("__rank", rank).withColumn("__w", w).withColumn("__ratio", cap / F.col("__w"))
    leveled = ranked.withColumn(
        "__level",
        F.try_divide(
            F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)),
            F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        ),
    )
    open_ = F.col("__level") < F.col("__ratio")
    filled = leveled.withColumn("__open", F.max(F.when(open_, F.col("__level"))).over(whole))
    return filled.withColumn("target", F.when(open_, F.col("__open") * F.col("__w")).otherwise(cap))


def plan_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    schedules=SCHEDULES,
    max_passes: int = 3,
    bucket_digits: int = 3,
    seed: int = 17,
) -> DataFrame:
    """docs with its columns under __row plus size, source_size, target, taken, passes.

    passes lists, for each time the document is trained on, struct(words, position);
    the last pass of one document per source may be shorter than the document.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
        F.col(source_col).isNull().alias("__null"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("__order"),
        F.xxhash64(F.col(text_col)).alias("__tie"),
        size.alias("size"),
    ).withColumn("__bucket", F.substring("__order", 1, bucket_digits))
    sums = rows.groupBy(*_KEY, "__bucket").agg(F.sum("size").alias("__sum"))
    sources = targets(sums.groupBy(*_KEY).agg(F.sum("__sum").alias("source_size")), weights, max_passes)
    offsets = sums.withColumn(
        "__before",
        F.coalesce(F.sum("__sum").over(W.partitionBy(*_KEY).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).join(sources.select(*_KEY, "source_size", "target", "__rank"), _KEY)
    placed = rows.join(offsets.drop("__sum"), [*_KEY, "__bucket"])
    inside = W.partitionBy(*_KEY, "__bucket").orderBy("__order", "__tie").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("__start", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    asked = F.round("target").cast("long")

    def one_pass(p: Column) -> Column:
        begin = p * F.col("source_size") + F.col("__start")
        x = F.coalesce(F.try_divide(begin.cast("double"), F.col("target")), F.lit(0.0))
        t = inverse_demand(x, schedules[0])
        for k in range(1, len(schedules)):
            t = F.when(F.col("__rank") % len(schedules) == k, inverse_demand(x, schedules[k])).otherwise(t)
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__asked") - begin))
        return F.struct(words.cast("long").alias("words"), t.alias("position"))

    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_passes - 1)), one_pass), lambda p: p["words"] > 0)
    return (
        placed.withColumn("__asked", asked)
        .withColumn("passes", passes)
        .withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"]))
        .select("__row", "size", "source_size", "target", "taken", "passes")
    )


def training_order(plan: DataFrame) -> DataFrame:
    """One row per pass of a document, range-sorted by training position."""
    return plan.select("__row", "size", F.explode("passes").alias("p")).select("__row", "size", "p.words", "p.position").orderBy("position")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mix trains on them, in order: repeated, the last pass cut to its words.

    A cut pass keeps its first words, joined by single spaces.
    """
    text = options.get("text_col", "text")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(f"__row.`{text}`"), F.lit(f"({WORD})"), F.lit(1)), 1, F.col("words").cast("int")), " ")
    whole = F.col("words") >= F.col("size")
    cols = [F.when(whole, F.col(f"__row.`{c}`")).otherwise(cut).alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    return training_order(plan_mix(docs, **options)).select(*cols)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    plan = plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(
        F.col("__row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.round(F.get("passes", F.lit(0))["position"], 9).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


_INVERSE = """CASE rank % 3
    WHEN 0 THEN x
    WHEN 1 THEN CASE WHEN x < 0.625 THEN 2 * x / (1.5 + sqrt(2.25 - 2 * x)) ELSE 0.5 + 2 * (x - 0.625) / (1 + sqrt(1 - 2 * (x - 0.625))) END
    ELSE CASE WHEN x * 0.8 < 0.35 THEN x * 0.8 / 0.5 ELSE 0.7 + 2 * (x * 0.8 - 0.35) / (0.5 + sqrt(0.25 + 2 * (2 / 0.3) * (x * 0.8 - 0.35))) END
END"""

SQL = f"""
WITH sized AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources),
leveled AS (
  SELECT *, 3.0::DOUBLE * source_size / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
filled AS (
  SELECT source, source_size, rank,
    CASE WHEN level < ratio THEN w * max(CASE WHEN level < ratio THEN level END) OVER () ELSE 3.0::DOUBLE * source_size END AS target FROM leveled),
placed AS (
  SELECT s.*, f.source_size, f.target, f.rank, CAST(round(f.target) AS BIGINT) AS asked,
    CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN filled f ON s.source IS NOT DISTINCT FROM f.source),
dealt AS (
  SELECT *, start / target AS x,
    CAST(greatest(0, least(size, asked - start)) + greatest(0, least(size, asked - source_size - start)) + greatest(0, least(size, asked - 2 * source_size - start)) AS BIGINT) AS taken
  FROM placed)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round({_INVERSE}, 9) END AS position FROM dealt
"""
