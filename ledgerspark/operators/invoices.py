"""Invoices, their TRAIN-only aggregates and the nineteen features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import hmac_sha256, is_close
from ..sources import tables
from ..sources.shared import SMALL, small, written
from . import carried, profile

#: The SHA-256 thresholds of 70 % and 85 %.
TRAIN_BELOW, VAL_BELOW = "b" + "3" * 63, "d" + "9" * 63
FEATURES = (
    "amount", "log_amount", "supplier_age_days", "supplier_frequency", "country_frequency", "amount_vs_supplier_mean", "supplier_amount_zscore", "department_frequency", "amount_vs_department_mean",
    "supplier_department_frequency", "payment_terms_days", "invoice_type_encoded", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_weekend",
)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line as an invoice, with its split by the hash of its id."""
    li = tables.read(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_linestatus", "l_returnflag"])
    orders = tables.read(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    supplier = tables.read(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    nation = tables.read(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    d = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    ident = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    h = F.sha2(ident, 256)
    return d.select(
        ident.alias("invoice_id"), F.col("l_suppkey").alias("supplier_id"), F.col("o_orderpriority").alias("department_id"), F.col("n_name").alias("country"),
        F.col("l_extendedprice").alias("amount"), F.col("l_shipdate").cast("date").alias("invoice_date"), (F.col("l_linenumber") * 5 % 24).alias("submission_hour"),
        F.concat(F.lit("NET"), (30 * (1 + F.col("l_linenumber") % 3)).cast("string")).alias("payment_terms"), F.col("l_linestatus").alias("invoice_type"),
        (F.col("l_suppkey") * 37 % 3650).alias("supplier_age_days"), (F.col("l_returnflag") == "R").cast("int").alias("is_fraud"), F.col("l_returnflag").alias("fraud_type"),
        F.when(h < TRAIN_BELOW, "train").when(h < VAL_BELOW, "val").otherwise("test").alias("split"),
    )


def _cycle(value: Column, length: int) -> tuple[Column, Column]:
    angle = 2 * F.pi() * value / length
    return F.sin(angle), F.cos(angle)


def references(rows: DataFrame) -> dict[str, DataFrame]:
    """What TRAIN alone tells: per supplier, department, pair and country, and overall."""
    train = rows.where("split = 'train'")
    n, mean, std = F.count("*"), F.avg("amount"), F.stddev_samp("amount")
    return {
        "supplier": train.groupBy("supplier_id").agg(n.alias("sn"), mean.alias("smean"), std.alias("sstd"), F.first("country").alias("scountry")),
        "department": train.groupBy("department_id").agg(n.alias("dn"), mean.alias("dmean")),
        "pair": train.groupBy("supplier_id", "department_id").agg(n.alias("pn")),
        "country": train.where(F.col("country").isNotNull()).groupBy("country").agg(n.alias("cn")),
        "overall": train.agg(n.alias("gn"), mean.alias("gmean"), std.alias("gstd")),
    }


def featured(rows: DataFrame) -> DataFrame:
    """Ids, split, label and the nineteen features, from TRAIN's references only.

    rows is written once, since every reference reads it. The references of a
    supplier and a department are brought together first, so that the rows are
    joined once, and without a shuffle as long as these are few.
    """
    rows = written(rows, "invoices")
    r = references(rows)
    keys = ["supplier_id", "department_id"]
    of = rows.select(*keys).distinct().join(r["pair"], keys, "left").join(r["supplier"].drop("scountry"), "supplier_id", "left").join(r["department"], "department_id", "left")
    of, countries = small(written(of.withColumnsRenamed({k: f"__{k}" for k in keys}), "invoice-references")), small(written(r["country"].withColumnRenamed("country", "__country"), "countries"))
    same = F.col("supplier_id").eqNullSafe(F.col("__supplier_id")) & F.col("department_id").eqNullSafe(F.col("__department_id"))
    d = rows.join(of, same, "left").join(countries, F.col("country") == F.col("__country"), "left").crossJoin(F.broadcast(written(r["overall"], "overall")))  # one row
    weekday = F.weekday("invoice_date")
    hour, dow, month = _cycle(F.col("submission_hour"), 24), _cycle(weekday, 7), _cycle(F.month("invoice_date") - 1, 12)
    smean = F.coalesce("smean", "gmean")
    made = {
        "log_amount": F.log1p("amount"), "supplier_frequency": F.coalesce("sn", F.lit(0)), "country_frequency": F.coalesce("cn", F.lit(0)),
        "amount_vs_supplier_mean": F.col("amount") / smean, "supplier_amount_zscore": (F.col("amount") - smean) / F.coalesce(F.when(F.col("sstd") != 0, F.col("sstd")), F.col("gstd")),
        "department_frequency": F.coalesce("dn", F.lit(0)), "amount_vs_department_mean": F.col("amount") / F.coalesce("dmean", "gmean"), "supplier_department_frequency": F.coalesce("pn", F.lit(0)),
        "payment_terms_days": F.regexp_extract("payment_terms", r"([0-9]+)", 1).cast("int"), "invoice_type_encoded": F.when(F.col("invoice_type") == "O", 0).when(F.col("invoice_type") == "F", 1),
        "hour_sin": hour[0], "hour_cos": hour[1], "dow_sin": dow[0], "dow_cos": dow[1], "month_sin": month[0], "month_cos": month[1], "is_weekend": (weekday >= 5).cast("int"),
    }
    return d.withColumns(made).select("invoice_id", "split", "is_fraud", "fraud_type", *FEATURES)


def history_faults(r: dict[str, DataFrame]) -> DataFrame:
    """What contradicts itself in a history of references, one row per check: name, faults.

    Counts have to add up, weighted means and pooled deviations to agree with the
    overall ones, countries and pairs with their suppliers and departments.
    """
    g = r["overall"]
    s = r["supplier"].crossJoin(g)  # one row
    between = lambda n, m: n / (F.col("gn") - 1) * (m - F.col("gmean")) * (m - F.col("gmean"))
    spread = F.sqrt(F.sum(F.when(F.col("sn") > 1, (F.col("sn") - 1) / (F.col("gn") - 1) * F.col("sstd") * F.col("sstd")).otherwise(0.0) + between(F.col("sn"), F.col("smean"))))
    one = lambda c: F.when(c, 0).otherwise(1).cast("long")
    from_suppliers = s.agg(
        one(F.sum("sn") == F.max("gn")).alias("supplier_counts"), one(is_close(F.sum(F.col("sn") / F.col("gn") * F.col("smean")), F.max("gmean"))).alias("supplier_means"),
        one(is_close(spread, F.max("gstd"))).alias("pooled_deviation"), F.sum(F.when((F.col("sn") == 1) != F.col("sstd").isNull(), 1).otherwise(0)).alias("singleton_deviations"),
        F.sum(F.when(F.col("sstd") / F.sqrt("sn") > F.col("smean") * (1 + 1e-9), 1).otherwise(0)).alias("impossible_deviations"),
    )
    from_departments = r["department"].crossJoin(g).agg(one(F.sum("dn") == F.max("gn")).alias("department_counts"), one(is_close(F.sum(F.col("dn") / F.col("gn") * F.col("dmean")), F.max("gmean"))).alias("department_means"), one(F.sqrt(F.sum(between(F.col("dn"), F.col("dmean")))) <= F.max("gstd") * (1 + 1e-9)).alias("department_spread"))
    off = lambda d, a, b: d.agg(F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), 0).otherwise(1)).alias("n"))
    countries = off(r["supplier"].groupBy(F.col("scountry").alias("country")).agg(F.sum("sn").alias("n")).join(r["country"], "country", "full"), "n", "cn").select(F.coalesce("n", F.lit(0)).alias("country_counts"))
    by_supplier = off(r["pair"].groupBy("supplier_id").agg(F.sum("pn").alias("n")).join(r["supplier"], "supplier_id", "full"), "n", "sn").select(F.coalesce("n", F.lit(0)).alias("pair_suppliers"))
    by_department = off(r["pair"].groupBy("department_id").agg(F.sum("pn").alias("n")).join(r["department"], "department_id", "full"), "n", "dn").select(F.coalesce("n", F.lit(0)).alias("pair_departments"))
    row = from_suppliers
    for other in (from_departments, countries, by_supplier, by_department):
        row = row.crossJoin(other)  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("faults")) for c in row.columns])).alias("x")).select("x.*")


def drift(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per column the distance of TRAIN's and VAL's distributions and how many of VAL lie outside TRAIN's range; all columns in one pass, whose counts are written."""
    sides = rows.where(F.col("split").isin("train", "val"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")
    one = lambda side: F.sum((F.col("split") == side).cast("long"))
    counts = sides.select("split", values).where("v.x IS NOT NULL").groupBy("v.feature", "v.x").agg(one("train").alias("a"), one("val").alias("b"))
    counts = written(counts, "counts")  # read four times
    known = F.when(F.col("a") > 0, F.col("x"))
    ends = counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.min(known).alias("low"), F.max(known).alias("high"))
    run = profile.running(counts, {"a": "ua", "b": "ub"}, "x", "feature").join(F.broadcast(ends), "feature")  # a row for each column
    out = F.when((F.col("x") < F.col("low")) | (F.col("x") > F.col("high")), F.col("b")).otherwise(0)
    return run.groupBy("feature").agg(F.max(F.abs(F.try_divide("ua", "na") - F.try_divide("ub", "nb"))).alias("distance"), F.sum(out).alias("outside"))


def drawn_per_group(rows: DataFrame, group: str, ident: str, key: bytes, each: int) -> DataFrame:
    """`each` rows of every group, by keyed hash of group and id; a smaller group ends the query, its quota is not changed."""
    keyed = rows.select(group, ident, hmac_sha256(key, F.to_json(F.array(F.col(group).cast("string"), F.col(ident).cast("string")))).alias("__key"))
    sizes = written(rows.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n")), "sizes")
    # keys are spread evenly: all but surely the first ones lie below this, and only those are sorted
    share = F.least(F.lit(1.0), (each + 10 * each**0.5 + 10) / F.col("__n"))
    edge = F.when(share < 1, F.lpad(F.lower(F.hex(F.floor(share * (1 << 32)).cast("long"))), 8, "0"))
    same = lambda d: d[group].eqNullSafe(F.col("__group"))
    near = keyed.join(small(sizes.withColumn("__edge", edge)), same(keyed)).where(F.col("__edge").isNull() | (F.col("__key") < F.col("__edge"))).drop("__group", "__n", "__edge")
    first = lambda d: d.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("__key", ident))).where(F.col("place") <= each).drop("__key")
    chosen = written(first(near), "drawn")
    got = chosen.groupBy(F.col(group).alias("__of")).agg(F.count("*").alias("__got"))
    short = sizes.join(got, F.col("__group").eqNullSafe(F.col("__of")), "left").where(F.coalesce("__got", F.lit(0)) < F.least(F.lit(each), F.col("__n")))
    chosen = chosen if short.isEmpty() else first(keyed)
    enough = F.when(F.col("__n") < each, F.raise_error(F.concat(F.lit("too few rows in "), F.col("__group").cast("string"))).cast(rows.schema[group].dataType)).otherwise(F.col(group))
    return chosen.join(sizes, chosen[group].eqNullSafe(F.col("__group"))).withColumn(group, enough).drop("__group", "__n")


def blinded(rows: DataFrame, ident: str, key: bytes, prefix: str) -> DataFrame:
    """The id gives way to an alias of the keyed hash: prefix and 16 hexadecimal digits."""
    return rows.withColumn(ident, F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(hmac_sha256(key, F.col(ident).cast("string")), 1, 16))))


def boundaries(rows: DataFrame, score: str, ident: str, ks: list[int]) -> dict[int, tuple[float | None, object]]:
    """For each place k the row that takes it by score (highest first, missing last) and id: its score and id.

    Scores are counted, which finds the place's score; only the rows that share it
    are ordered by id (two values for each k on the driver), across tasks where they are many.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("x")).agg(F.count("*").alias("c"))
    run = written(profile.running(written(counts, "scores"), {"c": "upto"}, "x", descending=True), "running")
    scored = run.agg(F.sum("c")).first()[0] or 0
    found = {}
    for k in ks:
        at, before = (None, scored) if k > scored else run.where((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k)).select("x", F.col("upto") - F.col("c")).first()
        tied = rows.where(F.col(score).isNull() if at is None else F.col(score) == F.lit(at)).select(ident)
        skip = k - before - 1
        last = tied.orderBy(ident).offset(skip).limit(1) if skip < SMALL else carried.carried(tied, [F.asc(ident)], F.lit(1), "ahead").where(F.col("ahead") == skip).select(ident)
        found[k] = at, last.first()[0]
    return found


def pools(rows: DataFrame, ident: str, a: str, b: str, budgets: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per budget (percent) every row's pool: among the first of both scores, of one alone, or of neither.

    Ids are distinct. No row is ranked: each is compared with the row that takes
    the budget's last place.
    """
    d = written(rows.select(ident, a, b), "pooled")
    n = d.count()
    ks = {x: (n * x + 99) // 100 for x in budgets}
    edges = {x: boundaries(d, x, ident, sorted({k for k in ks.values() if 0 < k < n})) for x in (a, b)}

    def inside(x: str, k: int) -> Column:
        if not 0 < k < n:
            return F.lit(k > 0)
        score, last = edges[x][k]
        early = F.col(ident).isNull() | F.coalesce(F.col(ident) <= F.lit(last), F.lit(False))
        if score is None:  # the rows with a score are fewer than k
            return F.col(x).isNotNull() | early
        return F.coalesce((F.col(x) > F.lit(score)) | ((F.col(x) == F.lit(score)) & early), F.lit(False))

    pool = lambda k: F.when(inside(a, k) & inside(b, k), "both").when(inside(a, k), "a_only").when(inside(b, k), "b_only").otherwise("neither")
    made = F.array(*[F.struct(F.lit(x).alias("budget"), pool(k).alias("pool")) for x, k in ks.items()])
    return d.select(F.explode(made).alias("p"), ident).select("p.budget", "p.pool", ident)


def review_sample(pooled: DataFrame, ident: str, key: bytes, each: int = 25) -> DataFrame:
    """`each` rows of every budget and pool by keyed hash; a smaller pool ends the query."""
    named = pooled.withColumn("stratum", F.concat_ws("/", F.col("budget").cast("string"), "pool"))
    drawn = drawn_per_group(named, "stratum", ident, key, each)
    parts = F.split("stratum", "/")
    return drawn.select(parts[0].cast("int").alias("budget"), parts[1].alias("pool"), ident, "place")


def review_packets(members: DataFrame, context: DataFrame, ident: str, aliased: dict[str, str], key: bytes, reviewers: tuple[str, ...] = ("A", "B")) -> DataFrame:
    """Per reviewer a row for each drawn id, in an order of the reviewer's own, under aliases of the reviewer's own.

    aliased: prefix by column of context whose values give way to aliases; other
    columns of context are shown. An id that the context lacks ends the query; a
    missing value has no alias.
    """
    ids = members.select(ident).distinct()
    shown = profile.aligned(ids, context, ident).withColumn("reviewer", F.explode(F.array(*[F.lit(x) for x in reviewers])))
    keyed = lambda *parts: hmac_sha256(key, F.to_json(F.array(*[p.cast("string") for p in parts])))
    alias = lambda prefix, c, kind: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}-"), F.substring(keyed(F.lit(kind), F.col("reviewer"), F.col(c)), 1, 16)))
    d = shown.withColumn("place", F.row_number().over(W.partitionBy("reviewer").orderBy(keyed(F.lit("order"), F.col("reviewer"), F.col(ident)), ident)))  # quotas x pools rows
    d = d.withColumns({"case_id": alias("C", ident, "case"), **{c: alias(prefix, c, c) for c, prefix in aliased.items()}})
    return d.select("reviewer", "place", "case_id", *[c for c in context.columns if c != ident])


def standardised(rows: DataFrame, columns: tuple[str, ...], learn: Column) -> DataFrame:
    """The columns as distances from the mean of the rows to learn from, in their population deviations; none where that is 0."""
    told = rows.where(learn).agg(*[f(F.col(c).cast("double")).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("d", F.stddev_pop))])  # one row
    d = rows.crossJoin(told)
    return d.withColumns({c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__d_{c}")) for c in columns}).drop(*told.columns)
