"""One ranking per plan from several differently scaled scores: outranking net flow.

Each score becomes a percentile within its plan (ties share the middle of their ranks, a null or
NaN is below every value). Target a is preferred to b on one score by P(d), d the difference of
their percentiles: 0 up to ``indifference``, 1 from ``preference`` on, linear between. Its net flow
is the mean over all b of P(a - b) - P(b - a), weighted over the scores. The sums over all b are
exact: they follow from running counts and running sums of the sorted percentiles, looked up at
a's percentile plus and minus the two thresholds, so no pair of targets is ever formed.

A plan of any size is spread over many tasks: values are first aggregated, and running sums are
taken in two steps, over ordered buckets of values and within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACTORS = ("pagerank", "blast_radius_files", "git_churn", "complexity")
INDIFFERENCE, PREFERENCE = 0.02, 0.5
#: Buckets of values per octave; buckets of percentiles over the unit range.
PER_OCTAVE, PER_UNIT = 1024, 1024


def value_bucket(value: Column) -> Column:
    """A non-decreasing whole number of a double: its octave and place within it, mirrored for negative values."""
    clipped = F.least(F.greatest(F.abs(value), F.lit(1e-300)), F.lit(1e300))
    size = F.floor(F.log2(clipped) * PER_OCTAVE).cast("long") + F.lit(1100 * PER_OCTAVE)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0))


def running_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with ``run_x`` for every x of ``sums``: the sum of x over all rows of the group up to the row.

    Rows equal in (bucket, order) get running sums in no stated order, so ``order`` should be unique
    within a group. Only bucket totals of one group meet in a task.
    """
    totals = df.groupBy(*group, bucket).agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_o_{x}") for x in sums])
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(x).over(within).alias(f"_l_{x}") for x in sums])
    joined = local.join(offsets, [*group, bucket])
    return joined.select(*df.columns, *[(F.col(f"_l_{x}") + F.col(f"_o_{x}")).alias(f"run_{x}") for x in sums])


def percentiles(scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, value, c, n, r) of the distinct values: their count c, the group's count n, the percentile r in (0, 1)."""
    counts = scores.groupBy(*group, "value").agg(F.count("*").alias("c"))
    bucketed = counts.withColumn("_b", F.when(F.col("value").isNull(), -(1 << 40)).otherwise(value_bucket(F.col("value"))))
    ran = running_sums(bucketed, group, "_b", [F.col("value").asc_nulls_first()], ["c"])
    sizes = scores.groupBy(*group).agg(F.count("*").alias("n"))
    middle = (F.col("run_c") - F.col("c") / 2) / F.col("n")
    return ran.join(sizes, group).select(*group, "value", "c", "n", middle.alias("r"))


def flows(ranked: DataFrame, group: list[str], indifference: float, preference: float) -> DataFrame:
    """``ranked`` with ``flow``: the positive minus the negative preference summed over the whole group."""
    q, p = indifference, preference
    points = [("lo2", -p), ("lo1", -q), ("hi1", q), ("hi2", p)]
    marks = F.array(
        F.struct(F.lit("").alias("mark"), F.col("r").alias("x"), F.col("c").alias("c"), (F.col("c") * F.col("r")).alias("s")),
        *[F.struct(F.lit(k).alias("mark"), (F.col("r") + d).alias("x"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("s")) for k, d in points],
    )
    spread = ranked.select(*group, F.col("r").alias("at"), F.explode(marks).alias("m")).select(*group, "at", "m.*")
    spread = spread.withColumn("_b", F.floor(F.least(F.greatest(F.col("x"), F.lit(-1.0)), F.lit(2.0)) * PER_UNIT))
    ran = running_sums(spread, group, "_b", ["x", "mark", "at"], ["c", "s"]).where("mark <> ''")
    picked = [f for k, _ in points for f in (F.max(F.when(F.col("mark") == k, F.col("run_c"))).alias(f"c_{k}"), F.max(F.when(F.col("mark") == k, F.col("run_s"))).alias(f"s_{k}"))]
    looked = ran.groupBy(*group, F.col("at").alias("r")).agg(*picked)
    ramp = p - q
    above = F.col("c_lo2") + ((F.col("r") - q) * (F.col("c_lo1") - F.col("c_lo2")) - (F.col("s_lo1") - F.col("s_lo2"))) / ramp
    below = (F.col("n") - F.col("c_hi2")) + ((F.col("s_hi2") - F.col("s_hi1")) - (F.col("r") + q) * (F.col("c_hi2") - F.col("c_hi1"))) / ramp
    return ranked.join(looked, [*group, "r"]).select(*ranked.columns, (above - below).alias("flow"))


def net_flows(
    targets: DataFrame, plan: str = "plan_id", item: str = "node_id", factors: tuple[str, ...] = FACTORS,
    weights: tuple[float, ...] | None = None, indifference: float = INDIFFERENCE, preference: float = PREFERENCE,
) -> DataFrame:
    """(plan, item, net_flow), net_flow in [-1, 1].

    Exact duplicate rows count once. Where a plan lists an item several times with other values, each is
    ranked and the item keeps its best flow. Null scores and NaN rank lowest; a plan of one row has flow 0.
    Rows with a null plan or item are left out, other columns are ignored.
    """
    if not 0 <= indifference < preference:
        raise ValueError("thresholds must satisfy 0 <= indifference < preference")
    weights = weights or (1.0,) * len(factors)
    cleaned = [F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double") + F.lit(0.0)).alias(f"_f{k}") for k, f in enumerate(factors)]
    rows = targets.where(F.col(plan).isNotNull() & F.col(item).isNotNull()).select(F.col(plan).alias("_plan"), F.col(item).alias("_item"), *cleaned).distinct()
    listed = F.array(*[F.struct(F.lit(k).alias("factor"), F.col(f"_f{k}").alias("value")) for k in range(len(factors))])
    scores = rows.withColumn("_row", F.struct(*[f"_f{k}" for k in range(len(factors))])).select("_plan", "_item", "_row", F.explode(listed).alias("e")).select("_plan", "_item", "_row", "e.*")
    group = ["_plan", "factor"]
    ranked = percentiles(scores.select(*group, "value"), group)
    flowed = flows(ranked, group, indifference, preference).select(F.col("_plan").alias("p2"), F.col("factor").alias("f2"), F.col("value").alias("v2"), "flow", "n")
    matched = scores.join(flowed, (F.col("_plan") == F.col("p2")) & (F.col("factor") == F.col("f2")) & F.col("value").eqNullSafe(F.col("v2")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("factor") + 1)
    per_row = matched.groupBy("_plan", "_item", "_row").agg((F.sum(weight * F.col("flow") / F.greatest(F.col("n") - 1, F.lit(1))) / sum(weights)).alias("flow"))
    return per_row.groupBy(F.col("_plan").alias(plan), F.col("_item").alias(item)).agg(F.max("flow").alias("net_flow"))


def top_targets(flowed: DataFrame, count: int = 5, plan: str = "plan_id", item: str = "node_id") -> DataFrame:
    """The ``count`` items of each plan with the highest net flow; equal flows are decided by the smaller item."""
    order = Window.partitionBy(plan).orderBy(F.round("net_flow", 9).desc(), F.col(item))
    return flowed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= count).select(plan, item)
