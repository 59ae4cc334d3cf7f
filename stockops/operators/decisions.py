"""Decision analytics: belief, reliability, risk, utility, ranking, confidence, deferral.

All are column formulas over a row for each key; the few that look across rows group by a key.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, days_between, labels, norm_cdf, ratio
from ..functions.durable import written
from ..functions.scan import BLOCK, medians, running, same
from . import skyline


def belief_update(df: DataFrame) -> DataFrame:
    """Scalar Kalman step. Columns: prior_mean, prior_std, observed_qty, bias, noise_sigma, confidence,
    is_missing, status, optionally reported_noise_sigma, which outranks the device's. Adds gain, mean,
    std, belief_confidence.

    A missing or offline reading widens the prior; a device without noise is taken at its word.
    """
    lost = F.col("is_missing") | F.col("observed_qty").isNull() | F.coalesce(F.col("status") == "offline", F.lit(False))
    sigma = F.coalesce("reported_noise_sigma", "noise_sigma") if "reported_noise_sigma" in df.columns else F.col("noise_sigma")
    vp, vs = F.col("prior_std") * F.col("prior_std"), sigma * sigma
    gain = F.when(lost, 0.0).when(sigma == 0, 1.0).otherwise(F.coalesce(F.try_divide(vp, vp + vs), F.lit(0.0)))
    df = df.withColumn("gain", gain)
    corrected = F.col("observed_qty") - F.col("bias")
    return df.withColumns({
        "mean": F.when(lost, F.col("prior_mean")).otherwise(F.greatest(F.lit(0.0), F.col("prior_mean") + F.col("gain") * (corrected - F.col("prior_mean")))),
        "std": F.when(lost, F.col("prior_std") * 1.5).otherwise(F.sqrt((1 - F.col("gain")) * vp)),
        "belief_confidence": F.when(lost, F.col("confidence") * 0.3).otherwise(F.col("confidence")),
    })


#: Lost readings after which what was known before weighs nothing against a new reading (2.25^-400).
FORGOTTEN = 400

#: What a run of readings does to a belief of precision L and information H = mean * L:
#: H becomes max(floor, keep * H + add) and L becomes weigh * L + gain, both over 2.25^lost; ``exact`` outranks both.
EFFECT = "struct<lost:bigint,floor:double,keep:double,add:double,weigh:double,gain:double,exact:double>"
NO_EFFECT = "struct(0L, double('-Infinity'), 1D, 0D, 1D, 0D, CAST(NULL AS DOUBLE))"


def effect(z: Column, vs: Column, lost: Column) -> Column:
    """Of one reading: corrected value, noise variance, whether it is lost. A value that is null makes the mean
    zero, a noise that is null tells nothing."""
    seen, zero = ~F.coalesce(lost, F.lit(False)), F.lit(0.0)
    told = F.coalesce(F.try_divide(F.lit(1.0), vs), zero)
    return F.struct(
        F.when(seen, 0).otherwise(1).cast("long").alias("lost"),
        F.when(seen, 0.0).otherwise(float("-inf")).alias("floor"),
        F.when(seen & z.isNull(), 0.0).otherwise(1.0).alias("keep"),
        F.when(seen, F.coalesce(z * told, zero)).otherwise(0.0).alias("add"),
        F.lit(1.0).alias("weigh"),
        F.when(seen, told).otherwise(0.0).alias("gain"),
        F.when(seen & (vs == 0), F.greatest(zero, F.coalesce(z, zero))).alias("exact"),
    ).cast(EFFECT)


def then(x: Column, y: Column) -> Column:
    """Effect of x followed by y. It is associative, so readings fold in any split."""
    gone = ((x["lost"] > FORGOTTEN) & (y["gain"] > 0)) | (y["weigh"] == 0)
    up = F.pow(F.lit(2.25), F.least(x["lost"], F.lit(FORGOTTEN)).cast("double"))
    both = F.struct(
        (x["lost"] + y["lost"]).alias("lost"),
        F.greatest(y["floor"] * up, F.when(y["keep"] == 0, y["add"] * up).otherwise(x["floor"] + y["add"] * up)).alias("floor"),
        (y["keep"] * x["keep"]).alias("keep"),
        (y["keep"] * x["add"] + y["add"] * up).alias("add"),
        x["weigh"].alias("weigh"),
        (x["gain"] + y["gain"] * up).alias("gain"),
        F.coalesce(y["exact"], x["exact"]).alias("exact"),
    )
    fresh = F.struct(y["lost"].alias("lost"), F.greatest(y["floor"], y["add"]).alias("floor"), F.lit(0.0).alias("keep"), y["add"].alias("add"), F.lit(0.0).alias("weigh"), y["gain"].alias("gain"), F.coalesce(y["exact"], x["exact"]).alias("exact"))
    return F.when(gone, fresh).otherwise(both).cast(EFFECT)


def belief_sequence(readings: DataFrame, keys: list[str], prior_mean: float, prior_std: float, block: int = BLOCK, segment: int = 4096) -> DataFrame:
    """The same step over the readings of each key in order of (observed_at, id): keys, n_readings, mean, std.

    readings: keys, observed_at, id, observed_qty, bias, noise_sigma, is_missing. Readings are composed, not
    folded onto the prior: segments of ``segment`` readings become one effect each, in parallel, and the effects
    of a key are composed in order. Keys of more than ``block`` readings are numbered in ranges.
    """
    z, vs = F.col("observed_qty") - F.col("bias"), F.col("noise_sigma") * F.col("noise_sigma")
    rows = readings.select(*keys, "observed_at", "id", effect(z, vs, F.col("is_missing") | F.col("observed_qty").isNull()).alias("e"))
    rows = running(rows, keys, ["observed_at", "id"], {"nr": F.lit(1)}, block=block)
    composed = lambda: F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("nr", "e"))), lambda x: x["e"]), F.expr(NO_EFFECT).cast(EFFECT), then)
    parts = rows.groupBy(*keys, F.floor((F.col("nr") - 1) / segment).alias("part")).agg(F.count(F.lit(1)).alias("n"), composed().alias("e")).withColumnRenamed("part", "nr")
    whole = parts.groupBy(*keys).agg(F.sum("n").alias("n_readings"), composed().alias("e"))
    precision = 1.0 / max(prior_std, 1e-150) ** 2
    known = F.col("e.weigh") * precision + F.col("e.gain")
    mean = F.greatest(F.col("e.floor"), F.col("e.keep") * (prior_mean * precision) + F.col("e.add")) / known
    std = F.pow(F.lit(1.5), F.col("e.lost").cast("double")) / F.sqrt(known)
    return whole.select(*keys, F.col("n_readings").cast("int").alias("n_readings"), F.coalesce("e.exact", mean).alias("mean"), F.when(F.col("e.exact").isNull(), std).otherwise(0.0).alias("std"))


def delivery_sums(pos: DataFrame, as_of: Column, by: list[str], decay: float = 0.05) -> DataFrame:
    """Decayed successes and failures of the orders of each ``by`` that have arrived: by, s_eff, f_eff."""
    done = F.col("arrived_at").isNotNull() & F.col("expected_at").isNotNull() & (F.col("arrived_at") <= as_of)
    w = F.when(done, F.exp(-decay * F.greatest(F.lit(0.0), days_between(F.col("arrived_at"), as_of)))).otherwise(0.0)
    on_time = F.col("arrived_at") <= F.col("expected_at")
    return pos.groupBy(*by).agg(F.sum(F.when(on_time, w).otherwise(0.0)).alias("s_eff"), F.sum(F.when(on_time, 0.0).otherwise(w)).alias("f_eff"))


def supplier_evidence(pos: DataFrame, suppliers: DataFrame, as_of: Column, decay: float = 0.05, prior_strength: float = 10.0) -> DataFrame:
    """Beta posterior of on-time delivery: decayed successes and failures over a prior from the score."""
    return posterior_of_sums(delivery_sums(pos, as_of, ["supplier_id"], decay), suppliers, prior_strength)


def posterior_of_sums(sums: DataFrame, suppliers: DataFrame, prior_strength: float = 10.0) -> DataFrame:
    """The same of ``delivery_sums`` by suppliers, or by more than these."""
    ev = sums.groupBy("supplier_id").agg(F.sum("s_eff").alias("s_eff"), F.sum("f_eff").alias("f_eff"))
    df = suppliers.select(F.col("id").alias("supplier_id"), "reliability_score").join(ev, "supplier_id", "left").fillna(0.0, ["s_eff", "f_eff"])
    return beta_posterior(df, prior_strength)


def beta_posterior(df: DataFrame, prior_strength: float = 10.0) -> DataFrame:
    """From reliability_score, s_eff, f_eff: alpha, beta, mean, n_eff, evidence."""
    df = df.withColumn("alpha", prior_strength * F.col("reliability_score") + F.col("s_eff")).withColumn("beta", prior_strength * (1 - F.col("reliability_score")) + F.col("f_eff"))
    df = df.withColumn("mean", F.try_divide("alpha", F.col("alpha") + F.col("beta"))).withColumn("n_eff", F.col("s_eff") + F.col("f_eff"))
    return df.withColumn("evidence", F.when(F.col("n_eff") >= 20, "strong").when(F.col("n_eff") >= 5, "moderate").otherwise("weak"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-300)
        c = 1 + num / c if c else 1e300
        f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * (f - 1) if f != 1 else 0.0


def beta_quantile(a: float, b: float, p: float) -> float | None:
    """Bisection; null for parameters that are not positive."""
    if not (a and b and a > 0 and b > 0):
        return None
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def supplier_reliability(pos: DataFrame, suppliers: DataFrame, as_of: Column, quantile: float = 0.1) -> DataFrame:
    """``supplier_evidence`` with a lower quantile: one row a supplier, so a pandas UDF is enough."""

    @F.pandas_udf("double")
    def low(alpha: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([beta_quantile(a, b, quantile) for a, b in zip(alpha, beta, strict=True)])

    return supplier_evidence(pos, suppliers, as_of).withColumn("low_quantile", low("alpha", "beta"))


def signal_reliability(df: DataFrame) -> DataFrame:
    """avg_confidence, observed_missing_rate, missing_rate, is_anomaly, status -> reliability, signal."""
    r = F.col("avg_confidence") * (1 - F.greatest(F.lit(0.0), F.coalesce("observed_missing_rate", F.lit(0.0)) - F.col("missing_rate"))) * F.when(F.col("is_anomaly"), 0.6).otherwise(1.0)
    df = df.withColumn("reliability", F.when(F.col("status") == "offline", 0.0).otherwise(F.coalesce(r, F.lit(0.0))))
    return df.withColumn("signal", F.when(F.col("reliability") >= 0.8, "HIGH").when(F.col("reliability") >= 0.5, "MEDIUM").otherwise("LOW"))


def signal_rollup(df: DataFrame, by: str = "warehouse_id") -> DataFrame:
    """LOW devices of a group; it is trustworthy without any."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_devices"), F.sum((F.col("signal") == "LOW").cast("int")).alias("n_low"))
    return out.withColumn("trustworthy", F.col("n_low") == 0)


ENTROPY_SPAN = 0.5 * math.log(2 * math.pi * math.e * 50**2)


def uncertainty_index(df: DataFrame) -> DataFrame:
    """mean, std, days_since_count (null: 30), quality_status -> cv, h_norm, uncertainty, its class."""
    sigma = F.greatest("std", F.lit(0.01))
    df = df.withColumn("cv", F.col("std") / F.greatest("mean", F.lit(1.0)))
    df = df.withColumn("h_norm", clip(0.5 * F.log(F.lit(2 * math.pi * math.e) * sigma * sigma) / ENTROPY_SPAN, 0.0, 1.0))
    bad = F.when(F.lower("quality_status").isin("ok", "good", "verified"), 0.0).otherwise(0.2)
    stale = F.least(0.02 * F.coalesce("days_since_count", F.lit(30.0)), F.lit(0.5))
    df = df.withColumn("uncertainty", F.least(F.lit(1.0), 0.5 * F.col("cv") + 0.3 * F.col("h_norm") + stale + bad))
    u = F.col("uncertainty")
    return df.withColumn("uncertainty_class", F.when(u < 0.1, "CERTAIN").when(u < 0.3, "LOW").when(u < 0.6, "MODERATE").otherwise("HIGH"))


def leadtime_risk(df: DataFrame, horizon_days: Column | float) -> DataFrame:
    """p1, p2, p_rare_delay, rare_delay_add_days, reliability -> moments, quantiles and risk of a lead time."""
    h = F.lit(horizon_days) if isinstance(horizon_days, int | float) else horizon_days
    p, add = F.col("p_rare_delay"), F.col("rare_delay_add_days")
    mean = F.col("p1") + p * add
    var = (F.col("p2") * F.col("p2") + p * (1 - p) * add * add) * (1 + (1 - F.col("reliability")))
    df = df.withColumn("lt_mean", mean).withColumn("lt_var", var).withColumn("lt_std", F.sqrt("lt_var"))
    df = df.withColumn("p95", F.col("lt_mean") + 1.6449 * F.col("lt_std")).withColumn("p99", F.col("lt_mean") + 2.3263 * F.col("lt_std"))
    late = F.when(F.col("lt_std") > 0, 1 - norm_cdf(F.try_divide(h - F.col("lt_mean"), F.col("lt_std")))).otherwise((F.col("lt_mean") > h).cast("double"))
    df = df.withColumn("p_late", late)
    return df.withColumn("risk_class", F.when(F.col("p_late") < 0.05, "ACCEPTABLE").when(F.col("p_late") < 0.2, "ELEVATED").otherwise("CRITICAL"))


def po_leadtime_risk(pos: DataFrame, models: DataFrame, reliability: DataFrame, horizon_days: float) -> DataFrame:
    """Risk of each purchase order; a missing model falls back to the global one, taken as one row."""
    cols = ["p1", "p2", "p_rare_delay", "rare_delay_add_days"]
    glob = models.where("scope = 'global'").agg(F.min_by(F.struct(*cols), "id").alias("g"))
    own = models.select(F.col("id").alias("leadtime_model_id"), F.struct(*cols).alias("m"))
    df = pos.join(own, "leadtime_model_id", "left").join(F.broadcast(glob)).join(reliability.select("supplier_id", F.col("mean").alias("reliability")), "supplier_id", "left")
    df = df.withColumn("reliability", F.coalesce("reliability", F.lit(0.5))).withColumn("m", F.coalesce("m", "g"))
    return leadtime_risk(df.select(*[c for c in pos.columns], "reliability", "m.*"), horizon_days)


def flow_regime(moves: DataFrame, as_of: Column, keys: list[str] = ["product_id"]) -> DataFrame:  # noqa: B006
    """Daily share of adjustments against its own baseline, and whether it has shifted."""
    day = F.floor(F.greatest(F.lit(0.0), days_between(F.col("occurred_at"), as_of))).cast("int")
    recent = moves.where(F.col("occurred_at") <= as_of).withColumn("age", day).where("age <= 90")
    adj = F.col("move_type") == "adjustment"
    daily = recent.groupBy(*keys, "age").agg(
        ratio(F.sum(adj.cast("int")), F.count(F.lit(1))).alias("daily"), F.sum(adj.cast("int")).alias("n_adj"), F.count(F.lit(1)).alias("n")
    )
    base = F.when(F.col("age").between(31, 90), F.col("daily"))
    stats = daily.groupBy(*keys).agg(
        F.avg(base).alias("base_mean"), F.coalesce(F.stddev_pop(base), F.lit(0.0)).alias("base_std"), F.count(F.lit(1)).alias("n_days"),
        ratio(F.sum(F.when(F.col("age") < 7, F.col("n_adj"))), F.nullif(F.sum(F.when(F.col("age") < 7, F.col("n"))), F.lit(0))).alias("ratio7"),
        ratio(F.sum(F.when(F.col("age") < 30, F.col("n_adj"))), F.nullif(F.sum(F.when(F.col("age") < 30, F.col("n"))), F.lit(0))).alias("ratio30"),
    )
    odd = daily.where("age < 7").join(stats.select(*keys, "base_mean", "base_std"), keys).where(F.col("daily") > F.col("base_mean") + 2 * F.col("base_std"))
    odd = odd.groupBy(*keys).agg(F.count(F.lit(1)).alias("w"), F.max("age").alias("first_shift_age"))
    why = recent.where(adj).groupBy(*keys, "reason_code").agg(F.count(F.lit(1)).alias("c"), F.sum(F.abs(F.col("reported_qty") - F.col("actual_qty")) / F.greatest("qty", F.lit(1.0))).alias("gap"))
    why = why.groupBy(*keys).agg(F.min_by("reason_code", F.struct(-F.col("c"), F.coalesce("reason_code", F.lit("~")))).alias("dominant_reason"), F.try_divide(F.sum("gap"), F.sum("c")).alias("discrepancy"))
    df = stats.join(odd, keys, "left").join(why, keys, "left").withColumn("w", F.coalesce("w", F.lit(0))).withColumn("p_shift", (F.col("w") + 1) / F.lit(9.0))
    return df.withColumn("data_gap", F.col("n_days") < 14).withColumn("regime", regime(F.col("ratio7"), F.col("base_mean"), F.col("base_std"), F.col("p_shift"), F.col("n_days")))


def regime(ratio7: Column, mean: Column, std: Column, p_shift: Column, n_days: Column) -> Column:
    return (
        F.when(n_days < 14, "STABLE")
        .when((ratio7 > mean + 2 * std) & (p_shift > 0.7), "REGIME_SHIFT")
        .when(ratio7 > mean + std, "ELEVATED_ADJUSTMENTS")
        .otherwise("STABLE")
    )


RISK_UTILITY = {"ACCEPTABLE": 1.0, "ELEVATED": 0.6, "CRITICAL": 0.2}


def utility_terms(fill: Column, exposure: Column, risk: Column, sla: Column) -> dict[str, Column]:
    lt = F.when(risk == "ACCEPTABLE", 1.0).when(risk == "ELEVATED", 0.6).otherwise(0.2)
    return {"fill": 0.35 * fill, "penalty": 0.30 / (1 + exposure / 1000), "leadtime": 0.20 * lt, "sla": 0.15 * sla}


def utility(fill: Column, exposure: Column, risk: Column, sla: Column) -> Column:
    return sum(utility_terms(fill, exposure, risk, sla).values(), F.lit(0.0))


def action_utility(df: DataFrame, group: list[str]) -> DataFrame:
    """fill_rate, penalty_exposure, risk_class, sla -> utility, dominant_driver, rank within the group."""
    terms = utility_terms(F.col("fill_rate"), F.col("penalty_exposure"), F.col("risk_class"), F.col("sla"))
    best = F.greatest(*terms.values())
    driver = F.coalesce(*[F.when(t == best, F.lit(n)) for n, t in terms.items()])
    df = df.withColumn("utility", sum(terms.values(), F.lit(0.0))).withColumn("dominant_driver", driver)
    return df.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(F.round("utility", 9)))))


def value_of_information(df: DataFrame, cost: float = 0.05) -> DataFrame:
    """demand, mean, std, penalty_per_unit, risk_class, sla -> voi, decision.

    Expected utility at mean +- 2 std (never below zero) against that at the mean.
    """
    def at_qty(q):
        fill = F.coalesce(F.least(F.lit(1.0), F.try_divide(q, F.col("demand"))), F.lit(1.0))
        return utility(fill, F.col("penalty_per_unit") * F.greatest(F.lit(0.0), F.col("demand") - q), F.col("risk_class"), F.col("sla"))

    df = df.withColumns({"eu": at_qty(F.col("mean")), "eu_high": at_qty(F.col("mean") + 2 * F.col("std")), "eu_low": at_qty(F.greatest(F.lit(0.0), F.col("mean") - 2 * F.col("std")))})
    return voi_of(df, cost)


def voi_of(df: DataFrame, cost: float = 0.05) -> DataFrame:
    df = df.withColumn("voi", 0.5 * F.col("eu_high") + 0.5 * F.col("eu_low") - F.col("eu") - cost)
    return df.withColumn("decision", F.when(F.col("voi") > 0, "GATHER_INFO").otherwise("ACT_NOW"))


def constraint_check(df: DataFrame) -> DataFrame:
    """Hard and soft limits of an action: violations, soft_penalty, first_violation, feasibility."""
    hard = labels(
        (F.col("proposed_qty") + F.col("on_hand") > F.col("capacity_units"), "CAPACITY_EXCEEDED"),
        (~F.lower("quality_status").isin("ok", "good", "verified", "acceptable"), "QUALITY_BLOCKED"),
        (F.col("days_remaining") < 3, "SHELF_LIFE_CRITICAL"),
        (F.col("qty_allocated") + F.col("proposed_qty") > F.col("qty_ordered"), "ALLOCATION_EXCEEDS_ORDER"),
    )
    soft = (
        F.when(F.try_divide(F.col("proposed_qty") + F.col("on_hand"), F.col("capacity_units")) > 0.8, 0.2).otherwise(0.0)
        + F.when(F.lower("quality_status") == "acceptable", 0.1).otherwise(0.0)
        + F.when(F.col("days_since_count") > 30, 0.1).otherwise(0.0)
    )
    df = df.withColumn("violations", hard).withColumn("soft_penalty", soft)
    df = df.withColumn("first_violation", F.try_element_at("violations", F.lit(1)))
    return df.withColumn("feasibility", F.when(F.size("violations") > 0, "INFEASIBLE").when(F.col("soft_penalty") > 0, "CONDITIONAL").otherwise("FEASIBLE"))


def rank_actions(df: DataFrame, group: list[str], beam: int = 3) -> DataFrame:
    """action_id, score, uncertainty, sla, reliability, feasibility -> the best ``beam`` of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), F.desc_nulls_last("sla"), F.desc_nulls_last("reliability"), F.asc("action_id"))
    df = df.where("feasibility <> 'INFEASIBLE'").withColumn("rank", F.row_number().over(w)).withColumn("next_score", F.lead("score").over(w))
    half = 1.96 * F.col("uncertainty") * 0.1
    df = df.withColumns({"ci_low": F.col("score") - half, "ci_high": F.col("score") + half}).where(F.col("rank") <= beam)
    margin = F.first(F.when(F.col("next_score").isNull(), 1.0).otherwise(F.col("score") - F.col("next_score"))).over(Window.partitionBy(*group).orderBy("rank"))
    df = df.withColumn("margin", margin).drop("next_score")
    return df.withColumn("margin_class", F.when(F.col("margin") > 0.1, "HIGH").when(F.col("margin") > 0.02, "MARGINAL").otherwise("TIE"))


def pareto_frontier(df: DataFrame, group: list[str], attributes: list[str], near: float = 0.05, block: int = 2_000, split: int = 4096) -> DataFrame:
    """Options of each group with ``dominated`` (at least as bad everywhere, worse somewhere), ``near_dominated``
    (within ``near`` everywhere of one with a higher score) and ``reduction``, the share that is dominated.

    Groups of up to ``block`` options are gathered in one array and compared in place, so nothing meets itself
    in a join. Larger groups go through skylines of splits. An action_id is one option of its group; null
    attributes neither dominate nor are dominated; null groups are a group.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    if sizes.isEmpty():
        return compared_in_place(df, group, attributes, near)
    small = df.alias("d").join(sizes.alias("s"), same("d", "s", group), "left_anti")
    large = df.alias("d").join(F.broadcast(sizes).alias("s"), same("d", "s", group)).select("d.*", "_n").withColumn("_id", F.monotonically_increasing_id())
    large = written(large, "options")
    points = large.select(F.xxhash64(*group).alias("g"), F.col("_id").alias("id"), F.col("_n").alias("n"), F.array(*[F.col(c).cast("double") for c in attributes]).alias("x"), F.col("score").cast("double").alias("score"))
    marked = written(large.join(skyline.mark_large(points, near, split).withColumnRenamed("id", "_id"), "_id"), "marked")
    shares = marked.groupBy(*group).agg(F.avg(F.col("dominated").cast("double")).alias("reduction"))
    out = marked.alias("d").join(F.broadcast(shares).alias("s"), same("d", "s", group)).select(*[f"d.{c}" for c in df.columns], "d.dominated", "d.near_dominated", "s.reduction")
    return compared_in_place(small, group, attributes, near).unionByName(out)


def compared_in_place(df: DataFrame, group: list[str], attributes: list[str], near: float) -> DataFrame:
    """All options of a group against each other, in one array."""
    options = df.groupBy(*group).agg(F.collect_list(F.struct(*[df[c] for c in df.columns if c not in group])).alias("options"))

    def marks(x):
        no_worse, better, close = lambda o: F.lit(True), lambda o: F.lit(False), lambda o: F.lit(True)
        for c in attributes:
            no_worse = lambda o, c=c, f=no_worse: f(o) & (o[c] >= x[c])
            better = lambda o, c=c, f=better: f(o) | (o[c] > x[c])
            close = lambda o, c=c, f=close: f(o) & (o[c] >= x[c] - near)
        other = lambda o: o["action_id"] != x["action_id"]
        return F.struct(
            x.alias("option"),
            F.exists("options", lambda o: other(o) & no_worse(o) & better(o)).alias("dominated"),
            F.exists("options", lambda o: other(o) & close(o) & (o["score"] > x["score"])).alias("near_dominated"),
        )

    marked = options.select(*group, F.transform("options", marks).alias("m"))
    share = F.size(F.filter("m", lambda o: o["dominated"])) / F.size("m")
    out = marked.select(*group, share.alias("reduction"), F.explode("m").alias("m"))
    return out.select(*group, "m.option.*", F.coalesce("m.dominated", F.lit(False)).alias("dominated"), F.coalesce("m.near_dominated", F.lit(False)).alias("near_dominated"), "reduction")


def threshold_trigger(df: DataFrame, safety_days: float = 7.0) -> DataFrame:
    """qty, outbound_30d, pipeline_qty, quality_status -> demand, cover, trigger."""
    usable = F.when(F.lower("quality_status").isin("quarantined", "damaged"), 0.0).otherwise(F.col("qty"))
    d = F.col("demand")
    df = df.withColumn("usable_qty", usable).withColumn("demand", F.col("outbound_30d") / 30.0)
    df = df.withColumns({"cover_days": F.col("usable_qty") / F.greatest(d, F.lit(0.01)), "safety_stock": safety_days * d, "effective_cover": (F.col("usable_qty") + F.col("pipeline_qty")) / F.greatest(d, F.lit(0.01))})
    short, moving = F.col("usable_qty") < F.col("safety_stock"), d > 0  # without demand the cover is endless
    trigger = (
        F.when(short & moving & (F.col("cover_days") < 3), "STOCKOUT_IMMINENT")
        .when(short | (moving & (F.col("cover_days") < 7)), "REORDER_TRIGGER")
        .when(moving & (F.col("effective_cover") < 14) & (F.col("pipeline_qty") < F.col("safety_stock")), "PIPELINE_RISK")
        .otherwise("NORMAL")
    )
    return df.withColumn("trigger", trigger)


def decision_confidence(df: DataFrame) -> DataFrame:
    """sensor, n_low, regime, uncertainty, margin, margin_class, trigger -> confidence and its class; missing inputs
    take neutral values. An imminent stockout is always executed."""
    reg = F.when(F.col("regime") == "REGIME_SHIFT", 0.2).when(F.col("regime") == "ELEVATED_ADJUSTMENTS", 0.6).when(F.col("regime") == "STABLE", 1.0).otherwise(0.8)
    raw = (
        0.25 * F.coalesce("sensor", F.lit(0.5)) + 0.20 * reg + 0.30 * (1 - F.coalesce("uncertainty", F.lit(0.5)))
        + 0.25 * F.when(F.col("margin_class") == "TIE", 0.0).otherwise(F.least(F.coalesce("margin", F.lit(0.05)) / 0.1, F.lit(1.0))) - 0.15 * F.coalesce("n_low", F.lit(0))
    )
    df = df.withColumn("decision_confidence", clip(raw, 0.0, 1.0))
    c = F.col("decision_confidence")
    named = F.when(c >= 0.75, "CONFIDENT").when(c >= 0.5, "ADEQUATE").when(c >= 0.25, "LOW_CONFIDENCE").otherwise("INSUFFICIENT")
    step = F.when(F.coalesce(F.col("trigger") == "STOCKOUT_IMMINENT", F.lit(False)) | (c >= 0.75), "EXECUTE").when(c >= 0.5, "EXECUTE_WITH_FLAG").when(c >= 0.25, "DEFER").otherwise("ESCALATE")
    return df.withColumn("confidence_class", named).withColumn("next_step", step)


def deferral(df: DataFrame) -> DataFrame:
    """voi, confidence_class, uncertainty, n_deferrals, trigger -> deferral, wait_hours, new count."""
    stockout, spent = F.coalesce(F.col("trigger") == "STOCKOUT_IMMINENT", F.lit(False)), F.col("n_deferrals") >= 2
    defer = ~stockout & ~spent & (F.col("voi") > 0) & F.col("confidence_class").isin("LOW_CONFIDENCE", "INSUFFICIENT")
    wait = F.least(F.lit(48), F.ceil(F.round(F.col("uncertainty") * 48 / 6, 9)).cast("int") * 6)
    return df.withColumns({"deferral": F.when(stockout, "CANNOT_DEFER").when(spent, "FORCED_DECISION").when(defer, "DEFER").otherwise("ACT_NOW"), "wait_hours": F.when(defer, wait).otherwise(0), "n_deferrals_after": F.col("n_deferrals") + F.when(defer, 1).otherwise(0)})


def with_outliers(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Adds median, pooled, spread, conflict and outlier by windows over each key."""
    every = Window.partitionBy(*keys)
    df = signals.withColumn("median", F.median("mean").over(every))
    df = df.withColumn("pooled", F.sqrt(F.avg(F.col("std") * F.col("std")).over(every))).withColumn("spread", F.max("mean").over(every) - F.min("mean").over(every))
    # ties of distance go to the least reliable signal
    far = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs(F.col("mean") - F.col("median")), 9)), F.asc("reliability"), F.asc("signal_id"))
    return df.withColumn("conflict", F.col("spread") > 2 * F.col("pooled")).withColumn("outlier", F.col("conflict") & (F.row_number().over(far) == 1))


def with_outliers_of_hot_keys(signals: DataFrame, keys: list[str], block: int) -> DataFrame:
    """The same by sums, an exact median and a smallest distance of each key, all added up over tasks; there are
    few such keys, so what is told of them meets their signals by broadcast."""
    rows = written(signals, "signals")
    stats = rows.groupBy(*keys).agg(F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("pooled"), (F.max("mean") - F.min("mean")).alias("spread"))
    stats = stats.alias("a").join(medians(rows, keys, "mean", block).alias("b"), same("a", "b", keys)).select("a.*", "median")
    met = rows.alias("r").join(F.broadcast(stats).alias("s"), same("r", "s", keys)).select("r.*", "s.median", "s.pooled", "s.spread")
    met = met.withColumn("conflict", F.col("spread") > 2 * F.col("pooled"))
    place = F.struct((-F.round(F.abs(F.col("mean") - F.col("median")), 9)).alias("d"), "reliability", "signal_id")
    far = met.where("mean is not null").groupBy(*keys).agg(F.min(place)["signal_id"].alias("_far"))
    out = met.alias("r").join(F.broadcast(far).alias("s"), same("r", "s", keys), "left").select("r.*", "_far")
    return out.withColumn("outlier", F.col("conflict") & F.coalesce(F.col("signal_id") == F.col("_far"), F.lit(False))).drop("_far")


def resolve_conflicts(signals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Signals (mean, std, reliability) of a key: pooled estimate and kind of conflict.

    Two signals conflict if any pair differs by more than twice the pooled std, which needs only the
    extremes. The farthest from the median is the outlier; it is left out if its reliability is below
    0.4. Against ``base_mean``/``base_std`` a pooled mean more than three std away is reset. Keys of more than
    ``block`` signals are not gathered; a signal_id is one signal of its key.
    """
    hot = signals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*keys)
    if hot.isEmpty():
        df = with_outliers(signals, keys)
    else:
        side = lambda how: signals.alias("a").join(F.broadcast(hot).alias("b"), same("a", "b", keys), how)
        df = with_outliers(side("left_anti"), keys).unionByName(with_outliers_of_hot_keys(side("left_semi"), keys, block))
    use = ~(F.col("outlier") & (F.col("reliability") < 0.4))
    w = F.when(use, F.col("reliability")).otherwise(0.0)
    out = df.groupBy(*keys).agg(
        F.bool_or("conflict").alias("conflict"), F.max(F.when(F.col("outlier"), F.col("signal_id"))).alias("outlier_id"), F.max("spread").alias("spread"),
        F.try_divide(F.sum(w * F.col("mean")), F.sum(w)).alias("mean"), F.try_divide(F.sum(w * F.col("mean") * F.col("mean")), F.sum(w)).alias("second"),
        F.sum((w > 0).cast("int")).alias("n_used"), F.max(F.when(w > 0, F.col("std"))).alias("only_std"), F.max(F.when(F.col("outlier"), F.col("mean"))).alias("outlier_mean"), F.first("base_mean").alias("base_mean"), F.first("base_std").alias("base_std"),
    )
    spread_std = F.sqrt(F.greatest(F.lit(0.0), F.col("second") - F.col("mean") * F.col("mean")))
    out = out.withColumn("std", F.when(F.col("n_used") == 1, F.col("only_std")).otherwise(spread_std)).drop("second", "only_std")
    reset = F.col("conflict") & F.coalesce(F.abs(F.col("mean") - F.col("base_mean")) > 3 * F.col("base_std"), F.lit(False))
    severity = F.try_divide(F.abs(F.col("outlier_mean") - F.col("mean")), F.col("std"))
    out = out.withColumns({"reset": reset, "severity": F.when(F.col("conflict"), severity)})
    kind_a = F.when(~F.col("conflict"), 0.0).when(F.col("severity") <= 3, -0.10).when(F.col("severity") <= 5, -0.20).otherwise(-0.35)
    delta = kind_a + F.when(F.col("reset"), -0.40).otherwise(0.0)
    return out.withColumn("confidence_delta", delta).withColumns({"mean": F.when(F.col("reset"), F.col("base_mean")).otherwise(F.col("mean")), "std": F.when(F.col("reset"), 2 * F.col("base_std")).otherwise(F.col("std"))})


def resolve_actions(actions: DataFrame, keys: list[str]) -> DataFrame:
    """Recommended actions of a key: the one of the highest trigger stays, then the highest score.

    Columns: action_id, action_type, trigger, score. Where types clash (an emergency order with
    monitoring or holding, an order with holding) 0.15 of confidence is lost.
    """
    prio = F.when(F.col("trigger") == "STOCKOUT_IMMINENT", 4).when(F.col("trigger") == "REORDER_TRIGGER", 3).when(F.col("trigger") == "PIPELINE_RISK", 2).otherwise(1)
    every = Window.partitionBy(*keys)
    has = lambda t: F.bool_or(F.col("action_type") == t).over(every)
    clash = (has("EMERGENCY_ORDER") & (has("MONITOR") | has("HOLD"))) | (has("PLACE_ORDER") & has("HOLD"))
    w = Window.partitionBy(*keys).orderBy(F.desc("priority"), F.desc("score"), F.asc("action_id"))
    df = actions.withColumn("priority", prio).withColumn("clash", clash).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return df.withColumn("confidence_delta", F.when(F.col("clash"), -0.15).otherwise(0.0)).drop("rn")


def discrepancy_severity(df: DataFrame) -> DataFrame:
    """expected, observed, sigma -> shrinkage_pct, z, p_value, significant (two-sided, 5 %)."""
    gap = F.col("expected") - F.col("observed")
    df = df.withColumn("shrinkage_pct", F.try_divide(gap, F.col("expected")) * 100).withColumn("z", F.try_divide(gap, F.col("sigma")))
    return df.withColumn("p_value", 2 * (1 - norm_cdf(F.abs("z")))).withColumn("significant", F.col("p_value") < 0.05)
