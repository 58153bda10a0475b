"""Rules on top of model scores: risk, value tier, urgency, segments, priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranking import quantiles_row, with_position, with_rank_share
from tidemark.functions.storage import keep

# Segments in the order of the work list; those ranked by revenue at risk; thresholds of the rules.
SEGMENTS = [
    "High-Value At-Risk", "Mid-Value At-Risk", "High-Value Stable", "Emerging", "Stable",
    "Low-Value Watch", "Low-Value At-Risk", "Lapsed", "Dormant", "Ghost",
]
RANKED_BY_RISK = ["High-Value At-Risk", "Mid-Value At-Risk", "Low-Value At-Risk", "Low-Value Watch"]
HIGH_SHARE, MID_SHARE, MOMENTUM = 0.90, 0.50, 0.10
URGENT_DAYS = {"critical": 14, "warning": 30, "monitor": 90}
ALIVE_AT_RISK, ALIVE_WATCH = 0.20, 0.50


def stand_in_scores(features: DataFrame, stages: DataFrame) -> DataFrame:
    """Deterministic scores in place of trained models, so that rules and reports can be held against SQL."""
    rows = features.join(stages.select("acc_id", "stage", "sub_stage", "ever_paid"), "acc_id")
    silence = F.coalesce("days_since_last_activity", F.lit(365.0))
    p = 1 / (1 + F.exp(-(silence - 60) / 30))
    active, paying = F.col("stage").isin("Active Paid", "Active Free"), F.col("stage") == "Active Paid"
    return rows.select(
        "acc_id", "stage", "sub_stage", "ever_paid", "days_since_last_activity", "total_revenue_all", "customer_age_days", "usage_total_180d", "usage_change_90d_pct", "usage_recent_90d", "credit_balance_proxy", "total_revenue_180d", "payment_count_all",
        F.when(paying, F.bround(p, 4)).alias("churn_probability"),
        F.when(active, F.bround(F.col("total_revenue_180d") * (1 - p), 2)).alias("predicted_clv"),
        F.when(active, F.bround(F.col("usage_recent_90d") / 3, 2)).alias("usage_30d"),
        F.when(active, F.bround(1 - p, 4)).alias("p_alive"),
    )


def risk_bands(high: Column) -> Column:
    """medium, high, critical around the line that the F2 sweep found for "high"."""
    line = F.greatest(F.lit(0.05), F.least(F.lit(0.95), high))
    return F.struct(F.bround(line * 0.5, 2).alias("medium"), F.bround(line, 2).alias("high"), F.bround(line + 0.6 * (1 - line), 2).alias("critical"))


def risk_level(p: Column, critical: float = 0.8, high: float = 0.6, medium: float = 0.3) -> Column:
    return F.when(p >= critical, "critical").when(p >= high, "high").when(p >= medium, "medium").when(p.isNotNull(), "low")


def abstained(p: Column, age_days: Column, least_days: int = 90) -> Column:
    """No churn score for accounts younger than that."""
    return F.when(F.coalesce(age_days < least_days, F.lit(False)), F.lit(None)).otherwise(p)


def usage_trend(total: Column, change: Column) -> Column:
    return F.when(total <= 0, "no_usage").when(change > 0.10, "growing").when(change < -0.10, "declining").otherwise("stable")


def topup_days(balance: Column, usage_30d: Column, model_days: Column | None = None) -> Column:
    """The model's days where it has any; else until the balance is used up at the forecast rate, 365 at most.

    Null without a model's answer and without usage.
    """
    rule = F.when(usage_30d > 0, F.least(F.ceil(F.coalesce(balance, F.lit(0.0)) / (usage_30d / 30)), F.lit(365))).cast("long")
    return rule if model_days is None else F.coalesce(F.round(model_days).cast("long"), rule)


def urgency(days: Column, eligible: Column) -> Column:
    out = F.lit("stable")
    for level, most in sorted(URGENT_DAYS.items(), key=lambda x: -x[1]):
        out = F.when(days <= most, level).otherwise(out)
    return F.when(eligible, out)


def is_active() -> Column:
    return F.col("stage").isin("Active Paid", "Active Free")


def with_value_tier(df: DataFrame) -> DataFrame:
    """high, mid or low by the percentile of predicted value among active accounts with value; none for the others."""
    pool = df.withColumn("__pool", F.when(is_active() & (F.col("predicted_clv") > 0), F.col("predicted_clv")))
    share = F.col("value_share")
    tier = F.when(share >= HIGH_SHARE, "high").when(share >= MID_SHARE, "mid").when(share.isNotNull(), "low").otherwise("none")
    return with_rank_share(pool, "__pool", "value_share").withColumn("value_tier", tier).drop("__pool")


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def segment() -> Column:
    """Stage first, then value, then risk; growth only where nothing else is said."""
    at_risk = _sure(F.col("risk_level").isin("high", "critical")) | _sure(F.col("p_alive") < ALIVE_AT_RISK)
    watched = _sure(F.col("risk_level") == "medium") | _sure(F.col("p_alive") < ALIVE_WATCH)
    valued = F.when(at_risk, "High-Value At-Risk").when(watched, "Mid-Value At-Risk").otherwise("High-Value Stable")
    other = F.when(at_risk, "Low-Value At-Risk").when(watched, "Low-Value Watch").when(_sure(F.col("usage_change_90d_pct") > MOMENTUM), "Emerging").otherwise("Stable")
    living = F.when(F.col("value_tier").isin("high", "mid"), valued).otherwise(other)
    return F.when(F.col("stage") == "Ghost", "Ghost").when(F.col("stage") == "Churned", F.when(F.col("ever_paid"), "Lapsed").otherwise("Dormant")).otherwise(living)


def derived(scores: DataFrame) -> DataFrame:
    """All derived fields but the ranks. The scores are materialised: the percentile of value needs them twice."""
    scores = keep(scores)
    rows = with_value_tier(scores.withColumn("churn_probability", abstained(F.col("churn_probability"), F.col("customer_age_days"))))
    rows = (
        rows.withColumn("risk_level", risk_level(F.col("churn_probability")))
        .withColumn("revenue_at_risk", F.bround(F.col("churn_probability") * F.col("predicted_clv"), 2))
        .withColumn("days_to_topup", topup_days(F.col("credit_balance_proxy"), F.col("usage_30d")))
        .withColumn("usage_trend", usage_trend(F.col("usage_total_180d"), F.col("usage_change_90d_pct")))
    )
    rows = rows.withColumn("urgency", urgency(F.col("days_to_topup"), is_active()))
    silent = F.col("value_tier").isin("high", "mid") & _sure(F.col("p_alive") < ALIVE_AT_RISK) & _sure(F.col("usage_change_90d_pct") < -MOMENTUM)
    review = (_sure(F.col("risk_level").isin("critical", "high")) | silent) & is_active()
    return rows.withColumn("needs_review", review).withColumn("segment", segment())


def with_priority(df: DataFrame) -> DataFrame:
    """priority_score: log revenue at risk rescaled to 0..100 over all rows; priority_rank: by segment, money, account.

    The rescaling needs two numbers from all rows (an aggregate, broadcast); the rank is counted by range partitions.
    """
    df = keep(df)
    risk = F.log1p(F.greatest(F.coalesce("revenue_at_risk", F.lit(0.0)), F.lit(0.0)))
    bounds = df.agg(F.min(risk).alias("__low"), F.max(risk).alias("__high"))
    span = F.col("__high") - F.col("__low")
    score = F.when(span < 1e-9, 0.0).otherwise(F.bround((risk - F.col("__low")) * 100 / F.greatest(span, F.lit(1e-9)), 2))
    scored = df.join(F.broadcast(bounds)).withColumn("priority_score", score).drop("__low", "__high")
    order = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("segment"))
    money = F.coalesce(F.when(F.col("segment").isin(*RANKED_BY_RISK), F.col("revenue_at_risk")).otherwise(F.col("predicted_clv")), F.lit(0.0))
    return with_position(scored, [order, money.desc(), F.col("acc_id")], "priority_rank")


def clv_tail_blend(df: DataFrame, frequency: str, revenue: str, base: str, other: str, least: int = 50) -> DataFrame:
    """In the top decile by frequency (2 at least) or revenue, the larger of two predictions; too few rows: unchanged."""
    df = keep(df)
    cuts = quantiles_row(df, {"__f": (frequency, 0.9), "__r": (revenue, 0.9)}).join(df.agg(F.count("*").alias("__n")))
    tail = (F.col("__n") >= least) & ((F.col(frequency) >= F.greatest(F.col("__f"), F.lit(2.0))) | (F.col(revenue) >= F.col("__r")))
    return df.join(F.broadcast(cuts)).withColumn("blended", F.when(tail, F.greatest(base, other)).otherwise(F.col(base))).drop("__f", "__r", "__n")


#: Why an account is not scored by a model: by stage, for churn and for the other two.
_CHURN_REASONS = {"Active Free": "never_paid", "Churned": "already_churned", "Ghost": "no_history"}
_OTHER_REASONS = {"Churned": "inactive", "Ghost": "no_history"}


def _by_stage(reasons: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col("stage") == s, r) for s, r in reasons.items()])


def with_output_status(out: DataFrame, drifted: tuple[str, ...] = (), least_days: int = 90) -> DataFrame:
    """Add eligibility (JSON, a block a model), output_status and output_notes.

    A model is ``predicted``, ``not_eligible`` (by stage) or has ``insufficient_data``. Nothing predicted: insufficient
    data; an eligible model without a prediction, or one whose features drifted by much: partial.
    """
    young = F.coalesce(F.col("customer_age_days") < least_days, F.lit(False))
    models = {"churn": ("churn_probability", _by_stage(_CHURN_REASONS)), "clv": ("predicted_clv", _by_stage(_OTHER_REASONS)), "credit": ("usage_30d", _by_stage(_OTHER_REASONS))}
    blocks, predicted, unpredicted, moved, notes = [], F.lit(False), F.lit(False), F.lit(False), []
    for name, (value, barred) in models.items():
        eligible, has = barred.isNull(), F.col(value).isNotNull()
        abstains = eligible & young if name == "churn" else F.lit(False)
        status = F.when(~eligible, "not_eligible").when(has & ~abstains, "predicted").otherwise("insufficient_data")
        reason = F.when(~eligible, barred).when(abstains, "insufficient_history").when(has, "eligible").otherwise("insufficient_data")
        blocks.append(F.struct(eligible.alias("eligible"), status.alias("status"), reason.alias("reason")).alias(name))
        predicted, unpredicted = predicted | (status == "predicted"), unpredicted | (status == "insufficient_data")
        notes.append(F.when(~eligible, F.concat(F.lit(f"{name}: "), barred)))
        if name in drifted:
            moved = moved | eligible
    notes += [F.when(models[name][1].isNull(), F.lit(f"{name}: major feature drift, predictions may be unreliable")) for name in sorted(drifted)]
    status = F.when(~predicted, "insufficient_data").when(unpredicted | moved, "partial").otherwise("predicted")
    return out.select("*", F.to_json(F.struct(*blocks)).alias("eligibility"), status.alias("output_status"), F.nullif(F.concat_ws("; ", *notes), F.lit("")).alias("output_notes"))
