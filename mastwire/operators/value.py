"""Customer value: measures in local money, frozen tiers and a twelve-month scenario."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastwire.functions.ladders import interval_number
from mastwire.functions.numeric import any_of, clip, total
from mastwire.operators.ordered import quantiles_by
from mastwire.session import materialize

DIMENSIONS = ("recency", "frequency", "monetary", "tenure", "engagement")
TIERS = ("very_low", "low", "medium", "high", "very_high")
QUANTILES = [0.2, 0.4, 0.6, 0.8]
# The bases that show use of each service.
SERVICES = {
    "voice": ("total_ic_mou", "total_og_mou"),
    "data": ("vol_2g_mb", "vol_3g_mb"),
    "packs": ("monthly_2g", "monthly_3g", "sachet_2g", "sachet_3g"),
    "roaming": ("roam_ic_mou", "roam_og_mou"),
}
PREFIXES = ("prev", "cur")
HAZARDS = {"low": 1.5, "base": 1.0, "high": 0.5}
HORIZON = 12


def used(service: str) -> Column:
    return any_of([F.col(f"{p}_{b}") > 0 for p in PREFIXES for b in SERVICES[service]])


def window_recharge(prefix: str) -> Column:
    """Airtime plus data recharge in one month of a window frame."""
    data = F.col(f"{prefix}_total_rech_data") * F.col(f"{prefix}_av_rech_amt_data")
    return F.col(f"{prefix}_total_rech_amt") + data


def monthly_spend(rate: float) -> Column:
    return (window_recharge("prev") + window_recharge("cur")) / 2 * rate


def value_measures(frame: DataFrame, rate: float) -> DataFrame:
    """Recency, frequency, money, tenure and breadth of service use."""
    counts = [F.col(f"{p}_{b}") for p in PREFIXES for b in ("total_rech_num", "total_rech_data")]
    return frame.withColumns(
        {
            "recency": F.least("days_since_last_rech_window", "days_since_last_rech_data_window"),
            "frequency": total(counts) / 2,
            "monetary": monthly_spend(rate),
            "tenure": F.col("tenure_days").cast("double"),
            "engagement": total([used(s).cast("int") for s in SERVICES]),
        }
    )


@dataclass(frozen=True)
class TierModel:
    """Cutoffs frozen on training customers; a constant dimension has none."""

    rate: float
    rows: int
    cutoffs: dict[str, list[float] | None]


def _directed(name: str) -> Column:
    return -F.col(name) if name == "recency" else F.col(name)


def frozen_cutoffs(df: DataFrame, names: list[str]) -> dict[str, list[float] | None]:
    """Quintile cutoffs of several columns from one ordered pass; none for a constant column."""
    long = df.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "name", "value")
    probs = {f"q{i}": q for i, q in enumerate([0.0, *QUANTILES, 1.0])}
    rows = {r["name"]: [r[q] for q in probs] for r in quantiles_by(long, ["name"], "value", probs).collect()}
    return {n: None if rows[n][0] == rows[n][-1] else rows[n][1:-1] for n in names}


def fit_tiers(train: DataFrame, rate: float) -> TierModel:
    measures = value_measures(train, rate).select(*[_directed(n).alias(n) for n in DIMENSIONS])
    measures = materialize(measures)
    cutoffs = frozen_cutoffs(measures, list(DIMENSIONS))
    restored = measures.withColumn("recency", -F.col("recency"))
    scored = dimension_scores(restored, TierModel(rate, 0, cutoffs))
    composite = frozen_cutoffs(scored, ["value_score"])["value_score"]
    return TierModel(rate, measures.count(), {**cutoffs, "composite": composite})


def dimension_scores(measures: DataFrame, model: TierModel) -> DataFrame:
    out = measures.withColumns(
        {f"{n}_score": interval_number(_directed(n), model.cutoffs[n]) for n in DIMENSIONS}
    )
    return out.withColumn("value_score", total([F.col(f"{n}_score") for n in DIMENSIONS]) / len(DIMENSIONS))


def apply_tiers(frame: DataFrame, model: TierModel) -> DataFrame:
    out = dimension_scores(value_measures(frame, model.rate), model)
    place = interval_number(F.col("value_score"), model.cutoffs["composite"])
    tiers = F.array(*[F.lit(t) for t in TIERS])
    return out.withColumn("value_tier", F.element_at(tiers, place)).withColumnRenamed("monetary", "monthly_spend_lyd")


def tier_distribution(tiered: DataFrame) -> DataFrame:
    """Customers per tier, with tiers nobody reached shown as zero."""
    counts = [F.struct(F.lit(t).alias("value_tier"), F.count_if(F.col("value_tier") == t).alias("customers")) for t in TIERS]
    return tiered.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def tier_crosstab(tiered: DataFrame, column: str, values: list) -> DataFrame:
    """Tier by cluster counts with an explicit list of columns and every tier present."""
    rows = [
        F.struct(
            F.lit(t).alias("value_tier"),
            *[F.count_if((F.col("value_tier") == t) & (F.col(column) == v)).alias(str(v)) for v in values],
        )
        for t in TIERS
    ]
    return tiered.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def expected_months(probability: Column) -> Column:
    """Months survived out of the next twelve under a constant monthly risk; missing stays missing."""
    stay = 1 - probability
    steps = F.sequence(F.lit(1), F.lit(HORIZON))
    return F.aggregate(steps, F.lit(0.0), lambda acc, m: acc + F.pow(stay, m))


def value_scenarios(df: DataFrame, spend: str = "monthly_spend_lyd", probability: str = "churn_probability") -> DataFrame:
    p = F.col(probability)
    new = {"expected_months_12m": expected_months(p)}
    for name, factor in HAZARDS.items():
        new[f"value_12m_{name}_lyd"] = F.col(spend) * expected_months(clip(p * factor, 0, 1))
    return df.withColumns(new)


def risk_band(probability: Column, high: float, medium: float) -> Column:
    return F.when(probability >= high, "high").when(probability >= medium, "medium").otherwise("low")


def group_summary(df: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """Customers, spend, expected churners and revenue at risk per group, every group shown."""
    p, spend = F.col("churn_probability"), F.col("monthly_spend_lyd")
    counted = df.groupBy(group).agg(
        F.count("*").alias("customers"),
        F.coalesce(F.sum(spend), F.lit(0.0)).alias("monthly_spend_lyd"),
        F.sum(p).alias("expected_churners"),
        F.sum(p * spend).alias("revenue_at_risk_lyd"),
    )
    names = df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(order)], f"position int, {group} string")
    return names.join(counted, group, "left").withColumn("customers", F.coalesce("customers", F.lit(0)))
