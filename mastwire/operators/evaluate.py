"""Exact model evaluation on tables of any size: ranking, calibration, forecasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.functions.numeric import clip, half_even
from mastwire.operators.ordered import quantiles_by, share_size, with_running

EPSILON = 1e-15
TOP_SHARES = (0.05, 0.10, 0.20)


def score_levels(df: DataFrame, score: str, label: str) -> DataFrame:
    """Customers and positives per distinct score, with running totals from the top score.

    Equal scores are combined before the shuffle, so ties share one row and one rank.
    """
    levels = df.groupBy(F.col(score).alias("score")).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")
    )
    return with_running(levels, [F.col("score").desc()], None, {"cum_n": F.col("n"), "cum_pos": F.col("pos")})


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC-AUC, average precision, log loss, Brier score, mean score and rate; one row.

    With one class only, the ranking metrics are missing.
    """
    levels = score_levels(df, score, label)
    p = F.col("score")
    bounded = clip(p, EPSILON, 1 - EPSILON)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    row = levels.agg(
        F.sum("n").alias("customers"),
        F.sum("pos").alias("positives"),
        F.sum((neg * above).cast("double") + 0.5 * F.col("pos") * neg).alias("_pairs"),
        F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("_precision"),
        F.sum(-(F.col("pos") * F.log(bounded) + neg * F.log(1 - bounded))).alias("_loss"),
        F.sum(F.col("pos") * F.pow(1 - p, F.lit(2.0)) + neg * p * p).alias("_square"),
        F.sum(p * F.col("n")).alias("_sum"),
    )
    n, pos = F.col("customers"), F.col("positives")
    both = (pos > 0) & (pos < n)
    return row.select(
        "customers",
        "positives",
        F.when(both, F.try_divide(F.col("_pairs"), pos.cast("double") * (n - pos))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_precision"), pos)).alias("pr_auc"),
        F.when(both, F.col("_loss") / n).alias("log_loss"),
        (F.col("_square") / n).alias("brier"),
        (F.col("_sum") / n).alias("mean_score"),
        (pos / n).alias("rate"),
    )


def best_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """The threshold with the highest F1; the lowest such score on a tie."""
    levels = score_levels(df, score, label)
    positives = levels.agg(F.sum("pos")).scalar()
    precision = F.col("cum_pos") / F.col("cum_n")
    recall = F.col("cum_pos") / F.nullif(positives, F.lit(0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-6))
    scored = levels.select("score", f1.alias("f1"))
    return scored.agg(F.max(F.struct("f1", (-F.col("score")).alias("low"))).alias("m")).select(
        (-F.col("m.low")).alias("threshold"), F.col("m.f1").alias("f1")
    )


def top_shares(df: DataFrame, key: str, score: str, label: str, shares=TOP_SHARES) -> DataFrame:
    """Precision and recall when only the riskiest share is contacted."""
    total = df.count()
    order = [F.col(score).desc(), F.col(key).asc()]
    run = with_running(df.select(key, score, label), order, "rank", {"caught": F.col(label).cast("bigint")})
    sizes = {share: share_size(share, total) for share in shares}
    cuts = run.where(F.col("rank").isin(*sizes.values(), total)).select("rank", "caught")
    # At most one row per share and the last row: a handful.
    caught = {r["rank"]: r["caught"] for r in cuts.collect()}
    positives = max(caught[total], 1)
    rows = [(float(s), n, caught[n] / n, caught[n] / positives) for s, n in sizes.items()]
    return df.sparkSession.createDataFrame(rows, "share double, customers bigint, precision double, recall double")


def reliability(df: DataFrame, key: str, score: str, label: str, bins: int = 10) -> DataFrame:
    """Predicted against observed rate in equal-size bins of the score order."""
    run = with_running(df.select(key, score, label), [F.col(score).asc(), F.col(key).asc()], "rank")
    n = df.agg(F.count("*")).scalar()
    place = F.ceil((F.col("rank") - 1) * bins / F.greatest(n - 1, F.lit(1)))
    return run.withColumn("bin", F.greatest(place, F.lit(1)).cast("bigint")).groupBy("bin").agg(
        F.count("*").alias("customers"),
        F.avg(score).alias("predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"),
    )


def threshold_sweep(df: DataFrame, score: str, label: str, thresholds: list[float]) -> DataFrame:
    """Confusion counts and F1 at each threshold, from one pass."""
    y, p = F.col(label) == 1, F.col(score)
    entries = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.count_if(y & (p >= t)).alias("tp"),
            F.count_if(~y & (p >= t)).alias("fp"),
            F.count_if(y & (p < t)).alias("fn"),
            F.count_if(~y & (p < t)).alias("tn"),
        )
        for t in thresholds
    ]
    rows = df.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def release_checks(metrics: dict, capture: float, baseline_pr_auc: float | None) -> list[dict]:
    """The four release checks as rows: value and verdict."""
    gap = abs(metrics["mean_score"] - metrics["rate"])
    better = baseline_pr_auc is None or metrics["pr_auc"] > baseline_pr_auc
    return [
        {"check": "capture", "value": capture, "passed": capture >= 0.50},
        {"check": "better_than_chance", "value": metrics["pr_auc"] / metrics["rate"], "passed": metrics["pr_auc"] >= 3.0 * metrics["rate"]},
        {"check": "better_than_baseline", "value": metrics["pr_auc"], "passed": better},
        {"check": "calibration", "value": gap, "passed": gap <= 0.01},
    ]


def bootstrap(df: DataFrame, score: str, label: str, repeats: int = 2000, seed: int = 42) -> DataFrame:
    """ROC-AUC and average precision on resamples, with each row drawn Poisson(1) times.

    Equal (score, label) rows are counted first; c such rows together are drawn Poisson(c)
    times, so the work grows with distinct scores, not with customers. Draws depend only on
    the seed, the score and the label, so retried tasks repeat them.
    """
    counted = df.groupBy(F.col(score).cast("double").alias("score"), F.col(label).cast("bigint").alias("y")).agg(
        F.count("*").alias("c")
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s, y, c in zip(batch["score"], batch["y"], batch["c"]):
                bits = int(np.float64(s).view(np.uint64))
                times = np.random.default_rng([seed, bits, int(y)]).poisson(c, repeats)
                hit = np.flatnonzero(times)
                yield pd.DataFrame({"replicate": hit, "score": s, "n": times[hit], "pos": times[hit] * int(y)})

    drawn = counted.mapInPandas(draw, "replicate bigint, score double, n bigint, pos bigint")
    levels = drawn.groupBy("replicate", "score").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    run = with_running(
        levels, [F.col("replicate").asc(), F.col("score").desc()], None, {"cum_n": F.col("n"), "cum_pos": F.col("pos")}
    )
    start = run.groupBy("replicate").agg(
        F.min(F.col("cum_n") - F.col("n")).alias("n0"), F.min(F.col("cum_pos") - F.col("pos")).alias("p0")
    )
    inside = run.join(F.broadcast(start), "replicate").withColumns(
        {"cn": F.col("cum_n") - F.col("n0"), "cp": F.col("cum_pos") - F.col("p0")}
    )
    neg = F.col("n") - F.col("pos")
    sums = inside.groupBy("replicate").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.sum(neg * (F.col("cp") - F.col("pos")) + 0.5 * F.col("pos") * neg).alias("pairs"),
        F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("prec"),
    )
    scored = sums.where((F.col("pos") > 0) & (F.col("pos") < F.col("n")))
    return scored.select(
        "replicate",
        (F.col("pairs") / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("roc_auc"),
        (F.col("prec") / F.col("pos")).alias("pr_auc"),
    )


def interval_of(samples: DataFrame, metric: str) -> DataFrame:
    """Central 95 % of the resampled metric; one row per replicate goes in."""
    return samples.agg(
        F.percentile(metric, F.lit(0.025)).alias("low"), F.percentile(metric, F.lit(0.975)).alias("high")
    )


# --- Forecasts ---------------------------------------------------------------------------


def forecast_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, WAPE, MAPE and R2 per series."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    rows = df.where(y.isNotNull() & F.col(predicted).isNotNull())
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(F.abs(error)).alias("_ae"),
        F.sum(F.abs(y)).alias("_ay"),
        F.avg(F.abs(F.try_divide(error, y))).alias("_ape"),
        F.sum(error * error).alias("_sse"),
        F.var_pop(y).alias("_var"),
    )
    return out.select(
        *keys, "n", "mae", "rmse",
        F.when(F.col("_ay") < 1e-8, 0.0).otherwise(F.col("_ae") / F.col("_ay") * 100).alias("wape"),
        (F.col("_ape") * 100).alias("mape"),
        F.when(F.col("_var") <= 1e-9, 0.0).otherwise(1 - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"),
    )


def seasonal_scale(train: DataFrame, keys: list[str], date: str, value: str, season: int = 7) -> DataFrame:
    """Mean seasonal step of each training series (one-step when it is too short), and its mean."""
    w = Window.partitionBy(*keys).orderBy(date)
    x = F.col(value)
    steps = train.withColumns(
        {
            "_season": F.abs(x - F.lag(value, season).over(w)),
            "_step": F.abs(x - F.lag(value, 1).over(w)),
        }
    )
    return steps.groupBy(*keys).agg(
        (F.coalesce(F.avg("_season"), F.avg("_step")) + 1e-8).alias("scale"), F.avg(x).alias("train_mean")
    )


def scaled_metrics(test: DataFrame, scale: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """MASE against the seasonal step and skill against the training mean, per series."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    rows = test.where(y.isNotNull() & F.col(predicted).isNotNull()).join(scale, keys)
    bench = F.avg(F.pow(y - F.col("train_mean"), F.lit(2.0)))
    out = rows.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.max("scale").alias("scale"),
        F.avg(error * error).alias("_mse"), bench.alias("_bench"),
    )
    return out.select(
        *keys,
        half_even(F.col("mae") / F.col("scale"), 3).alias("mase"),
        half_even(F.when(F.col("_bench") > 1e-9, 1 - F.col("_mse") / (F.col("_bench") + 1e-9)).otherwise(0.0), 4).alias("r2_bench"),
        (half_even(F.col("mae") / F.col("scale"), 3) < 1).alias("beats_naive"),
    )


def network_aggregate(df: DataFrame, date: str, actual: str, predicted: str, how: str = "avg") -> DataFrame:
    """Sum or mean over all entities per day, actual against predicted."""
    f = F.sum if how == "sum" else F.avg
    return df.groupBy(date).agg(f(actual).alias("actual"), f(predicted).alias("predicted"))


def anchored(forecast: DataFrame, keys: list[str], step: str, value: str, last: Column, decay: float = 0.07) -> DataFrame:
    """Shift a forecast to start at the last observation, fading over the horizon."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(step))
    return forecast.withColumn(value, F.col(value) + (last - first) * F.exp(-decay * F.col(step)))


def widened(forecast: DataFrame, value: str, sd: Column, step: Column) -> DataFrame:
    """80 and 95 % bands that widen with the horizon."""
    spread = sd * (1 + F.sqrt(step / 7.0))
    return forecast.withColumns(
        {
            "lower_80": F.col(value) - 1.28 * spread,
            "upper_80": F.col(value) + 1.28 * spread,
            "lower_95": F.col(value) - 1.96 * spread,
            "upper_95": F.col(value) + 1.96 * spread,
        }
    )


def residual_quantiles(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """5th and 95th percentile of the residuals per series, for interval forecasts."""
    residual = df.withColumn("_r", F.col(actual) - F.col(predicted))
    return quantiles_by(residual, keys, "_r", {"p05": 0.05, "p95": 0.95})


def adjusted_rand(df: DataFrame, left: str, right: str) -> DataFrame:
    """Agreement of two partitions, from their contingency table."""

    def pairs(c: Column) -> Column:
        c = c.cast("double")
        return c * (c - 1) / 2

    cells = df.groupBy(left, right).agg(F.count("*").alias("n"))
    together = cells.agg(F.sum(pairs(F.col("n")))).scalar()
    a = cells.groupBy(left).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    b = cells.groupBy(right).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n")))).scalar()
    row = cells.agg(F.sum("n").alias("n")).select(
        together.alias("t"), a.alias("a"), b.alias("b"), pairs(F.col("n")).alias("all")
    )
    expected = F.col("a") * F.col("b") / F.col("all")
    return row.select(
        F.coalesce(F.try_divide(F.col("t") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)).alias("adjusted_rand")
    )
