"""Checks of a ranking or a model on whole groups, hidden sites and changed assumptions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mastwire.operators.geo import nearest, nearest_in_sets, radius_sums
from mastwire.operators.ordered import quantiles_by, with_running
from mastwire.operators.planning import evaluate_eligibility
from mastwire.operators.retention import within_budget
from mastwire.session import materialize


def lottery(key: Column, seed: str) -> Column:
    """A number of 48 bits from a seed and a key, the same in every run."""
    text = F.concat(F.lit(seed + ":"), key.cast("string")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def rank_within(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based rank inside each group; rows are placed by range, so a group may hold all of them."""
    run = with_running(df, [*[F.col(b).asc() for b in by], *order], "_at")
    first = run.groupBy(*by).agg(F.min("_at").alias("_first"))
    return run.join(first, by).withColumn(rank, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


# --- Whole groups ----------------------------------------------------------------------------


def held_out_groups(df: DataFrame, group: str, share: float = 0.2, max_share: float = 0.3, seed: str = "42") -> DataFrame:
    """(group, rows, held_out): whole groups drawn until they cover the share of all rows.

    The order is a lottery. A group that would push the hold-out above the larger share is skipped,
    so that one huge group cannot swallow the split. Missing groups count as `Unknown`.
    """
    sizes = materialize(df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias(group)).agg(F.count("*").alias("rows")))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    drawn = sizes.withColumn("_draw", -lottery(F.col(group), seed))
    fits = within_budget(drawn, group, "_draw", "rows", int(max_share * total)) if total else drawn.select(group, F.lit(False).alias("selected"))
    taken = with_running(drawn.join(fits, group).where("selected"), [F.col("_draw").desc(), F.col(group).asc()], None, {"_covered": F.col("rows")})
    chosen = taken.where(F.col("_covered") - F.col("rows") < share * total).select(group, F.lit(True).alias("held_out"))
    return sizes.join(chosen, group, "left").fillna(False, ["held_out"])


def group_folds(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """(group, rows, fold): whole groups, largest first, dealt forwards and back over the folds.

    Two folds then differ by no more than the largest group.
    """
    sizes = df.groupBy(F.coalesce(F.col(group).cast("string"), F.lit("Unknown")).alias(group)).agg(F.count("*").alias("rows"))
    dealt = with_running(sizes, [F.col("rows").desc(), F.col(group).asc()], "_rank")
    at = F.pmod(F.col("_rank") - 1, F.lit(2 * folds))
    return dealt.select(group, "rows", F.when(at < folds, at).otherwise(2 * folds - 1 - at).cast("int").alias("fold"))


def auc_by(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """ROC-AUC in each group; equal scores share a rank. Missing where a group has one class only."""
    levels = df.groupBy(*by, F.col(score).alias("_score")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    run = with_running(levels, [*[F.col(b).asc() for b in by], F.col("_score").desc()], None, {"_cum": F.col("_pos")})
    totals = levels.groupBy(*by).agg(F.sum("_n").alias("rows"), F.sum("_pos").alias("positives"))
    first = run.groupBy(*by).agg(F.min(F.col("_cum") - F.col("_pos")).alias("_before"))
    neg, above = F.col("_n") - F.col("_pos"), F.col("_cum") - F.col("_pos") - F.col("_before")
    pairs = run.join(first, by).groupBy(*by).agg(F.sum((neg * above).cast("double") + 0.5 * neg * F.col("_pos")).alias("_pairs"))
    both = F.col("positives").cast("double") * (F.col("rows") - F.col("positives"))
    return totals.join(pairs, by).select(*by, "rows", "positives", F.try_divide("_pairs", F.nullif(both, F.lit(0.0))).alias("roc_auc"))


def caught_in_top(df: DataFrame, by: list[str], key: str, score: str, label: str, shares: list[float]) -> DataFrame:
    """Precision and recall among the best share of each group (rounded half to even, at least one row)."""
    ranked = rank_within(df.select(*by, key, score, F.col(label).cast("int").alias("_hit")), by, [F.col(score).desc(), F.col(key).asc()])
    totals = ranked.groupBy(*by).agg(F.count("*").alias("_rows"), F.sum("_hit").alias("_hits"))
    cut = F.greatest(F.bround(F.col("_rows") * F.col("share")).cast("bigint"), F.lit(1))
    rows = ranked.join(totals, by).withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).where(F.col("rank") <= cut)
    return rows.groupBy(*by, "share").agg(
        F.avg("_hit").alias("precision"), F.try_divide(F.sum("_hit"), F.max("_hits")).alias("recall"))


def declared_day_split(df: DataFrame, day: str, training: list[dt.date], holdout: list[dt.date]) -> DataFrame:
    """Rows with `split`, after checking that the declared days are distinct, in order and the observed ones."""
    if not training or not holdout or len({*training, *holdout}) < len(training) + len(holdout) or max(training) >= min(holdout):
        raise ValueError("Training and hold-out days must be distinct, and every training day before the hold-out.")
    observed = df.select(day).distinct()
    declared = df.sparkSession.createDataFrame([(d,) for d in [*training, *holdout]], f"{day} date")
    odd = observed.join(declared, day, "left_anti").unionByName(declared.join(observed, day, "left_anti")).take(1)
    if odd:
        raise ValueError(f"Observed and declared days differ: {odd[0][0]}.")
    return df.withColumn("split", F.when(F.col(day) >= F.lit(min(holdout)), "holdout").otherwise("training"))


# --- Hidden sites ----------------------------------------------------------------------------


def hidden_in(fold: int, site: str, share: float = 0.2, seed: str = "recovery") -> Column:
    return lottery(F.col(site), f"{seed}:{fold}") < int(share * (1 << 48))


def known_site_recovery(
    cells: DataFrame, sites: DataFrame, cell: str, site: str, score, baseline: str, folds: int = 5, share: float = 0.2, density_m: float = 3000.0
) -> DataFrame:
    """How well a score finds cells whose sites were hidden, fold by fold, against a baseline column.

    `cells` has its key, lon, lat and the baseline; `sites` has its key, lon, lat and the key of its cell
    (null outside the grid; such sites are never hidden). `score(distance, density, sites)` builds the score from the distance to
    the nearest remaining site (50 km where none remains), the remaining sites within ``density_m`` and those in the cell.
    All folds share one search and one radius sum: no distances are built anew.
    """
    inside = F.col(cell).isNotNull()
    stays = {f"f{k}": ~(inside & hidden_in(k, site, share)) for k in range(folds)}
    distances = nearest_in_sets(cells, sites, stays)
    sums = radius_sums(cells, sites, [density_m], {n: c.cast("int") for n, c in stays.items()})
    held = sites.where(inside).groupBy(cell).agg(
        *[F.sum(c.cast("int")).alias(f"here_{n}") for n, c in stays.items()], *[F.max((~c).cast("int")).alias(f"lost_{n}") for n, c in stays.items()])
    wide = cells.join(distances, ["lon", "lat"], "left").join(sums, ["lon", "lat"], "left").join(held, cell, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    each = F.array(*[F.struct(
        F.lit(k).alias("fold"), score(F.coalesce(F.col(f"f{k}"), F.lit(50_000.0)), zero(f"f{k}_{int(density_m)}"), zero(f"here_f{k}")).cast("double").alias("score"),
        zero(f"lost_f{k}").alias("lost"), (zero(f"here_f{k}") == 0).alias("unserved")) for k in range(folds)])
    rows = materialize(wide.select(cell, F.col(baseline).cast("double").alias("baseline"), F.explode(each).alias("e")).select(cell, "baseline", "e.*"))
    views = rows.withColumn("view", F.explode(F.when(F.col("unserved"), F.array(F.lit("all"), F.lit("unserved"))).otherwise(F.array(F.lit("all")))))
    long = views.select(cell, "fold", "view", "lost", F.explode(F.array(
        F.struct(F.lit("score").alias("ranked_by"), F.col("score").alias("value")), F.struct(F.lit("baseline").alias("ranked_by"), F.col("baseline").alias("value")))).alias("x"))
    long = materialize(long.select(cell, "fold", "view", "lost", "x.*"))
    keys = ["fold", "view", "ranked_by"]
    recall = caught_in_top(long, keys, cell, "value", "lost", [0.10, 0.25]).groupBy(*keys).agg(
        F.max(F.when(F.col("share") == 0.10, F.col("recall"))).alias("recall_top10"), F.max(F.when(F.col("share") == 0.25, F.col("recall"))).alias("recall_top25"))
    return auc_by(long, keys, "value", "lost").join(recall, keys)


# --- Changed assumptions ---------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    """One weighting of the score's components; weights are made to add up to one."""

    name: str
    factor: float
    weights: tuple[float, ...]


def changed_weights(components: list[str], weights: tuple[float, ...], factors=(0.5, 1.5)) -> list[Scenario]:
    """The given weighting first, then each weight scaled by each factor."""
    out = [Scenario("unchanged", 1.0, weights)]
    for i, name in enumerate(components):
        out += [Scenario(name, f, tuple(w * f if i == j else w for j, w in enumerate(weights))) for f in factors]
    return out


def ranking_stability(df: DataFrame, key: str, components: list[str], scenarios: list[Scenario], top_k: int) -> DataFrame:
    """Spearman correlation and overlap of the best k with the first scenario, for every other one.

    All scenarios are scored in one pass and ranked in one order by range; equal scores share their mean rank.
    Missing components count as 0, and scores are compared at ten decimals.
    """
    def total(s: Scenario) -> Column:
        out = F.lit(0.0)
        for c, w in zip(components, s.weights, strict=True):
            out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (w / sum(s.weights))
        return F.round(out, 10)

    scored = materialize(df.select(key, F.explode(F.array(*[
        F.struct(F.lit(i).alias("scenario"), total(s).alias("score")) for i, s in enumerate(scenarios)])).alias("s")).select(key, "s.*"))
    levels = scored.groupBy("scenario", "score").agg(F.count("*").alias("_n"))
    run = with_running(levels, [F.col("scenario").asc(), F.col("score").asc()], None, {"_cum": F.col("_n")})
    ranks = scored.join(run.select("scenario", "score", (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias("_rank")), ["scenario", "score"])
    base = ranks.where("scenario = 0").select(key, F.col("_rank").alias("_base"))
    rho = ranks.join(base, key).groupBy("scenario").agg(F.corr("_rank", "_base").alias("spearman"))
    best = Window.partitionBy("scenario").orderBy(F.col("score").desc(), key)
    top = scored.withColumn("_i", F.row_number().over(best)).where(F.col("_i") <= top_k).select("scenario", key)
    shared = top.join(top.where("scenario = 0").select(key), key).groupBy("scenario").agg(F.count("*").alias("_shared"))
    taken = top.where("scenario = 0").agg(F.count("*").alias("_taken"))
    names = df.sparkSession.createDataFrame([(i, s.name, float(s.factor)) for i, s in enumerate(scenarios)], "scenario int, component string, factor double")
    return (names.where("scenario > 0").join(rho, "scenario", "left").join(shared, "scenario", "left")
            .select("component", "factor", "spearman", (F.coalesce("_shared", F.lit(0)) / F.nullif(taken.scalar(), F.lit(0))).alias("top_overlap")))


def without_evidence(df: DataFrame, key: str, flag: str, field: str | None, every: int = 10) -> DataFrame:
    """The rows with one kind of evidence taken from each ``every``-th of them by key, marked `affected`."""
    ranked = with_running(df, [F.col(key).asc()], "_rank").withColumn("affected", F.pmod(F.col("_rank") - 1, F.lit(every)) == 0).drop("_rank")
    blank = {flag: F.when(F.col("affected"), False).otherwise(F.col(flag))}
    if field:
        blank[field] = F.when(~F.col("affected"), F.col(field))
    return ranked.withColumns(blank)


def evidence_stress(df: DataFrame, key: str, removals: dict[str, str | None], every: int = 10) -> DataFrame:
    """Eligible candidates left, and affected ones still eligible, after each removal of evidence."""
    out = None
    for flag, field in removals.items():
        rows = evaluate_eligibility(without_evidence(df, key, flag, field, every)).agg(
            F.count_if("affected").alias("affected"), F.count_if("eligible").alias("eligible"),
            F.count_if(F.col("affected") & F.col("eligible")).alias("affected_eligible"))
        rows = rows.select(F.lit(flag).alias("removed"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def cutoff_sensitivity(df: DataFrame, limits: dict[str, float], factors=(0.5, 1.5)) -> DataFrame:
    """Eligible candidates when one limit is scaled and the others stay; all in one pass."""
    changes = [(n, f) for n in limits for f in factors]
    flags = df
    for i, (name, factor) in enumerate(changes):
        flags = evaluate_eligibility(flags, **{name: limits[name] * factor}).withColumnRenamed("eligible", f"_e{i}").drop("rejection_reasons")
    row = flags.agg(*[F.count_if(f"_e{i}").alias(f"_e{i}") for i in range(len(changes))])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("cutoff"), F.lit(float(f)).alias("factor"), F.col(f"_e{i}").alias("eligible")) for i, (n, f) in enumerate(changes)
    ])).alias("x")).select("x.*")


def shortlist_proximity(shortlist: DataFrame, baseline: DataFrame, within_m: float = 2500.0) -> DataFrame:
    """Picks of one shortlist near a pick of another, and the median of the nearest distances; one row."""
    gaps = materialize(shortlist.select("lon", "lat").join(nearest(shortlist, baseline), ["lon", "lat"], "left"))
    middle = quantiles_by(gaps, [], "distance_m", {"median_distance_m": 0.5})
    return gaps.agg(F.count("*").alias("picks"), F.count_if(F.col("distance_m") <= within_m).alias("near_picks")).withColumn(
        "median_distance_m", middle.select("median_distance_m").scalar())
