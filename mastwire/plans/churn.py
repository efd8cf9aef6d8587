"""Registered subscriber queries: contract, cleaning, labels, features, value and market."""

from __future__ import annotations

from pyspark.sql import functions as F

from mastwire.functions.numeric import signed_log1p
from mastwire.operators import contracts as C
from mastwire.operators import market as M
from mastwire.operators import subscribers as B
from mastwire.operators import value as V
from mastwire.plans.adapters import view
from mastwire.plans.network import rounded
from mastwire.plans.registry import query

RATE = 0.05


def export(spark, sf):
    return view(spark, sf, "v_subscribers")


def cleaned(spark, sf):
    return B.clean(export(spark, sf))


def window(spark, sf, which=B.WINDOW_B, keep=("id",)):
    return B.add_features(B.window_features(cleaned(spark, sf), which, keep))


def active_window(spark, sf, which=B.WINDOW_B):
    rows = cleaned(spark, sf).where(B.is_active(which))
    return B.add_features(B.window_features(rows, which))


def catalogue(spark, sf):
    return view(spark, sf, "v_offers")


INACTIVE = (
    "coalesce(total_ic_mou_{m}, 0) = 0 AND coalesce(total_og_mou_{m}, 0) = 0 "
    "AND coalesce(vol_2g_mb_{m}, 0) = 0 AND coalesce(vol_3g_mb_{m}, 0) = 0"
)
NO_RECHARGE = "coalesce(total_rech_num_{m}, 0) = 0 AND coalesce(total_rech_data_{m}, 0) = 0"


def days_sql(column: str, month: int) -> str:
    last = {6: 30, 7: 31, 8: 31}[month]
    return f"coalesce({last} - day(CAST({column}_{month} AS DATE)), {last})"


def share_sql(part: str, whole: str) -> str:
    return f"coalesce(({part}) / nullif({whole}, 0), 0.5)"


# The prev_/cur_ names of window B on the raw export, blocks filled with zero.
_Z = ["total_rech_data", "av_rech_amt_data", "onnet_mou", "offnet_mou", "roam_ic_mou", "roam_og_mou"]
_N = [
    "arpu", "total_og_mou", "total_ic_mou", "vol_2g_mb", "vol_3g_mb", "total_rech_num", "total_rech_amt",
    "monthly_2g", "monthly_3g", "sachet_2g", "sachet_3g",
]


def window_sql(previous: int, current: int, where: str = "true") -> str:
    columns = []
    for prefix, m in (("prev", previous), ("cur", current)):
        columns += [f"coalesce({b}_{m}, 0) AS {prefix}_{b}" for b in _Z]
        columns += [f"{b}_{m} AS {prefix}_{b}" for b in _N]
        columns.append(f"{days_sql('date_of_last_rech', m)} AS {prefix}_d1")
        columns.append(f"{days_sql('date_of_last_rech_data', m)} AS {prefix}_d2")
    return (
        f"w AS (SELECT id, aon AS tenure_days, churn_probability, {', '.join(columns)}, "
        f"CASE WHEN coalesce(total_rech_num_{current}, 0) > 0 THEN {days_sql('date_of_last_rech', current)} "
        f"ELSE {days_sql('date_of_last_rech', current)} + {days_sql('date_of_last_rech', previous)} END AS r1, "
        f"CASE WHEN coalesce(total_rech_data_{current}, 0) > 0 THEN {days_sql('date_of_last_rech_data', current)} "
        f"ELSE {days_sql('date_of_last_rech_data', current)} + {days_sql('date_of_last_rech_data', previous)} END AS r2 "
        f"FROM {{v_subscribers}} WHERE {where})"
    )


WINDOW_SQL = window_sql(7, 8)
ACTIVE_SQL = window_sql(7, 8, f"NOT ({INACTIVE.format(m=8)})")
MEASURES_SQL = f"""v AS (SELECT id, least(r1, r2) AS recency,
     (prev_total_rech_num + prev_total_rech_data + cur_total_rech_num + cur_total_rech_data) / 2 AS frequency,
     (prev_total_rech_amt + prev_total_rech_data * prev_av_rech_amt_data + cur_total_rech_amt + cur_total_rech_data * cur_av_rech_amt_data) / 2 * {RATE} AS monetary,
     tenure_days AS tenure,
     CAST(greatest(prev_total_ic_mou, prev_total_og_mou, cur_total_ic_mou, cur_total_og_mou) > 0 AS INT)
     + CAST(greatest(prev_vol_2g_mb, prev_vol_3g_mb, cur_vol_2g_mb, cur_vol_3g_mb) > 0 AS INT)
     + CAST(greatest(prev_monthly_2g, prev_monthly_3g, prev_sachet_2g, prev_sachet_3g, cur_monthly_2g, cur_monthly_3g, cur_sachet_2g, cur_sachet_3g) > 0 AS INT)
     + CAST(greatest(prev_roam_ic_mou, prev_roam_og_mou, cur_roam_ic_mou, cur_roam_og_mou) > 0 AS INT) AS engagement FROM w)"""


@query(
    "subscriber_clean_export",
    f"""SELECT id, aon, CAST(onnet_mou_6 IS NULL AS INT) AS no_voice_record_6, CAST(onnet_mou_8 IS NULL AS INT) AS no_voice_record_8,
          coalesce(onnet_mou_7, 0) AS onnet_mou_7, coalesce(av_rech_amt_data_8, 0) AS av_rech_amt_data_8, arpu_6, jul_vbc_3g,
          {days_sql("date_of_last_rech", 6)} AS days_since_last_rech_6, {days_sql("date_of_last_rech_data", 8)} AS days_since_last_rech_data_8
        FROM {{v_subscribers}}""",
)
def subscriber_clean_export(spark, sf):
    return cleaned(spark, sf).select(
        "id", "aon", "no_voice_record_6", "no_voice_record_8", "onnet_mou_7", "av_rech_amt_data_8", "arpu_6",
        "jul_vbc_3g", "days_since_last_rech_6", "days_since_last_rech_data_8",
    )


@query(
    "subscriber_contract_failures",
    """SELECT * FROM (
         SELECT 'total_rech_num_6' AS "column", 'not negative' AS "check", count(*) AS failures FROM {v_subscribers} WHERE total_rech_num_6 - 5 < 0
         UNION ALL SELECT 'total_rech_num_6', 'whole number', 0 WHERE false
         UNION ALL SELECT 'rows', 'data block missing together in month 7', count(*) FROM {v_subscribers} WHERE arpu_2g_7 > 50
         UNION ALL SELECT 'rows', 'recharge date missing only without recharges in month 6', count(*) FROM {v_subscribers}
             WHERE (date_of_last_rech_6 IS NULL) <> (total_rech_num_6 - 5 = 0)
         UNION ALL SELECT 'aon', 'whole number', count(*) FROM {v_subscribers} WHERE aon > 2000) x WHERE failures > 0""",
)
def subscriber_contract_failures(spark, sf):
    broken = export(spark, sf).withColumns(
        {
            "total_rech_num_6": F.col("total_rech_num_6") - 5,
            "arpu_2g_7": F.when(F.col("arpu_2g_7") > 50, None).otherwise(F.col("arpu_2g_7")),
            "aon": F.when(F.col("aon") > 2000, F.col("aon") + 0.5).otherwise(F.col("aon")),
        }
    )
    return C.summarize(broken, B.row_rules()).select("column", "check", "failures")


@query(
    "subscriber_inactivity_by_month",
    " UNION ALL ".join(
        f"""SELECT {m} AS month, round(avg(CAST(u AS INT)), 6) AS usage_inactive, round(avg(CAST(r AS INT)), 6) AS recharge_inactive,
              round(avg(CAST(u AND r AS INT)), 6) AS both, round(avg(CAST(u AND NOT r AS INT)), 6) AS usage_only,
              round(avg(CAST(NOT u AND r AS INT)), 6) AS recharge_only
            FROM (SELECT ({INACTIVE.format(m=m)}) AS u, ({NO_RECHARGE.format(m=m)}) AS r FROM {{v_subscribers}}) x{m}"""
        for m in (6, 7, 8)
    ),
)
def subscriber_inactivity_by_month(spark, sf):
    out = B.inactivity_by_month(export(spark, sf))
    return rounded(out, "usage_inactive", "recharge_inactive", "both", "usage_only", "recharge_only")


@query(
    "subscriber_missing_by_month",
    " UNION ALL ".join(
        f"SELECT '{b}' AS base, {m} AS month, round(avg(CAST({B.month_column(b, m)} IS NULL AS INT)), 6) AS missing_share FROM {{v_subscribers}}"
        for m in (6, 7, 8)
        for b in ("onnet_mou", "arpu_2g", "vbc_3g", "date_of_last_rech")
    ),
)
def subscriber_missing_by_month(spark, sf):
    out = B.missing_by_month(export(spark, sf), ["onnet_mou", "arpu_2g", "vbc_3g", "date_of_last_rech"])
    return rounded(out, "missing_share")


@query(
    "subscriber_missing_agreement",
    " UNION ALL ".join(
        f"""SELECT '{b}' AS base, {m} AS month, round(avg(CAST(({b}_{m} IS NULL) = (date_of_last_rech_data_{m} IS NULL) AS INT)), 6) AS agreement
            FROM {{v_subscribers}} HAVING count(*) FILTER ({b}_{m} IS NULL) > 0"""
        for m in (6, 7, 8)
        for b in ("onnet_mou", "arpu_2g", "date_of_last_rech")
    ),
)
def subscriber_missing_agreement(spark, sf):
    out = B.missing_agreement(export(spark, sf), "date_of_last_rech_data")
    return rounded(out.where(F.col("base").isin("onnet_mou", "arpu_2g", "date_of_last_rech")), "agreement")


@query(
    "subscriber_zero_usage_without_minutes",
    " UNION ALL ".join(
        f"""SELECT {m} AS month, count(*) FILTER (onnet_mou_{m} IS NULL) AS customers_with_missing_minutes,
              avg(CAST(coalesce(total_ic_mou_{m}, 0) = 0 AND coalesce(total_og_mou_{m}, 0) = 0 AS INT)) FILTER (onnet_mou_{m} IS NULL) AS share_with_zero_totals
            FROM {{v_subscribers}}"""
        for m in (6, 7, 8)
    ),
)
def subscriber_zero_usage_without_minutes(spark, sf):
    return B.zero_usage_without_minutes(export(spark, sf))


@query(
    "subscriber_column_facts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", coalesce(min({c}) = max({c}), true) AS is_constant, count(*) FILTER ({c} < 0) AS negative_rows,
              CAST(min({c}) AS DOUBLE) AS minimum FROM {{v_subscribers}}"""
        for c in ("aon", "arpu_6", "arpu_8", "total_rech_amt_7", "churn_probability", "sachet_3g_6")
    ),
)
def subscriber_column_facts(spark, sf):
    return B.column_facts(
        export(spark, sf), ["aon", "arpu_6", "arpu_8", "total_rech_amt_7", "churn_probability", "sachet_3g_6"]
    )


@query(
    "event_duplicates",
    """SELECT CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {events} GROUP BY user_id) a) AS BIGINT) AS duplicate_ids,
         CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {events} GROUP BY event_type, floor(value)) b) AS BIGINT) AS duplicate_rows_ignoring_id""",
)
def event_duplicates(spark, sf):
    rows = view(spark, sf, "events").select("user_id", "event_type", F.floor("value").alias("v"))
    return B.duplicate_counts(rows, "user_id")


@query(
    "subscriber_label_against_month",
    f"""SELECT round(avg(churn_probability), 6) AS label_rate, round(avg(CAST(u AS INT)) FILTER (churn_probability = 1), 6) AS churners_already_inactive,
          round(avg(churn_probability) FILTER (u), 6) AS label_rate_if_inactive, round(avg(churn_probability) FILTER (NOT u), 6) AS label_rate_if_active
        FROM (SELECT churn_probability, ({INACTIVE.format(m=8)}) AS u FROM {{v_subscribers}}) x""",
)
def subscriber_label_against_month(spark, sf):
    out = B.label_against_month(export(spark, sf))
    return rounded(out, *out.columns)


@query(
    "subscriber_window_features",
    f"""WITH {WINDOW_SQL} SELECT id, tenure_days, r1 AS days_since_last_rech_window, r2 AS days_since_last_rech_data_window,
          cur_arpu - prev_arpu AS diff_arpu, (cur_total_og_mou + cur_total_ic_mou) - (prev_total_og_mou + prev_total_ic_mou) AS diff_total_mou,
          (cur_vol_2g_mb + cur_vol_3g_mb) - (prev_vol_2g_mb + prev_vol_3g_mb) AS diff_data_mb,
          round({share_sql("cur_total_rech_amt", "cur_total_rech_amt + prev_total_rech_amt")}, 6) AS trend_total_rech_amt,
          round({share_sql("cur_onnet_mou", "cur_onnet_mou + cur_offnet_mou")}, 6) AS cur_onnet_share,
          round({share_sql("cur_total_ic_mou", "cur_total_ic_mou + cur_total_og_mou")} - {share_sql("prev_total_ic_mou", "prev_total_ic_mou + prev_total_og_mou")}, 6) AS diff_incoming_share,
          round(sign(cur_arpu) * ln(1 + abs(cur_arpu)), 6) AS log_arpu FROM w""",
)
def subscriber_window_features(spark, sf):
    out = window(spark, sf).withColumn("log_arpu", signed_log1p(F.col("cur_arpu")))
    out = out.select(
        "id", "tenure_days", "days_since_last_rech_window", "days_since_last_rech_data_window", "diff_arpu",
        "diff_total_mou", "diff_data_mb", "trend_total_rech_amt", "cur_onnet_share", "diff_incoming_share", "log_arpu",
    )
    return rounded(out, "trend_total_rech_amt", "cur_onnet_share", "diff_incoming_share", "log_arpu")


@query(
    "subscriber_high_value",
    """WITH a AS (SELECT id, ((total_rech_amt_6 + coalesce(total_rech_data_6, 0) * coalesce(av_rech_amt_data_6, 0))
            + (total_rech_amt_7 + coalesce(total_rech_data_7, 0) * coalesce(av_rech_amt_data_7, 0))) / 2 AS recharge_amount FROM {v_subscribers})
       SELECT id, recharge_amount, recharge_amount >= (SELECT quantile_cont(recharge_amount, 0.7) FROM a) AS is_high_value FROM a""",
)
def subscriber_high_value(spark, sf):
    return B.high_value(cleaned(spark, sf), B.WINDOW_A).select("id", "recharge_amount", "is_high_value")


SPLIT_SQL = f"""h AS (SELECT id, churn_probability, ({INACTIVE.format(m=7)}) AS u7, ({INACTIVE.format(m=8)}) AS u8, sha256(concat('42:', id)) AS hx FROM {{v_subscribers}}),
   k AS (SELECT *, row_number() OVER (PARTITION BY u8 ORDER BY hx, id) AS r, count(*) OVER (PARTITION BY u8) AS n FROM h),
   s AS (SELECT *, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM k)"""


@query("subscriber_split", f"WITH {SPLIT_SQL} SELECT id, split FROM s")
def subscriber_split(spark, sf):
    rows = cleaned(spark, sf)
    return B.split_customers(rows, "id", B.window_label(B.WINDOW_A)).select("id", "split")


@query(
    "subscriber_dataset_report",
    f"""WITH {SPLIT_SQL}, a AS (SELECT *, CASE WHEN split = 'test' THEN NOT u8 ELSE NOT u7 END AS act,
           CASE WHEN split = 'test' THEN churn_probability ELSE CAST(u8 AS INT) END AS y FROM s)
        SELECT split, count(*) AS customers, count(*) FILTER (NOT act) AS already_silent, count(*) FILTER (act) AS rows,
           round_even(avg(y) FILTER (act), 4) AS churn_rate FROM a GROUP BY split""",
)
def subscriber_dataset_report(spark, sf):
    return B.dataset_report(B.split_customers(cleaned(spark, sf), "id", B.window_label(B.WINDOW_A)))


@query(
    "customer_value_measures",
    f"""WITH {WINDOW_SQL}, {MEASURES_SQL} SELECT id, CAST(recency AS DOUBLE) AS recency, frequency, round(monetary, 5) AS monetary, tenure, engagement FROM v""",
)
def customer_value_measures(spark, sf):
    out = V.value_measures(window(spark, sf), RATE).select(
        "id", "recency", "frequency", "monetary", "tenure", "engagement"
    )
    return rounded(out, "monetary", digits=5)


def _cuts(name: str, source: str = "v") -> str:
    return (
        f"(SELECT CASE WHEN min({name}) = max({name}) THEN NULL ELSE quantile_cont({name}, [0.2, 0.4, 0.6, 0.8]) END FROM {source})"
    )


def _score(name: str, cut: str) -> str:
    return f"coalesce(1 + len(list_filter({cut}, lambda c: c < {name})), 3)"


TIER_SQL = f"""{ACTIVE_SQL}, {MEASURES_SQL},
   m AS (SELECT id, -CAST(recency AS DOUBLE) AS recency, CAST(frequency AS DOUBLE) AS frequency, CAST(monetary AS DOUBLE) AS monetary,
                CAST(tenure AS DOUBLE) AS tenure, CAST(engagement AS DOUBLE) AS engagement FROM v),
   c AS (SELECT {", ".join(f"{_cuts(n, 'm')} AS c_{n}" for n in V.DIMENSIONS)}),
   sc AS (SELECT m.*, {", ".join(f"{_score(n, 'c_' + n)} AS {n}_score" for n in V.DIMENSIONS)} FROM m, c),
   vs AS (SELECT *, (recency_score + frequency_score + monetary_score + tenure_score + engagement_score) / 5 AS value_score FROM sc),
   cc AS (SELECT {_cuts('value_score', 'vs')} AS c_all),
   tiers AS (SELECT vs.*, list_extract(['very_low', 'low', 'medium', 'high', 'very_high'], {_score('value_score', 'c_all')}) AS value_tier FROM vs, cc)"""


def tiered(spark, sf):
    frame = active_window(spark, sf)
    return V.apply_tiers(frame, V.fit_tiers(frame, RATE))


@query(
    "customer_value_tiers",
    f"""WITH {TIER_SQL} SELECT id, recency_score, frequency_score, monetary_score, tenure_score, engagement_score, value_score, value_tier FROM tiers""",
)
def customer_value_tiers(spark, sf):
    return tiered(spark, sf).select("id", *[f"{n}_score" for n in V.DIMENSIONS], "value_score", "value_tier")


@query(
    "value_tier_distribution",
    f"""WITH {TIER_SQL} SELECT t.value_tier, count(x.id) AS customers FROM (SELECT unnest(['very_low', 'low', 'medium', 'high', 'very_high']) AS value_tier) t
        LEFT JOIN tiers x ON x.value_tier = t.value_tier GROUP BY 1""",
)
def value_tier_distribution(spark, sf):
    return V.tier_distribution(tiered(spark, sf))


@query(
    "value_tier_crosstab",
    f"""WITH {TIER_SQL} SELECT t.value_tier, count(x.id) FILTER (engagement = 2) AS "2", count(x.id) FILTER (engagement = 3) AS "3", count(x.id) FILTER (engagement = 4) AS "4"
        FROM (SELECT unnest(['very_low', 'low', 'medium', 'high', 'very_high']) AS value_tier) t LEFT JOIN tiers x ON x.value_tier = t.value_tier GROUP BY 1""",
)
def value_tier_crosstab(spark, sf):
    return V.tier_crosstab(tiered(spark, sf), "engagement", [2, 3, 4])


@query(
    "value_scenarios",
    """SELECT subscriber_id, round(list_sum(list_transform(range(1, 13), lambda m: power(1 - churn_probability, m))), 5) AS expected_months_12m,
         round(monthly_spend_lyd * list_sum(list_transform(range(1, 13), lambda m: power(1 - CASE WHEN churn_probability * 1.5 > 1 THEN 1 ELSE churn_probability * 1.5 END, m))), 4) AS value_12m_low_lyd,
         round(monthly_spend_lyd * list_sum(list_transform(range(1, 13), lambda m: power(1 - churn_probability, m))), 4) AS value_12m_base_lyd,
         round(monthly_spend_lyd * list_sum(list_transform(range(1, 13), lambda m: power(1 - churn_probability * 0.5, m))), 4) AS value_12m_high_lyd
       FROM {v_decisions}""",
)
def value_scenarios(spark, sf):
    out = V.value_scenarios(view(spark, sf, "v_decisions").select("subscriber_id", "monthly_spend_lyd", "churn_probability"))
    out = out.drop("monthly_spend_lyd", "churn_probability")
    out = rounded(out, "expected_months_12m", digits=5)
    return rounded(out, "value_12m_low_lyd", "value_12m_base_lyd", "value_12m_high_lyd", digits=4)


@query(
    "portfolio_by_risk_band",
    """WITH b AS (SELECT * FROM (VALUES (0, 'high'), (1, 'medium'), (2, 'low'), (3, 'already_silent'), (4, 'unavailable')) t(position, risk_band))
       SELECT b.position, b.risk_band, count(d.subscriber_id) AS customers, round(sum(monthly_spend_lyd), 4) AS monthly_spend_lyd,
         round(sum(churn_probability), 4) AS expected_churners, round(sum(churn_probability * monthly_spend_lyd), 4) AS revenue_at_risk_lyd
       FROM b LEFT JOIN {v_decisions} d ON d.risk_band = b.risk_band GROUP BY 1, 2""",
)
def portfolio_by_risk_band(spark, sf):
    bands = ("high", "medium", "low", "already_silent", "unavailable")
    out = V.group_summary(view(spark, sf, "v_decisions"), "risk_band", bands)
    return rounded(out, "monthly_spend_lyd", "expected_churners", "revenue_at_risk_lyd", digits=4)


CARD_SQL = "(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 7.5 THEN 5.0 WHEN {x} <= 15 THEN 10.0 WHEN {x} <= 30 THEN 20.0 WHEN {x} <= 70 THEN 40.0 ELSE 100.0 END)"
PACK_SQL = """coalesce((SELECT offer_id FROM {{v_offers}} WHERE family_en {f} AND price_lyd <= {x} ORDER BY price_lyd DESC, offer_id DESC LIMIT 1),
   (SELECT offer_id FROM {{v_offers}} WHERE family_en {f} ORDER BY price_lyd, offer_id LIMIT 1))"""
VIEW_SQL = f"""{WINDOW_SQL}, u AS (SELECT id, (prev_total_rech_amt + prev_total_rech_data * prev_av_rech_amt_data + cur_total_rech_amt
       + cur_total_rech_data * cur_av_rech_amt_data) / 2 * {RATE} AS monthly_spend_lyd,
     (prev_total_rech_amt + cur_total_rech_amt) / nullif(prev_total_rech_num + cur_total_rech_num, 0) * {RATE} AS usual,
     cur_monthly_2g + cur_monthly_3g AS mp, cur_sachet_2g + cur_sachet_3g AS sp, cur_av_rech_amt_data * {RATE} AS ad, cur_total_rech_data * (cur_av_rech_amt_data * {RATE}) AS ds,
     cur_vol_2g_mb + cur_vol_3g_mb AS mb, (prev_total_rech_num + cur_total_rech_num) / 2 AS topups FROM w),
   ov AS (SELECT u.*, {CARD_SQL.format(x="usual")} AS usual_card_lyd,
     CASE WHEN mp > 0 THEN {PACK_SQL.format(f="= 'Monthly offers'", x="ds")} WHEN sp > 0 THEN {PACK_SQL.format(f="IN ('Daily offers', 'Weekly offers')", x="ad")} ELSE 'PAYG' END AS bundle_held FROM u)"""


@query(
    "operator_view",
    f"""WITH {VIEW_SQL} SELECT id, round(monthly_spend_lyd, 5) AS monthly_spend_lyd, usual_card_lyd, bundle_held, price_lyd AS bundle_price_lyd
        FROM ov LEFT JOIN {{v_offers}} ON offer_id = bundle_held""",
)
def operator_view(spark, sf):
    return rounded(M.operator_view(window(spark, sf), RATE, catalogue(spark, sf)), "monthly_spend_lyd", digits=5)


@query(
    "operator_spend_percentiles",
    f"""WITH {VIEW_SQL} SELECT round(quantile_cont(monthly_spend_lyd, 0.1), 4) AS p10, round(quantile_cont(monthly_spend_lyd, 0.25), 4) AS p25,
          round(quantile_cont(monthly_spend_lyd, 0.5), 4) AS p50, round(quantile_cont(monthly_spend_lyd, 0.75), 4) AS p75, round(quantile_cont(monthly_spend_lyd, 0.9), 4) AS p90 FROM ov""",
)
def operator_spend_percentiles(spark, sf):
    out = M.spend_percentiles(M.operator_view(window(spark, sf), RATE, catalogue(spark, sf)))
    return rounded(out, *out.columns, digits=4)


@query(
    "operator_card_shares",
    f"""WITH {VIEW_SQL} SELECT usual_card_lyd, count(*) AS customers, round_even(count(*) / (SELECT count(*) FROM ov), 4) AS share FROM ov GROUP BY 1""",
)
def operator_card_shares(spark, sf):
    return M.card_shares(M.operator_view(window(spark, sf), RATE, catalogue(spark, sf)))


@query(
    "operator_bundle_counts",
    f"""WITH {VIEW_SQL} SELECT bundle_held, count(*) AS customers, max(price_lyd) AS price_lyd, round_even(count(*) / (SELECT count(*) FROM ov), 4) AS share
        FROM ov LEFT JOIN {{v_offers}} ON offer_id = bundle_held GROUP BY 1""",
)
def operator_bundle_counts(spark, sf):
    return M.bundle_counts(M.operator_view(window(spark, sf), RATE, catalogue(spark, sf)))


@query(
    "operator_unconverted_behaviour",
    f"""WITH {VIEW_SQL}, d AS (SELECT max(price_lyd) AS dearest FROM {{v_offers}})
        SELECT count(*) AS customers, round(avg(CAST(mb <= 0 AS INT)), 6) AS no_data_share, round(avg(CAST(usual < 5 AS INT)) FILTER (usual IS NOT NULL), 6) AS below_smallest_card_share,
          count(*) FILTER (monthly_spend_lyd > dearest) AS above_dearest_package, round(coalesce(sum(monthly_spend_lyd) FILTER (monthly_spend_lyd > dearest), 0) / sum(monthly_spend_lyd), 6) AS above_dearest_spend_share,
          round(max(monthly_spend_lyd), 4) AS highest_spend_lyd, max(dearest) AS dearest_package_lyd, round(median(mb / 1024) FILTER (mb > 0), 6) AS median_data_gb, median(topups) AS median_topups_per_month FROM ov, d""",
)
def operator_unconverted_behaviour(spark, sf):
    out = M.unconverted_behaviour(window(spark, sf), RATE, catalogue(spark, sf))
    out = rounded(out, "no_data_share", "below_smallest_card_share", "above_dearest_spend_share", "median_data_gb")
    return rounded(out, "highest_spend_lyd", digits=4)


ADVICE_SQL = f"""{WINDOW_SQL}, t AS (SELECT id, CASE WHEN prev_total_rech_num > 0 THEN prev_total_rech_amt / prev_total_rech_num * {RATE} END AS tp,
      CASE WHEN cur_total_rech_num > 0 THEN cur_total_rech_amt / cur_total_rech_num * {RATE} END AS tc FROM w),
    a0 AS (SELECT *, (coalesce(tp, tc) + coalesce(tc, tp)) / 2 AS tt FROM t),
    a1 AS (SELECT *, CASE WHEN tt = 0 THEN 0.0 ELSE {CARD_SQL.format(x="tt")} END AS card FROM a0),
    a2 AS (SELECT *, coalesce(card * 0.6, 0.0) AS ceil FROM a1),
    adv AS (SELECT *, CASE WHEN ceil >= 5 THEN 5.0 WHEN ceil >= 3 THEN 3.0 WHEN ceil >= 1 THEN 1.0 ELSE 0.0 END AS lim FROM a2)"""


@query(
    "emergency_credit_advice",
    f"""WITH {ADVICE_SQL} SELECT id, round(tt, 5) AS typical_topup_lyd, card AS typical_card_lyd, round(ceil, 5) AS affordability_ceiling_lyd, lim AS airtime_limit_lyd,
          CASE WHEN lim > 0 THEN card - lim END AS airtime_residual_lyd, ceil >= 5 AS data_advance_advised,
          CASE WHEN lim > 0 AND ceil >= 5 THEN 'both' WHEN lim > 0 THEN 'airtime_only' WHEN tt IS NULL THEN 'no_recharge' WHEN tt = 0 THEN 'no_paid_topup' ELSE 'below_smallest' END AS advice_code FROM adv""",
)
def emergency_credit_advice(spark, sf):
    out = M.credit_advice(window(spark, sf), RATE).drop(
        "topup_prev_lyd", "topup_cur_lyd", "advice_reason_en", "advice_reason_ar"
    )
    return rounded(out, "typical_topup_lyd", "affordability_ceiling_lyd", digits=5)


@query(
    "emergency_credit_shares",
    f"WITH {ADVICE_SQL} SELECT lim AS airtime_limit_lyd, count(*) AS customers, round_even(count(*) / (SELECT count(*) FROM adv), 4) AS share FROM adv GROUP BY 1",
)
def emergency_credit_shares(spark, sf):
    return M.advice_shares(M.credit_advice(window(spark, sf), RATE))


@query(
    "emergency_credit_basis_sensitivity",
    f"""WITH {ADVICE_SQL}, l AS (SELECT 'quieter month' AS basis, least(tp, tc) AS x FROM adv UNION ALL SELECT 'mean of both months', tt FROM adv
          UNION ALL SELECT 'busier month', greatest(tp, tc) FROM adv), k AS (SELECT *, CASE WHEN x = 0 THEN 0.0 ELSE {CARD_SQL.format(x="x")} END AS c FROM l)
        SELECT basis, round_even(median(x), 2) AS median_topup_lyd, round_even(avg(CAST(coalesce(c = 5, false) AS INT)), 4) AS smallest_card,
          round_even(avg(CAST(coalesce(c * 0.6, 0) < 1 AS INT)), 4) AS declined, round_even(avg(CAST(coalesce(c * 0.6, 0) >= 5 AS INT)), 4) AS data_advance_advised FROM k GROUP BY basis""",
)
def emergency_credit_basis_sensitivity(spark, sf):
    return M.basis_sensitivity(M.credit_advice(window(spark, sf), RATE))
