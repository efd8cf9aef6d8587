import random

from pyspark.sql import functions as F

from mastwire.functions.ladders import dearest_affordable, interval_number, largest_within, nearest
from mastwire.operators import campaign as G
from mastwire.operators import market as M
from mastwire.operators import retention as R
from mastwire.operators.market import CARDS


def sequential(rows, budget):
    taken, left = set(), budget
    for key, _, cost in sorted(rows, key=lambda r: (-r[1], r[0])):
        if cost <= left:
            taken.add(key)
            left -= cost
    return taken


def test_budget_selection_equals_the_sequential_loop(spark):
    rng = random.Random(1)
    for budget in (0, 699, 2_500, 40_000):
        rows = [(f"s{i:03d}", round(rng.random(), 2), rng.choice([350, 700, 1250, 90])) for i in range(200)]
        df = spark.createDataFrame(rows, "id string, net double, cost bigint")
        out = R.within_budget(df, "id", "net", "cost", budget).where("selected").collect()
        assert {r["id"] for r in out} == sequential(rows, budget)


def test_money_is_exact_in_dirhams(spark):
    df = spark.createDataFrame([(0.3499,), (0.35,), (0.7,), (1.005,)], "p double")
    row = df.select(R.money_dirhams(F.col("p")).alias("f"), R.money_dirhams(F.col("p"), 0.35, True).alias("c")).collect()
    assert [(r["f"], r["c"]) for r in row] == [(349, 123), (350, 123), (700, 245), (1005, 352)]


def test_ladders(spark):
    df = spark.createDataFrame([(0.0,), (7.5,), (8.0,), (500.0,), (None,)], "x double")
    packs = [(3.0, "b"), (3.0, "a"), (10.0, "c")]
    out = df.select(
        nearest(F.col("x"), CARDS).alias("card"), largest_within(F.col("x"), [1, 3, 5]).alias("step"),
        dearest_affordable(F.col("x"), packs).alias("pack"), interval_number(F.col("x"), [1.0, 7.5]).alias("n"),
    ).collect()
    assert [r["card"] for r in out] == [5.0, 5.0, 10.0, 100.0, None]
    assert [r["step"] for r in out] == [0.0, 5.0, 5.0, 5.0, 0.0]
    assert [r["pack"] for r in out][:4] == ["a", "b", "b", "c"]
    assert [r["n"] for r in out] == [1, 2, 3, 3, None]


def test_lottery_does_not_depend_on_row_order(spark):
    import hashlib

    ids = [f"000{i}" for i in range(50)] + ["NA"]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(3)
    policy = R.Policy("a", "b", holdout_fraction=0.3)
    got = {r["id"]: r["h"] for r in df.select("id", R.in_holdout(F.col("id"), policy).alias("h")).collect()}
    for i in ids:
        first = int.from_bytes(hashlib.sha256(f"42:{i}".encode()).digest()[:8], "big")
        assert got[i] == (first / 2**64 < 0.3)


def test_fingerprint_ignores_order_and_notices_changes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, v int")
    first = G.fingerprint(df, ["k", "v"]).first()["fingerprint"]
    assert first == G.fingerprint(df.orderBy(F.col("k").desc()), ["k", "v"]).first()["fingerprint"]
    assert first != G.fingerprint(df.fillna(0), ["k", "v"]).first()["fingerprint"]
    swapped = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "k string, v int")
    assert first != G.fingerprint(swapped, ["k", "v"]).first()["fingerprint"]
    texts = spark.createDataFrame([("a", "-"), ("a", None), ("a1", ""), ("", "1a")], "k string, v string")
    assert len({G.fingerprint(texts.where(F.col("k") == k), ["v"]).first()["fingerprint"] for k in ("a", "a1", "")}) == 3
    assert G.fingerprint(texts, ["k"], "one").first()["fingerprint"] != G.fingerprint(texts, ["k"], "two").first()["fingerprint"]


def test_reviews_are_checked(spark):
    rows = spark.createDataFrame([("a", "proposed"), ("b", "no_offer"), ("c", "proposed")], "subscriber_id string, status string")
    events = spark.createDataFrame(
        [("a", "approved", "x", "c1"), ("b", "approved", "x", "c1"), ("c", "approved", " ", "c1"), ("d", "maybe", "x", "c2")],
        "subscriber_id string, decision string, reviewer string, campaign_id string",
    )
    found = {r["subscriber_id"]: r["problem"] for r in G.review_problems(events, rows, "c1").collect()}
    assert found == {"b": "not a pending proposal", "c": "no reviewer", "d": "another campaign"}


def test_best_offer_of_a_large_catalogue_equals_the_plain_search(spark):
    rng = random.Random(7)
    maybe = lambda x: x if rng.random() < 0.5 else None
    rows = [("base", 40.0, 720, 10.0, 0, None, 0, None, None, None), ("pref", 12.0, 720, None, 1, None, 0, None, None, 1)]
    rows += [(f"o{i:05d}", round(rng.uniform(2, 60), 2), rng.choice([24, 168, 720, 1440]), maybe(rng.choice([1.0, 5.0])), rng.choice([0, 0, 1]),
              maybe(60.0), rng.choice([0, 0, 1]), rng.choice([None, None, "x"]), rng.choice([None, 1, 4]), None) for i in range(12_000)]
    schema = ("offer_id string, price_lyd double, validity_hours int, data_gb double, data_unlimited int, voice_minutes double, "
              "voice_unlimited int, network string, members int, valid_from_hour int")
    policy = R.Policy("base", "pref")
    offers = spark.createDataFrame(rows, schema)
    people = [(f"s{i}", rng.choice([None, 0.1, 0.6, 0.9]), rng.choice([None, 20.0, 300.0, 4000.0]), rng.choice(["PAYG", "base", "o00007", "o00011"]),
               rng.random() < 0.7, rng.random() < 0.5) for i in range(60)]
    frame = spark.createDataFrame(people, "id string, churn_probability double, value_12m_base_lyd double, bundle_held string, uses_data boolean, uses_voice boolean")
    got = {r.id: (r.best_offer_id, r.best_cost_dirhams) for r in R.best_offers(frame, offers, policy).collect()}
    catalogue = [r.asDict() for r in R.delivery_costs(offers, policy).collect()]
    by_id = {r["offer_id"]: r for r in catalogue}
    for who, p, value, held, data, voice in people:
        best = None
        h = by_id.get(held)
        exposed = h is not None and h["validity_hours"] >= 720 and h["price_lyd"] > 40.0
        for r in catalogue:
            gives = (data and (r["data_unlimited"] == 1 or r["data_gb"] is not None)) or (voice and (r["voice_unlimited"] == 1 or r["voice_minutes"] is not None))
            if p is None or value is None or not gives or r["network"] or (r["members"] or 0) > 1 or r["cost_dirhams"] > int(value * 150 + 1e-9):
                continue
            if r["is_unlimited"] and r["price_lyd"] < 40.0 and exposed:
                continue
            rank = (p * 0.05 * value - r["cost_dirhams"] / 1000, r["offer_id"] == "pref", [-ord(c) for c in r["offer_id"]])
            best = max(best, (rank, r), key=lambda x: x[0]) if best else (rank, r)
        assert got[who] == ((best[1]["offer_id"], best[1]["cost_dirhams"]) if best else ("NO_OFFER", 0))


def test_bundles_of_a_large_catalogue_equal_the_plain_search(spark):
    rng = random.Random(3)
    families = ["Monthly offers", "Daily offers", "Weekly offers", "Roaming"]
    rows = [(f"o{i:05d}", rng.choice(families), rng.choice([None, round(rng.uniform(2, 60), 2), round(rng.lognormvariate(1, 2), 2)])) for i in range(12_000)]
    offers = spark.createDataFrame(rows, "offer_id string, family_en string, price_lyd double")
    people = [(i, rng.choice([0.0, 1.0]), rng.choice([0.0, 1.0]), rng.choice([None, 0.0, 1.0, rng.uniform(0, 9), rng.lognormvariate(3, 3)]), rng.choice([1.0, 3.0]))
              for i in range(400)]
    frame = spark.createDataFrame(people, "id int, cur_monthly_2g double, cur_sachet_3g double, cur_av_rech_amt_data double, cur_total_rech_data double")
    frame = frame.withColumns({"cur_monthly_3g": F.lit(0.0), "cur_sachet_2g": F.lit(0.0)})
    got = {r.id: (r.bundle_held, r.bundle_price_lyd) for r in M.with_bundle(frame, 2.0, offers).collect()}
    assert len(got) == 400
    for who, monthly, short, average, count in people:
        if not monthly and not short:
            assert got[who] == ("PAYG", None)
            continue
        steps = sorted((p, o) for o, f, p in rows if p is not None and f in (families[:1] if monthly else families[1:3]))
        amount = None if average is None else average * 2.0 * (count if monthly else 1)
        payable = [s for s in steps if amount is not None and s[0] <= amount]
        price, offer = payable[-1] if payable else steps[0]
        assert got[who] == (offer, price)


def test_bundles_without_an_offer_of_their_kind(spark):
    frame = spark.createDataFrame([(1, 1.0, 0.0, 5.0, 1.0), (2, 0.0, 1.0, 5.0, 1.0), (3, 0.0, 0.0, 5.0, 1.0)],
                                  "id int, cur_monthly_2g double, cur_sachet_3g double, cur_av_rech_amt_data double, cur_total_rech_data double")
    frame = frame.withColumns({"cur_monthly_3g": F.lit(0.0), "cur_sachet_2g": F.lit(0.0)})
    offers = spark.createDataFrame([("a", "Daily offers", 9.0)], "offer_id string, family_en string, price_lyd double")
    held = lambda o: {r.id: r.bundle_held for r in M.with_bundle(frame, 1.0, o).collect()}
    assert held(offers) == {1: None, 2: "a", 3: "PAYG"}
    assert held(offers.limit(0)) == {1: None, 2: None, 3: "PAYG"}
