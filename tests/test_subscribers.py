import pytest
from pyspark.sql import functions as F

from mastwire.functions import text as X
from mastwire.operators import contracts as C
from mastwire.operators import evaluate as E
from mastwire.operators import subscribers as B
from mastwire.operators.grounding import ungrounded_numbers
from mastwire.plans.adapters import view

SF = "/root/testdata/sf0.001"


def test_month_names_round_trip():
    for column in B.contract_columns():
        base, month = B.split_month(column)
        assert B.month_column(base, month) == column
    assert B.split_month("aon") == ("aon", None)


def test_cleaning_twice_changes_nothing(spark):
    once = B.clean(view(spark, SF, "v_subscribers"))
    again = B.clean(once)
    assert once.columns == again.columns
    assert once.exceptAll(again).count() == 0 and again.exceptAll(once).count() == 0


def test_the_adapter_export_passes_its_table_rules(spark):
    export = view(spark, SF, "v_subscribers")
    assert B.table_rules(export) == []
    broken = export.withColumn("last_date_of_month_7", F.lit("2014-07-30"))
    assert B.table_rules(broken) == ["rows: one calendar month end and matching recharge dates in month 7"]


def test_failures_name_counts_and_examples(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, -1.0), (4, -7.0)], "id int, v double")
    rules = [("v", "not negative", F.col("v") >= 0, F.col("v")), ("id", "present", F.col("id").isNotNull(), F.col("id"))]
    rows = [tuple(r) for r in C.summarize(df, rules).collect()]
    assert rows == [("v", "not negative", 3, "-1.0, -7.0")]
    with pytest.raises(C.ContractError, match="not negative failed 3 times"):
        C.require(df, rules, "Bad")


def test_phones_numbers_and_parts(spark):
    texts = [
        "call 091-234 56 78 or +218 92 1234567", "account 912345678", "٠٩١٢٣٤٥٦٧٨ now", "1,234.50 and 05 and 5.0",
        "1. first\n2) second 7", "مرحبا " * 20, "x" * 161,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i", X.mask_phones(F.col("t")).alias("m"), X.has_phone(F.col("t")).alias("p"), X.numbers_in(F.col("t")).alias("n"),
        X.numbers_claimed(F.col("t")).alias("c"), F.struct(*[c.alias(n) for n, c in X.sms_parts(F.col("t")).items()]).alias("s"),
    ).orderBy("i").collect()
    assert [r["p"] for r in rows[:4]] == [True, False, True, False]
    assert rows[0]["m"] == "call [phone number removed] or [phone number removed]"
    assert rows[3]["n"] == ["1234.5", "5"]
    assert rows[4]["c"] == ["7"]
    assert rows[5]["s"]["encoding"] == "UCS-2" and rows[5]["s"]["parts"] == 2
    assert rows[6]["s"]["parts"] == 2 and rows[6]["s"]["remaining"] == 145


def test_numbers_need_an_earlier_source(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "I paid 20 LYD"), (1, 1, "assistant", "You paid 20.0, not 35"), (1, 2, "user", "it was 35")],
        "conv_id int, turn int, role string, text string",
    )
    assert [tuple(r) for r in ungrounded_numbers(turns).collect()] == [(1, 1, "35")]


def test_ranking_metrics_with_ties_and_one_class(spark):
    rows = [(i, s, y) for i, (s, y) in enumerate([(0.9, 1), (0.9, 0), (0.4, 1), (0.2, 0), (0.2, 0)])]
    df = spark.createDataFrame(rows, "id int, s double, y int")
    m = E.ranking_metrics(df, "s", "y").first()
    pairs = [(a, b) for _, a, ya in rows if ya for _, b, yb in rows if not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert abs(m["roc_auc"] - auc) < 1e-12
    assert abs(m["pr_auc"] - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert E.ranking_metrics(df.where("y = 0"), "s", "y").first()["roc_auc"] is None


def test_bootstrap_repeats_itself(spark):
    df = spark.createDataFrame([(i / 50, int(i % 3 == 0)) for i in range(50)], "s double, y int")
    a, b = [E.bootstrap(df.repartition(n), "s", "y", 20).orderBy("replicate").collect() for n in (1, 4)]
    assert [r["replicate"] for r in a] == [r["replicate"] for r in b]
    assert all(abs(x["roc_auc"] - y["roc_auc"]) < 1e-12 for x, y in zip(a, b))


def test_document_numbers_joins_thousands_as_its_sql_does(spark, tmp_path):
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    texts = ["555-4081 190.137.223.204", "1 234 567", "1 234 567 890", "12,345 6789 007.50", "68\u00a0900", "4 321\n", None, "no digits"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(oracle_sql()["document_numbers"]).fetchall())
    assert sorted(tuple(r) for r in queries()["document_numbers"](spark, str(tmp_path)).collect()) == want
    assert dict(want)[0] == "223.204 4081190.137 555"
