import numpy as np
import pyarrow as pa

from mastwire.llm import quality
from mastwire.llm.store import table

SMALL = "/root/testdata/sf0.01"


def test_measures_against_plain_python():
    texts = ["a b b C!", None, "", "x | y\nx | y\n", "été 12"]
    got = quality.measures(pa.array(texts))
    for t, row in zip(texts, got, strict=True):
        m = dict(zip(quality.MEASURES, row, strict=True))
        w, size = (t or "").lower().split(), max(len((t or "").encode()), 1)
        assert np.isclose(m["log_words"], np.log1p(len(w)))
        assert np.isclose(m["distinct"], len(set(w)) / max(len(w), 1))
        assert np.isclose(m["repeated"], sum(a == b for a, b in zip(w, w[1:])) / max(len(w), 1))
        assert np.isclose(m["bar"], (t or "").count("|") / size)
        assert np.isclose(m["mean_word"], sum(len(x.encode()) for x in w) / max(len(w), 1))


def test_interaction_is_learnt():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (1, 0) in model.pairs and ((model.score(x) > 0.5) == (y > 0)).mean() > 0.9


def test_held_out_rows_are_judged_well(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    got = quality.scored(docs, labels)
    assert got.count() == docs.count() and got.columns == ["doc_id", "held_out", "score", "predicted"]
    both = got.where("held_out").join(labels, "doc_id").toPandas()
    assert len(both) > 40 and (both.predicted == both.quality).mean() > 0.97
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("predicted = 1").count()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "u"), (None, "", "u"), (2, "good words here", "u"), (2, "good words here", "u")],
                                 "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.keep(docs, labels.limit(0)).columns == docs.columns
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_sample_is_bounded_and_in_order(spark):
    rows = spark.range(30_000).selectExpr("id % 5000 AS doc_id", "id % 2 AS quality").distinct()
    got = [(r.doc_id, r.quality) for r in quality._sampled(rows, 400, "quality").collect()]
    assert 300 < len(got) <= 400 and len(set(got)) == len(got)
    whole = [(r.doc_id, r.quality) for r in quality._sampled(rows, 50_000, "quality").collect()]
    assert len(whole) == rows.count() and set(got) < set(whole)


def test_repeated_ids_do_not_swell_the_fit(spark):
    docs = spark.createDataFrame([(2, f"text {i}") for i in range(300)] + [(i, f"words {i}") for i in range(3, 40)], "doc_id long, text string")
    known = spark.createDataFrame([(i, float(i % 2)) for i in range(2, 40)] * 2, "doc_id long, quality double")
    assert len(quality._training_rows(docs, known, 20)) <= 20
