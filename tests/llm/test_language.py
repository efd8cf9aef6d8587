import numpy as np
import pyarrow as pa

from mastwire.llm import language
from mastwire.llm.store import table

SMALL = "/root/testdata/sf0.01"


def test_scores_are_the_kernel_regression():
    texts = [f"{w} {w[::-1]} {w * 2}" for w in ("maison chat", "the house cat", "das haus", "la casa", "chien maison", "this cat")]
    langs = ["fr", "en", "de", "es", "fr", "en"]
    presence = language.Presence()
    found = [set(x.tolist()) for part in language.texts(pa.array(texts)) for x in presence.each(part)]
    bits = []
    for f in found:
        row = np.zeros(language.WIDTH, dtype=bool)
        row[list(f)] = True
        bits.append(np.packbits(row).tobytes())
    model = language.train(bits, langs, landmarks=50, ridge=0.1)
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in found] for a in found])
    target = np.where(np.array(langs)[:, None] == np.array(model.languages)[None, :], 1.0, -1.0)
    plain = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(6), target)
    assert np.allclose(model.scores(pa.array(texts)), plain, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = table(spark, SMALL, "documents")
    got = language.predicted(docs)
    assert got.count() == docs.count()
    both = got.where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(both) > 200 and (both.lang_pred == both.lang).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_odd_rows(spark):
    rows = [(1, "the house", "en"), (2, None, "en"), (None, "123 ...", None), (4, "", "fr"), (5, "la maison", "fr"), (5, "la maison", "fr")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = language.predicted(docs).collect()
    assert len(got) == 6 and sorted(r.doc_id or 0 for r in got if r.lang_pred == "und") == [0, 2, 4]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in language.predicted(docs.withColumn("lang", docs.lang.substr(9, 1)).where("doc_id < 0")).collect()} == set()
    none = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in language.predicted(none).collect()} == {"und"}
