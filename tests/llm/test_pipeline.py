import corpus_pipeline
from mastwire.llm import jaccard, pii, quality, templates
from mastwire.llm.store import saved, table

SMALL = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = table(spark, SMALL, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = saved(stage(spark, kept, SMALL))
        assert out.dtypes == docs.dtypes, name
        ids, before = ({r.doc_id for r in x.select("doc_id").collect()} for x in (out, kept))
        if name == "quality":
            scores = quality.scored(kept, table(spark, SMALL, "labels"))
            assert ids == {r.doc_id for r in scores.where("predicted = 1").collect()}
        if name == "near duplicates":
            assert ids == {r.component_id for r in jaccard.clusters(kept, 5, 80).collect()}
        if name == "decontamination":
            assert ids == before - {r.doc_id for r in templates.leaks(kept, table(spark, SMALL, "benchmark")).collect()}
        if name == "personal data":
            assert ids == before
            found = pii.find(out).agg({"n_email": "sum", "n_ip": "sum", "n_card": "sum", "n_phone": "sum"}).first()
            assert not any(found)
        kept = out
    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == ids
    assert packed.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_documents(spark):
    empty = table(spark, SMALL, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, SMALL)
        assert empty_out.count() == 0
