import corpus_pipeline
from sievelake.llm import decontam, jaccard_join, quality_rules
from sievelake.llm.common import DOCUMENT_COLUMNS, kept, table

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, FOLDER), name)
        seen[name] = docs
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    for name in list(seen)[:-1]:
        assert seen[name].columns == list(DOCUMENT_COLUMNS)
    start = table(spark, FOLDER, "documents")
    assert ids["quality_rules"] == {r.doc_id for r in quality_rules.judge(start).where("kept").collect()}
    classes = jaccard_join.near_duplicates(seen["quality_rules"]).collect()
    assert ids["jaccard_join"] == {r.component_id for r in classes}
    found = decontam.decontaminate(seen["jaccard_join"], table(spark, FOLDER, "benchmark")).collect()
    assert ids["benchmark_decontamination"] == {r.doc_id for r in found if not r.contaminated}
    assert ids["secret_scan"] == ids["benchmark_decontamination"] == ids["best_fit_packing"]
    assert seen["secret_scan"].where("text rlike '(?i)(password|token) ?[=:] ?.?[a-z0-9]{8}'").count() == 0
    assert len(ids["secret_scan"]) > 50
