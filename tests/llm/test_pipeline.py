"""The pipeline's stages on a small table."""

import pytest

from crosspanel.llm.common import stage, table

SF = "/root/testdata/sf0.01"


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, left = docs.columns, [docs.count()]
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = stage(step(spark, docs, SF), "test")
        if at + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns, name
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            left.append(out.count())
            docs = out
    assert left == sorted(left, reverse=True) and left[1] < left[0] and left[3] < left[2]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    labels = table(spark, SF, "labels")
    good = table(spark, SF, "documents").join(labels.where("quality = 1"), "doc_id")
    kept = corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF).join(labels.where("quality = 1"), "doc_id")
    assert kept.count() >= 0.97 * good.count()


@pytest.mark.parametrize("at", range(4))
def test_stages_take_an_empty_table(spark, at):
    import corpus_pipeline

    docs = table(spark, SF, "documents").limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, docs, SF).count() == 0
