"""The pipeline's stages on odd rows, and the classifier by plain loops."""

import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from crosspanel.llm import compression_quality
from crosspanel.llm.common import stage, table
from crosspanel.llm.registry import packing_vocabulary

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "set", "rank", "part", "probability", "n_tokens", "weight", "row", "text_key", "document", "place", "t1", "component", "source_id")


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Documents, and rows with nulls, without text, very long, repeated, of one id with several texts, and with columns of the stages' own names."""
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    good = docs.where("length(text) > 400").orderBy("doc_id").first()
    rows = [
        (90001, None, "en", "s1", 0), (90002, "", None, "s1", 0), (90003, " \n\t ", "en", None, 4), (None, good.text, None, None, None), (None, None, None, None, None),
        (90004, "word " * 60_000, "en", "s2", 300_000), (90005, good.text, good.lang, good.source, 1), (90005, good.text, good.lang, good.source, 1), (90005, "another text of the same id", "en", "s1", 9),
        (90006, "x" * 20_000, "en", "s1", 1), (90007, "日本語 \U0001f600 \x00", "ja", "s3", 9), (90008, good.text, "xx", "s9", 2),
    ]
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    return stage(both.withColumns({c: F.lit(7) for c in CLASHING}), "odd-documents")


def counted(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_whole_rows_of_odd_tables(spark, odd_documents, at):
    import corpus_pipeline

    name, step = corpus_pipeline.STAGES[at]
    out = step(spark, odd_documents, SF)
    assert out.columns == odd_documents.columns, name
    found, given = counted(out), counted(odd_documents)
    assert not found - given and 0 < sum(found.values()) <= sum(given.values())
    assert counted(step(spark, odd_documents.repartition(3), SF)) == found  # decisions do not depend on where rows lie


def test_near_duplicate_stage_decides_by_text(spark, odd_documents):
    import corpus_pipeline

    kept = corpus_pipeline.near_duplicates(spark, odd_documents, SF)
    rows = kept.where("doc_id >= 90000 OR doc_id IS NULL").collect()
    texts = Counter(r.text for r in rows)
    assert texts["another text of the same id"] == 1 and texts["word " * 60_000] == 1 and texts["x" * 20_000] == 1
    good = odd_documents.where("doc_id = 90008").first().text
    assert kept.where(F.col("text") == good).count() <= 1  # copies under several ids and without one
    blanks = kept.where("text IS NULL OR trim(text) = '' OR text = ' \\n\\t '").collect()
    assert len(blanks) == 1 and blanks[0].doc_id == 90001  # texts without words are one class


def test_packing_stage_takes_odd_rows(spark, odd_documents):
    import corpus_pipeline

    out = corpus_pipeline.pack(spark, odd_documents, SF)
    got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum((F.col("piece") == 0).cast("int")).alias("docs")).collect()
    assert sum(r.docs for r in got) == odd_documents.count() and {r.doc_id: r.n for r in got}[90001] == 1
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.collect_list(F.struct("offset", "length")).alias("at")).collect()
    assert all(r.n <= 2048 and sorted(r.at)[0].offset == 0 for r in bins)
    assert all(a.offset + a.length == b.offset for r in bins for a, b in zip(sorted(r.at), sorted(r.at)[1:], strict=False))
    assert packing_vocabulary().keys() == {"ranks_path", "pattern", "special"}


def plain_score(model, text):
    """The score of a text, with loops only."""
    data = (text or "").encode()
    blocks = [data[i : i + model.settings.block] for i in range(0, max(len(data), 1), model.settings.block)]
    sizes = []
    for dictionary in (model.good, model.bad):
        own = zstandard.ZstdCompressor(level=model.settings.level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append([len(own.compress(b)) for b in blocks])
    good, bad, n = sum(sizes[0]), sum(sizes[1]), sum(len(b) + 1 for b in blocks)
    worse = [(b - g) / (b + g) for g, b in zip(*sizes, strict=True)]
    side = sum(len(b) + 1 for b, w in zip(blocks, worse, strict=True) if w < 0)
    x = [(bad - good) / (bad + good), min(worse), side / n, min(good / n, 2.0), min(bad / n, 2.0)]
    z = [min(6.0, max(-6.0, (v - c) / s)) for v, c, s in zip(x, model.centre, model.spread, strict=True)]
    terms = [1.0, *z, *(z[i] * z[j] for i in range(5) for j in range(i, 5))]
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, sum(t * w for t, w in zip(terms, model.weights, strict=True)) + model.shift))))


def test_scores_equal_plain_loops(spark, odd_documents):
    model = compression_quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    rows = odd_documents.select("doc_id", "text").collect()
    want = Counter((r.doc_id, round(plain_score(model, r.text), 9)) for r in rows)
    got = compression_quality.classify(odd_documents, model).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(r.predicted == (r.score >= 0.7) for r in got)
    # a score of exactly the threshold counts as good
    tied = compression_quality.Model(model.settings, constant=0.7)
    assert {(r.score, r.predicted) for r in compression_quality.classify(odd_documents, tied).collect()} == {(0.7, 1)}


def test_calibration_is_a_minimum():
    """The weights that Newton's steps end at: the gradient of the penalised loss, by finite differences, is zero there."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 5)), (rng.random(300) < 0.4).astype(float)
    model = compression_quality.Model(compression_quality.Settings())
    model.calibrate(x, y, np.arange(300) % 2 == 0)
    terms = compression_quality._terms(np.clip((x - model.centre) / model.spread, -6, 6))

    def loss(w):
        s = terms @ w
        return float(np.sum(np.log1p(np.exp(-np.abs(s))) + np.maximum(s, 0) - y * s) + 0.005 * w @ w)

    for i in range(len(model.weights)):
        step = np.zeros(len(model.weights))
        step[i] = 1e-5
        assert abs(loss(model.weights + step) - loss(model.weights - step)) / 2e-5 < 1e-3
