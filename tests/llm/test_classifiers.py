import pytest
from pyspark.sql import functions as F

from nearloom.llm import langid, quality, toxicity
from nearloom.llm.common import fold, table
from nearloom.llm.labelled import labelled_sample
from nearloom.llm.queries import REGISTRY

SF = "/root/testdata/sf0.01"
# Enough labelled rows of each kind.
LABELLED = "/root/testdata/sf0.1"


def test_fold_is_crc32(spark):
    import zlib

    df = spark.range(200).union(spark.createDataFrame([(None,)], "id bigint"))
    for r in df.select("id", fold(F.col("id"), 7).alias("f")).collect():
        assert r.f == zlib.crc32(b"" if r.id is None else str(r.id).encode()) % 7


def test_language_accuracy(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    got = REGISTRY["op6_language_id"](spark, SF).filter("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(0.5 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) < 0.02 * len(got)


def test_language_of_odd_rows(spark, doc_frame, odd_rows):
    docs = doc_frame(odd_rows)
    dictionaries = langid.fit(docs, F.lit(True))
    assert sorted(dictionaries) == ["de", "en", "fr"]
    got = {r.doc_id: r for r in langid.identify(docs, dictionaries).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[1].rejected
    assert got[4].lang_pred == "en" and got[8].lang_pred in dictionaries
    assert langid.identify(docs, {}).filter("lang_pred = 'und'").count() == len(odd_rows)
    assert langid.fit(doc_frame([]), F.lit(True)) == {}
    assert langid.identify(doc_frame([]), dictionaries).count() == 0
    one = langid.identify(docs, {"en": b"one two three"})
    assert one.filter("doc_id = 5 and lang_pred = 'en' and not rejected").count() == 2


def auc(pairs):
    positive = [s for s, y in pairs if y == 1]
    negative = [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in positive for n in negative) / (len(positive) * len(negative))


@pytest.mark.parametrize("name,label,least", [("op7_toxicity", "toxic", 0.97), ("op8_quality", "quality", 0.97)])
def test_held_out_labels(spark, name, label, least):
    labels = table(spark, LABELLED, "labels")
    got = REGISTRY[name](spark, LABELLED).filter("held_out").join(labels, "doc_id").collect()
    assert auc([(r.score, r[label]) for r in got]) > least
    assert sum(r.predicted == r[label] for r in got) / len(got) > 0.93


def test_interaction_is_learned():
    """Two harmless terms that are toxic together only, which no sum of weights can tell."""
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = rng.random(3000) < 0.5, rng.random(3000) < 0.5
    y = (a & b).astype(float) + (~a & ~b)
    pairs = [(i, j) for i in range(3000) for j, has in enumerate((a[i], b[i])) if has]
    rows, columns = (np.array(v) for v in zip(*pairs))
    model = toxicity.train(np.arange(2), rows, columns, y, epochs=150)
    z = model.logits(rows, columns, 3000)
    assert ((z > 0) == (y == 1)).mean() > 0.95


def test_pairs_are_learned():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, pairs=1)
    assert model.pairs == [(0, 1)]
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_rows(spark, doc_frame, odd_rows, module):
    docs = doc_frame(odd_rows)
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (9, 0), (None, 1), (7, None), (77, 1)], "doc_id bigint, toxic int")
    sample = labelled_sample(docs, labels, "doc_id", "text", "toxic", 1, 1, 10)
    assert sorted((r.doc_id, r.label) for r in sample.collect()) == [(4, 1), (5, 1), (5, 1), (9, 0)]
    for s in (sample, sample.limit(0)):
        model = module.fit(s)
        got = module.score(docs, model)
        assert got.count() == len(odd_rows) and got.filter("score is null or score < 0 or score > 1").count() == 0
        assert module.score(doc_frame([]), model).count() == 0


def test_sample_is_bounded(spark, doc_frame):
    docs = doc_frame([(i, f"w{i}") for i in range(100)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id bigint, toxic int")
    kept = [r.doc_id for r in labelled_sample(docs, labels, "doc_id", "text", "toxic", 5, 0, 20).collect()]
    import zlib

    assert len(kept) == 20 and all(zlib.crc32(str(i).encode()) % 5 for i in kept)
