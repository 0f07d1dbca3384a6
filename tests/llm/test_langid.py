import zlib

import numpy as np
import pytest
from tideframe.llm import langid, queries
from tideframe.llm.common import read_table
from tideframe.llm.quality import keep_good


def sample(sf, per_lang):
    import pandas as pd

    docs = pd.read_parquet(f"/root/testdata/{sf}/documents.parquet").dropna(subset=["lang", "text"])
    docs = docs[docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) != 2].groupby("lang").head(per_lang)
    langs = sorted(docs.lang.unique())
    x = np.stack([langid.counts(t).astype(np.float32) for t in docs.text])
    return langs, np.array([langs.index(v) for v in docs.lang]), x / x.sum(1, keepdims=True)


@pytest.mark.parametrize("sf,per_lang", [("sf0.001", 320), ("sf0.01", 60), ("sf0.1", 60)])
def test_descent_is_finite_for_all_seeds(sf, per_lang):
    langs, label, x = sample(sf, per_lang)
    for seed in range(20):
        weights, bias = langid.descend(x, label, len(langs), 8, 2.0, seed)
        assert np.isfinite(weights).all() and np.isfinite(bias).all()
        assert (((x @ weights + bias)[:, :-1]).argmax(1) == label).mean() >= 0.95


def test_a_rate_that_diverges_is_halved():
    langs, label, x = sample("sf0.001", 40)
    weights, _ = langid.descend(x, label, len(langs), 4, 200.0, 1)
    assert np.isfinite(weights).all()


def test_unseen_languages_are_rejected():
    langs, label, x = sample("sf0.1", 120)
    for unseen in range(len(langs)):
        seen = label != unseen
        names = np.cumsum(np.arange(len(langs)) != unseen) - 1
        model = langid.train([v for k, v in enumerate(langs) if k != unseen], names[label[seen]], x[seen])
        z = langid.softmax((x @ model.weights + model.bias) / model.temperature)[:, :-1].max(1) >= model.threshold
        assert z[~seen].mean() <= 0.1 and z[seen].mean() >= 0.95
        assert model.accuracy >= 0.95 and model.calibration_error < 0.2


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_query_on_held_out_rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = queries.op9_langid(spark, folder).toPandas()
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "text").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(both) == len(got) == len(docs)
    assert both.score.between(0, 1).all()
    held = both[both.held_out & both.lang.notna()]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (held.lang == held.lang_pred).mean() >= 0.95
    assert held[held.text.str.len() > 400].accepted.mean() >= 0.98


def test_labels_of_every_frequency(spark):
    alphabet = ["kalo mirat", "zune opfer", "wibb xoll", "gree tynk"]
    rows = [(i, f"{alphabet[k]} {alphabet[k]} {i} {alphabet[k][:4]}", f"l{k}") for k in range(4) for i in range(k * 100, k * 100 + (40 if k else 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_langid(docs)
    assert model.langs == ["l0", "l1", "l2", "l3"]
    assert langid.predict(model, alphabet)[0] == model.langs
    few = langid.fit_langid(docs, rows=16)
    assert few.langs == model.langs and np.isfinite(few.weights).all()
    one = langid.fit_langid(docs.where("lang = 'l2'"))
    assert one.langs == ["l2"] and langid.predict(one, ["wibb xoll", None or ""])[0] == ["l2", "und"]


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 3)
    docs = spark.createDataFrame([(i, "ab cd", f"l{i % 9}") for i in range(90)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit_langid(docs)


def test_filters_with_clashing_names_and_without_labels(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, text, "en", "a", "b"), (2, None, None, None, None)], "doc_id long, text string, lang string, x string, y string")
    docs = docs.toDF("doc_id", "text", "lang", "x", "x")
    good = keep_good(docs)
    assert [tuple(r) for r in good.collect()] == [(1, text, "en", "a", "b")] and good.columns == docs.columns
    known = langid.keep_known_language(docs, langid.fit_langid(docs))
    assert known.columns == docs.columns and [r[0] for r in known.collect()] in ([1], [])
    assert langid.keep_known_language(docs, None).count() == 2
    empty = docs.where("doc_id > 5")
    assert langid.fit_langid(empty) is None and keep_good(empty).count() == 0
