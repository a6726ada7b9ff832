"""Language identification and toxicity."""

import os

import edges
import pytest
from pyspark.sql import functions as F

from tagmill.llm import langid, toxicity

SF = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@given
def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.learn(docs.where(~held))
    got = langid.identify(docs.where(held), model).collect()
    long = [r for r in got if len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in long) >= 0.98 * len(long)
    assert all(0 <= r.score <= 1 and r.lang_pred in model.languages for r in got)


def test_language_of_odd_rows(spark):
    docs = edges.table(spark)
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert len(got) == len({r[0] for r in edges.rows()})
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0 and got[10].lang_pred != "und"
    unlearned = langid.identify(docs, langid.learn(edges.none(spark))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in unlearned} == {("und", 0.0, True)}
    assert langid.identify(edges.none(spark), langid.learn(docs)).count() == 0


def test_predictions_do_not_depend_on_neighbours(spark):
    settings = langid.Settings()
    rows = [(lang, *langid.counted(text, settings)) for lang, text in (("a", "aaa bbb ab ba"), ("b", "xyz zyx xxz"))] * 5
    model = langid.fitted(rows, settings)
    texts = ["ab aab", "zz xyx!", "é", "b" * 3000]
    together = langid.predicted(texts, model, settings)
    assert [langid.predicted([t], model, settings)[0] for t in texts] == together
    assert [r[0] for r in together[:2]] == ["a", "b"]


def test_numbers_are_no_letters():
    settings = langid.Settings()
    model = langid.fitted([(lang, *langid.counted(text, settings)) for lang, text in (("a", "aaa bbb"), ("b", "xyz zyx"))] * 5, settings)
    found = langid.predicted(["² ½ 12", "① Ⅷ 3_4", "", None, "² ª", "½ é"], model, settings)
    assert [r[0] for r in found[:4]] == ["und"] * 4 and "und" not in [r[0] for r in found[4:]]


def labelled():
    words = [f"plain{i}" for i in range(300)]
    rows = []
    for i in range(600):
        text = " ".join(words[(i * 31 + k * 17) % 300] for k in range(40))
        toxic = i % 6 == 0
        if toxic:
            text += " nastyword" * (1 + i % 3) + (f" horridx{i % 9} vilething" if i % 4 == 0 else "")
        rows.append((i, text, int(toxic)))
    return rows


def test_toxic_rows_are_found_and_graded(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]] + [(9999, 1), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    assert all(got[i].toxic == bool(y) for i, _, y in rows[400:])
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(0 <= r.score <= 1 and 0 <= r.severity <= len(model.thresholds) for r in got.values())
    mild = toxicity.judged("nastyword", model, {}, toxicity.Settings())
    worse = toxicity.judged("nastyword horridx3 vilething", model, {}, toxicity.Settings())
    assert worse[2] > mild[2]


@given
def test_toxicity_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, toxicity.learn(docs, labels)).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    clean = [r for r in got if not r.label]
    assert sum(r.toxic for r in clean) <= 0.02 * len(clean)
    english = [r for r in got if r.label and r.lang == "en"]
    assert sum(r.toxic for r in english) >= 0.8 * len(english)


def test_toxicity_of_odd_rows(spark):
    docs = edges.table(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.learn(docs, none)).collect()
    assert len(got) == len(edges.rows()) and {(r.toxic, r.severity) for r in got} == {(False, 0.0)}
    model = toxicity.fitted([(1, toxicity.present("vile thing", toxicity.Settings()))] * 30 + [(0, toxicity.present("good day", toxicity.Settings()))] * 30, toxicity.Settings())
    again = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, model).collect()}
    assert not again[2] and not again[3]
    assert toxicity.toxicity(edges.none(spark), model).count() == 0
