"""Language and quality: held-out rows, plain Python for the trained parts, whole texts, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid, quality, queries

DATA = "/root/testdata/sf0.01"


def _auc(scored):
    """Share of (label 1, label 0) pairs in the right order, ties half."""
    ones, zeros = (np.array([s for s, y in scored if y == k]) for k in (1, 0))
    return float(((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros)).mean())


def test_languages_of_held_out_rows(spark):
    lang = {r["doc_id"]: r["lang"] for r in queries.table(spark, DATA, "documents").collect()}
    got = queries.op1_language_id(spark, DATA).collect()
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(got) == len(lang) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    sure = [r for r in held if not r["rejected"]]
    assert len(sure) > 0.8 * len(held) and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in sure]) > 0.98
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held])) < 0.1  # calibrated


def test_predictions_match_plain_python(spark):
    rows = [(t, g) for t, g in [("the cat and the hat of it", "en"), ("der hund und die katze ist", "de")] for _ in range(30)]
    model = langid.fit(rows)
    docs = [(k, t) for k, t in enumerate(["The cat", "die Katze", "12 !", None, "", "the " * 30_000, "Ünd"])]
    for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect():
        text = "".join(c if c.isalpha() else " " for c in (docs[r["doc_id"]][1] or "").lower())
        if not text.strip():
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = " " + " ".join(text.split()) + " "
        total, n = np.zeros(len(model.langs)), 0
        points = [0 if c == " " else ord(c) for c in own]
        for size in (2, 3, 4):
            for k in range(len(points) - size + 1):
                h = points[k]
                for j in range(1, size):
                    h = (h * 0x9E3779B97F4A7C15 + points[k + j] + j + 1) % (1 << 64)
                h = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
                total, n = total + model.table[h >> 49], n + 1
        z = np.exp((total / n + model.bias) / model.temperature)
        assert r["score"] == pytest.approx((z / z.sum()).max(), abs=1e-4) and r["lang_pred"] == model.langs[int(z.argmax())]


def test_training_reads_whole_texts():
    """What tells the languages apart stands behind 60,000 characters that are alike."""
    rng = np.random.default_rng(3)
    same = " ".join("abcdef"[int(k)] * 3 for k in rng.integers(6, size=15_000))
    rows = [(same + " " + word * 20_000, lang) for word, lang in (("xyz ", "one"), ("uvw ", "two")) for _ in range(12)]
    model = langid.fit(rows)
    assert model.predict("xyz xyz")[0] == "one" and model.predict("uvw uvw")[0] == "two"


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    rows = [(k, f"text number {k} of many", "l1" if k % 3 else "l2") for k in range(3000)] + [(1, "copy", "l1")] * 500 + [(9, None, "l1"), (10, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (langid.sample(d, rows=50) for d in (docs, docs.repartition(7)))
    assert [(a.tolist(), n.tolist(), lang) for (a, n), lang in one] == [(a.tolist(), n.tolist(), lang) for (a, n), lang in two]
    assert all(20 < sum(lang == x for _, lang in one) < 100 for x in ("l1", "l2"))
    assert langid.sample(docs.where("false")) == [] and langid.fit([]).predict("abc") == ("und", 0.0, True)


def test_quality_of_held_out_rows(spark):
    label = {r["doc_id"]: r["quality"] for r in queries.table(spark, DATA, "labels").collect()}
    scored = [(r["score"], label[r["doc_id"]], r["predicted"]) for r in queries.op5_quality(spark, DATA).where("held_out").collect() if label.get(r["doc_id"]) is not None]
    assert _auc([(s, y) for s, y, _ in scored]) > 0.97
    assert np.mean([p == y for _, y, p in scored]) > 0.95
    assert np.mean([p for _, y, p in scored if y == 1]) > 0.97  # clean documents stay


def test_votes_match_plain_python(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join("abcdefgh"[: int(n)] for n in rng.integers(1, 9, size=40)) + ("!! $$ BUY" * int(k % 2 * 5)) for k in range(80)]
    model = quality.fit([(t, 1 - k % 2) for k, t in enumerate(texts[:60])] + [(texts[0], 1)] * 20)  # ties
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(100, None), (101, "")], "doc_id long, text string")
    for r in quality.scores(docs, model).collect():
        z = (quality.features(r["text"]) * model.idf) @ model.basis
        z = z / max(1e-12, float(np.linalg.norm(z)))
        cosine = [float(z @ v) for v in model.vectors]
        least = sorted(cosine, reverse=True)[quality.NEIGHBOURS - 1]
        near = [(max(c, 0) ** 8 + 1e-9, y) for c, y in zip(cosine, model.labels, strict=True) if c >= least - quality.TIE]
        want = (sum(w * y for w, y in near) + 0.2 * model.prior) / (sum(w for w, _ in near) + 0.2)
        assert r["score"] == pytest.approx(want, abs=1e-3)


def test_labelled_texts_are_fitted_whole(spark):
    rng = np.random.default_rng(10)
    clean = [" ".join("abcdefghij"[: int(n)] for n in rng.integers(2, 9, size=1200)) + "." for _ in range(60)]
    rows = [(k, t + (" $$ BUY!! 99 <<NOW>> ##" * 150 if k % 2 else "")) for k, t in enumerate(clean)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality.fit(quality.sample(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    scored = model.score([t for _, t in rows[40:]])
    assert all((s >= quality.ACCEPT) == (k % 2 == 0) for k, s in enumerate(scored))


def test_odd_rows(spark):
    rows = [(1, None, "s", "x"), (2, "", "s", "x"), (3, "one", "s", "x"), (3, "one", "s", "x"), (None, "two words", None, None), (5, "word " * 30_000, "s", "x"), (6, "\n\n  \n", "s", "x")]
    model, judge = langid.fit([("the and of", "en"), ("der die das", "de")] * 20), quality.fit([("good text here.", 1), ("BAD!! BAD!!", 0)] * 5)
    for own in (rows, []):
        docs = spark.createDataFrame(own, "doc_id long, text string, lang_pred string, score string")
        found = langid.identify(docs, model)
        assert found.count() == len(own) and found.where("score < 0 or score > 1").count() == 0
        scored = quality.scores(docs, judge)
        assert scored.count() == len(own) and scored.where("score < 0 or score > 1").count() == 0
        kept = quality.scores(docs, judge, score="q").where("score is null or score = 'x'")
        assert kept.count() == len(own) and kept.columns == [*docs.columns, "q"]
    empty = quality.fit(quality.sample(docs, spark.createDataFrame([], "doc_id long, quality int")))
    assert quality.scores(docs.union(spark.createDataFrame([(1, "a", "b", "c")], docs.schema)), empty).first()["score"] == 0.5
