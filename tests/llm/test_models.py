"""Trained operators: held-out accuracy on generated text, and defined results for odd input."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import labelled, language_id, quality_classifier, toxicity
from quarry.llm.common import fold

WORDS = ["the", "river", "runs", "over", "stones", "and", "birds", "sing", "near", "old", "mills", "every", "spring", "day"]


def toxic_rows(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(WORDS) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        bad = i % 5 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += " you vilest " + rng.choice(["grunkle", "snarfer"])
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_is_learned_and_located(spark, documents):
    rows, labels = toxic_rows(400)
    docs, marks = documents(rows, clash=True), spark.createDataFrame(labels, "doc_id long, label int")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs.select("doc_id", "text"), marks, ~held_out)
    found = toxicity.score(docs, model, keep=["doc_id", "text"]).collect()
    assert len(found) == 400
    for r in found:
        bad = r["doc_id"] % 5 == 0
        assert (r["score"] >= 0.5) == bad
        assert bool(r["offending"]) == bad
        for s in r["offending"]:
            assert "vilest" in r["text"][s["start"] : s["end"]]


def test_toxicity_of_odd_rows(spark, documents, odd):
    docs = documents(odd).select("doc_id", "text")
    for labels in ([], [(4, 1)], [(1, 0), (4, 1), (4, None), (None, 1), (2, None), (77, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, label int"), F.lit(True))
        found = toxicity.score(docs, model).collect()
        assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.score(documents([]), model).count() == 0


def test_noisy_or():
    model = toxicity.Model({toxicity.buckets("bad")[0]: 9.0}, -6.0, 0.1)
    one, _ = model.score("bad.")
    two, spans = model.score("bad. fine. bad!")
    assert one < two <= 1 and len(spans) == 2
    p, q = 1 / (1 + np.exp(-3.0)), 1 / (1 + np.exp(6.0))
    assert abs(two - (1 - 0.9 * (1 - p) ** 2 * (1 - q))) < 1e-9


SAMPLES = {"aa": "ka lo mi ka lo tu kalomi tulo mika", "bb": "zer vot zer pla votpla zerpla plavot grun", "é": "éta ôni éta ûlo ôniéta ûloôni"}


def phrases(text, sample):
    """Greedy longest matches, the plain way."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        n, at = n + 1, at + size
    return n


def test_cross_parsing_counts_phrases():
    parser = language_id.CrossParser(SAMPLES)
    rng = random.Random(1)
    texts = ["".join(rng.choice("kalomituzerv pé") for _ in range(rng.randrange(1, 200))).strip() or "k" for _ in range(40)]
    texts = [" ".join(t.split()) or "k" for t in texts]
    codes, of = parser.encode(texts)
    got = parser.phrases(codes, of, len(texts))
    for i, lang in enumerate(parser.langs):
        for j, text in enumerate(texts):
            assert got[i, j] == phrases(text, SAMPLES[lang]), (lang, text)


def test_languages(spark, documents, odd):
    rng = random.Random(2)
    rows = [(i + 1000, " ".join(rng.choice(SAMPLES[lang].split()) for _ in range(12)) + ".", lang, "s") for i, lang in enumerate(["aa", "bb", "é"] * 40)]
    rows += [(200, "12 34 !!", None, "s"), (201, None, "aa", "s"), (202, "", None, "s"), (203, "ka lo\0mi", None, "s"), *[(*r, None, "s") for r in odd]]
    found = language_id.identify(documents(rows, clash=True), fold(F.col("doc_id"), 4) != 2).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i + 1000]["lang_pred"] == lang for i, lang in enumerate(["aa", "bb", "é"] * 40))
    assert [by[i]["lang_pred"] for i in (200, 201, 202, 203)] == ["und", "und", "und", "aa"] and by[200]["score"] == 0
    assert {r["lang_pred"] for r in language_id.identify(documents(rows), F.lit(False)).collect()} == {"und"}
    assert language_id.identify(documents([]), F.lit(True)).count() == 0


def test_grades_are_ordered(spark, documents, odd):
    rng = random.Random(3)
    rows, ratings = [], []
    for i in range(300):
        grade = i % 3
        words = [rng.choice(WORDS) + ("***" if rng.random() < (0.6, 0.25, 0.0)[grade] else "") for _ in range(40)]
        rows.append((i, " ".join(words)))
        ratings.append((i, grade))
    docs, marks = documents(rows), spark.createDataFrame(ratings, "doc_id long, label int")
    model = quality_classifier.train(docs, marks, fold(F.col("doc_id"), 5) != 0)
    assert (np.diff(model.thresholds) > 0).all()
    found = quality_classifier.grade(docs, model, 1).withColumn("held_out", fold(F.col("doc_id"), 5) == 0).toPandas()
    held = found[found.held_out]
    means = held.groupby(held.doc_id % 3).expected_grade.mean()
    assert means[0] < means[1] < means[2] and means[0] < 0.5 and means[2] > 1.5
    out = quality_classifier.grade(documents(odd, clash=True), model, 1).collect()
    assert len(out) == len(odd) and all(0 <= r["tail"] <= 1 for r in out)
    none = quality_classifier.train(docs, marks.limit(0), F.lit(True))
    assert quality_classifier.grade(docs, none, 1).first()["tail"] == 0
    assert quality_classifier.grade(documents([]), model, 1).count() == 0


def test_sample_is_bounded_and_weighted(spark, documents):
    docs = documents([(i, "t" * (i + 1)) for i in range(100)]).select("doc_id", "text")
    marks = spark.createDataFrame([(i, int(i < 80)) for i in range(100)], "doc_id long, label int")
    rows, sizes = labelled.sample(docs, marks, F.lit(True), per_class=10)
    got = labelled.gather(rows, lambda x: {"n": len(x), "b": x.encode()}, {"n": pa.int64(), "b": pa.binary()})
    weight = labelled.balanced(got["label"], sizes)
    assert len(got["label"]) == 20 and sizes == {0: 20, 1: 80} and abs(weight[got["label"] == 1].sum() - 0.8) < 1e-9
    assert [len(b) for b in got["b"]] == got["n"].tolist() and (got["rank"] == np.repeat(np.arange(1, 11), 2)).all()
    few, _ = labelled.sample(docs, marks, F.lit(True), per_class=10, chars=400)
    assert 0 < sum(r["n"] for r in few.select(F.length("text").alias("n")).collect()) <= 400


def test_slopes_of_the_ordinal_loss():
    """The slopes that the fit follows are those of the loss, measured by small steps."""
    rng = np.random.default_rng(6)
    y, weight = np.arange(12) % 3, np.full(12, 1 / 12)
    row, col, val = np.repeat(np.arange(12), 4).astype(np.int32), rng.integers(0, 9, 48).astype(np.uint16), rng.random(48).astype(np.float32)
    at = [rng.normal(size=quality_classifier.BUCKETS) * (np.arange(quality_classifier.BUCKETS) < 9), np.array([-0.5]), np.array([0.2])]
    loss = lambda x: quality_classifier.gradients(*x, y, weight, row, col, val, np.arange(12))
    slopes = loss(at)[1]
    for k, places in ((0, range(9)), (1, [0]), (2, [0])):
        for i in places:
            up, down = ([x.copy() for x in at] for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((loss(up)[0] - loss(down)[0]) / 2e-5 - slopes[k][i]) < 1e-5


def test_features_are_the_same_on_executors(spark, documents):
    texts = ["One two  TWO 3.5%", "", None, "wörd wörd"]
    rows = spark.createDataFrame([(x or "", i % 2, i) for i, x in enumerate(texts)], "text string, label int, rank int")
    _, row, col, val = quality_classifier.sparse(rows)
    for i, x in enumerate(texts):
        want = quality_classifier.vector(x, {})
        assert {int(c): float(v) for c, v in zip(col[row == i], val[row == i], strict=True)} == {c: float(np.float32(v)) for c, v in want.items()}
    y, n = toxicity.shares(rows)
    held = [{b for s in toxicity.sentences(x) for b in s} for x in texts]
    assert n.tolist() == [2, 2] and all(y[k, b] == sum(b in h for h in held[k::2]) for k in (0, 1) for h in held for b in h)


def test_languages_of_many_letters_and_long_texts():
    rng = random.Random(8)
    han = [chr(0x4E00 + i) for i in range(900)]
    samples = {"one": "".join(rng.choice(han[:500]) for _ in range(3000)), "two": "".join(rng.choice(han[400:]) for _ in range(3000)), "abc": "abcab cabca" * 40}
    parser = language_id.CrossParser(samples)
    texts = [samples["one"][100:1300] + samples["two"][5:1200], samples["abc"] * 3, "".join(rng.choice(han) for _ in range(700)), samples["two"], "a", "b" * 1000]
    codes, of = parser.encode(texts)
    got = parser.phrases(codes, of, len(texts))
    for i, lang in enumerate(parser.langs):
        for j, text in enumerate(texts):
            assert got[i, j] == phrases(" ".join(text.split()), samples[lang]), (lang, j)
    assert parser.classify([samples["one"][50:90], samples["two"][50:90]])[0] == ["one", "two"]


def test_language_samples_are_full(spark, documents):
    rows = [(i, f"{'ab ' * (5 if i % 2 else 4000)}{i}", "en", "s") for i in range(90)]
    got = language_id.sample(documents(rows).select("doc_id", "text", "lang"))
    assert language_id.SAMPLE_CHARS <= len(got["en"]) <= language_id.SAMPLE_CHARS + language_id.SAMPLE_DOCS
