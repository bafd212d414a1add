"""Every operator and every stage on texts, urls and columns that are out of the ordinary."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate, labelled, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secrets, toxicity, url_filter
from quarry.llm.common import Box, picked

#: Repeats that patterns with groups, or whatever takes a step back at each turn, would trip over.
MONSTERS = ["1," * 200_000, "-abcd" * 100_000, "a." * 200_000, "(" * 300_000, "x" * 2_000_000, "Ab" * 300_000, "deadbeef-" * 60_000, "\n" * 300_000, "a://b " * 50_000, "id=abcd " * 40_000, "é，" * 100_000, "9.9:" * 100_000]
#: Names that operators, or helpers of theirs, have had or have for columns, and the input's own in another case.
HELPERS = [
    "row", "none", "c0", "c1", "c2", "c7", "key", "_key", "_weak", "_found", "_extra", "_text", "Score", "OFFENDING", "_own", "_mark", "_hit", "Items", "Contaminated", "coverage", "_hash", "_id", "Removed", "REMOVED", "base_spans", "All_Spans", "cuts",
    "mark", "node", "sig", "bands", "component", "class_id", "_blank", "_times", "found", "span", "start", "end", "size", "skey", "base", "target", "copies", "n", "rank", "label", "h1", "h2", "at", "hash", "slots", "TEXT", "Doc_Id", "Source", "lang_pred",
]


def monsters(documents):
    return documents([(i, x) for i, x in enumerate(MONSTERS)])


def operators(spark, docs, bench):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, label int")
    plain = picked(docs, doc_id="doc_id", text="text", lang="lang")
    always = F.lit(True)
    return {
        "toxicity": lambda: toxicity.score(docs, toxicity.train(plain, labels, always)),
        "secrets": lambda: secrets.redact(secrets.find_secrets(docs)),
        "decontaminate": lambda: decontaminate.mark(docs, bench),
        "quality_rules": lambda: quality_rules.ledger(quality_rules.measure(docs)),
        "line_dedup": lambda: line_dedup.deduplicate(docs),
        "language_id": lambda: language_id.identify(docs, always),
        "quality_classifier": lambda: quality_classifier.grade(docs, quality_classifier.train(plain, labels, always), 1),
        "near_dedup": lambda: near_dedup.near_duplicates(docs),
        "mixing": lambda: mixing.entropy_balance(docs),
    }


OPERATORS = ["toxicity", "secrets", "decontaminate", "quality_rules", "line_dedup", "language_id", "quality_classifier", "near_dedup", "mixing"]
ITEMS = [(1, "how many of the red stones are near the old mill on the hill"), (2, "1,1,1,1"), (3, "x"), (4, None)]


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_texts_that_trip_patterns(spark, documents, bench, name):
    docs = monsters(documents)
    made = operators(spark, docs, bench)[name]()
    assert made.agg(F.count(F.lit(1)), F.sum(F.hash(*[F.col(f"`{c}`").cast("string") for c in made.columns if c != "text"]))).first()[0] == len(MONSTERS)


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_any_name(spark, documents, bench, name):
    docs = documents([(i, f"text {i} of no note, but with password=abcdefgh{i} in it") for i in range(6)])
    odd = docs.select("*", *[F.lit("kept").alias(h) for h in HELPERS])
    made = operators(spark, odd, bench)[name]()
    rows = made.collect()
    assert len(rows) == 6
    new = {"toxicity": {"score", "offending"}, "secrets": {"base_spans", "all_spans", "cuts"}, "decontaminate": {"contaminated", "items", "coverage", "reparameterised"}, "line_dedup": {"removed"}}.get(name)
    if new:
        assert sorted(made.columns) == sorted([*(c for c in odd.columns if c.lower() not in new), *new])
        for i, c in enumerate(made.columns):
            assert c not in HELPERS or c in new or all(r[i] == "kept" for r in rows), c


def test_stages_of_columns_of_any_name(spark, documents, bench, tmp_path):
    docs = documents([(i, f"text {i} of no note, but with password=abcdefgh{i} in it and {'more ' * i}") for i in range(8)]).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.select("*", *[F.lit("kept").alias(h) for h in HELPERS])
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        rows = at.collect()
        assert rows and all(r[docs.columns.index(h)] == "kept" for r in rows for h in HELPERS), name
    assert corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).count() == len(rows)


def test_stages_of_texts_that_trip_patterns(spark, documents, bench, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    at = monsters(documents)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    assert at.count() > 0


def test_urls_that_trip_patterns(spark):
    urls = ["http://h.xyz/abcdef01" + "-abcd" * 50_000, "http://h.xyz" + "/a" * 50_000, "http://h.xyz" + "/a" * 50_000 + "/b", "http://h.xyz/" + "9" * 500_000, "http://" + "a." * 100_000 + "com/en/1", "http://h.xyz/en/1", "h" * 300_000, "://" * 50_000]
    odd = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").select("*", *[F.lit("kept").alias(c) for c in ["_host", "_at", "Template", "HOST", "sid", "tid", "made", "segs", "label", "ruled", "row", "c0", "URL"]])
    found = url_filter.filter_urls(odd)
    assert [c for c in found.columns if c.lower() == "template"] == ["template"] and [c for c in found.columns if c.lower() == "host"] == ["host"]
    rows = found.collect()
    assert len(rows) == len(urls) and {r["rule"] for r in rows} == {None, "com/en/"}


def test_box():
    class Named:
        columns = ["a", "A", "b"]

        def toDF(self, *names):
            return names

    box = Box(Named(), None, ["B"])
    assert box.place("A") == 1 and box.place("a") == 0 and box.place("B") == 2 and [n for _, n in box.kept] == ["a", "A"]


def test_sample_takes_the_lowest_hashes(spark):
    known = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("label"))
    got = {(r["label"], r["rank"]): r["doc_id"] for r in labelled.lowest(known, 40).collect()}
    marks = known.select("doc_id", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("m")).collect()
    for label in range(3):
        want = [r["doc_id"] for r in sorted((r for r in marks if r["label"] == label), key=lambda r: r["m"])][:40]
        assert [got[label, k + 1] for k in range(40)] == want
