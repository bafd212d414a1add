from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import decontaminate as dc

ITEM = "If a train leaves at 9 and travels 120 miles in 3 hours how fast does Mary think the train of 120 miles moves on average"
SHORT = "What is this"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_questions_are_caught(spark, documents, odd):
    again = "well then. If a train leaves at 7 and travels 150 miles in 5 hours how fast does John think the train of 150 miles moves on average. so"
    torn = again.replace("train of 150", "train of 170")
    rows = [(10, ITEM), (11, f"x y z. {ITEM}. more"), (12, again), (13, torn), (14, " ".join(ITEM.split()[:9])), (15, "the river runs over stones and birds sing near old mills every day"), (10, ITEM), *odd]
    marked = dc.mark(documents(rows, clash=True), bench(spark, [(1, ITEM), (2, None), (3, ""), (4, SHORT), (5, "1 2 3 4 5 6 7 8 9 10")]))
    assert marked.count() == len(rows)
    got = {r["doc_id"]: r for r in marked.collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {10, 11, 12}
    assert got[12]["reparameterised"] and not got[11]["reparameterised"] and got[12]["items"] == [1]
    assert dc.mark(documents(rows), bench(spark, [])).filter("contaminated").count() == 0
    assert dc.mark(documents([]), bench(spark, [(1, ITEM)])).count() == 0


def test_occurrences_are_judged_apart(spark, documents):
    other = lambda a, b: ITEM.replace("120", a).replace("9", b)
    filler = " and so on went the old tale of birds and stones near mills. "
    longer = other("150", "7").replace("how fast", "oh how very fast")
    torn = ITEM.replace("train of 120", "train of 170")
    repeats = "we count the red stones in row 4 now. we count the red stones in row 6 now. say the sum of all of the stones"
    rows = [
        (20, ITEM + filler + other("150", "7")), (21, other("150", "7") + ". " + other("180", "8")), (22, ITEM + filler + ITEM[:60].replace("9", "8")),
        (23, repeats), (24, longer + filler + other("180", "8").replace("how fast", "how, I ask, fast")), (25, torn + filler + torn.replace("170", "180")),
    ]
    got = {r["doc_id"]: r for r in dc.mark(documents(rows), bench(spark, [(1, ITEM), (2, repeats)])).collect()}
    assert {i: list(r["items"]) for i, r in got.items()} == {20: [1], 21: [1], 22: [1], 23: [2], 24: [1], 25: []}
    assert {i for i, r in got.items() if r["reparameterised"]} == {21, 24}
    assert got[20]["coverage"] == got[22]["coverage"] == got[23]["coverage"] == 1.0


def test_items_without_windows_are_found_verbatim(spark, documents):
    sums, names, han = "12 + 30 + 45 + 61 + 70 + 88 + 90 + 11 = 407", "Berlin, Paris, Rome, Oslo, Madrid, Vienna, Prague, Lisbon", "一列火车九点出发三小时行驶一百二十公里平均速度是多少"
    items = [(1, SHORT), (2, sums), (3, names), (4, han), (5, "Was ist es")]
    rows = [
        (30, f"so we ask: {SHORT}? yes"), (31, f"add {sums} and go"), (32, f"the towns {names} and more"), (33, f"他说{han}呢"), (34, "well, was ist es denn"),
        (35, "what was this"), (36, f"add {sums.replace('45', '46')} and go"), (37, f"the towns {names.replace('Rome', 'Bonn')}"), (38, "一列火车"), (39, SHORT),
    ]
    got = {r["doc_id"]: list(r["items"]) for r in dc.mark(documents(rows), bench(spark, items)).collect()}
    assert got == {30: [1], 31: [2], 32: [3], 33: [4], 34: [5], 35: [], 36: [], 37: [], 38: [], 39: [1]}


def test_verbatim_windows_agree_with_brute_force(spark, documents):
    import random

    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ra", "so", "ne")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(8, 30)))) for i in range(15)]
    rows = []
    for i in range(40):
        own = [rng.choice(words) for _ in range(60)]
        if i % 3 == 0:
            item = items[i % 15][1].split()
            own[20:20] = item[: len(item) * (i % 4 + 1) // 4]
        rows.append((i, " ".join(own)))
    grams = lambda t: [tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)]
    want = {d: sorted(i for i, t in items if len(set(grams(t)) & set(grams(x))) >= 0.5 * len(set(grams(t)))) for d, x in rows}
    got = {r["doc_id"]: r["items"] for r in dc.mark(documents(rows), bench(spark, items)).collect()}
    assert got == want


def test_pipeline(spark, documents, tmp_path, odd):
    rows = [(i, f"document {i} " + " ".join(f"w{(i * 7 + k * k) % 97}" for k in range(30)), "en", f"s{i % 3}") for i in range(100, 160)]
    rows = [(i, t + (" you vilest grunkle" if i % 6 == 0 else ""), a, b) for i, t, a, b in rows]
    rows += [(300, ITEM, "en", "s0"), (301, "the key is password=abcdefgh1234 for all of us here", "en", "s1"), (302, rows[1][1], "en", "s2"), *[(*r, None, None) for r in odd]]
    docs = documents(rows).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(100, 160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, [(1, ITEM)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    at, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        seen[name] = at.toPandas()
    ids = lambda n: set(seen[n].doc_id.dropna().astype(int))
    assert not {i for i in ids("toxicity") if 100 <= i < 160 and i % 6 == 0} and {i for i in range(100, 160) if i % 6} <= ids("toxicity")
    assert 302 not in ids("near_dedup") and rows[1][0] in ids("near_dedup")
    assert 300 not in ids("decontamination")
    text = seen["secrets"].set_index("doc_id").text
    assert "abcdefgh1234" not in text[301] and "[REDACTED]" in text[301]
    mixed = seen["mixing"]
    assert len(mixed) == len(seen["secrets"]) and (mixed.taken == mixed.copies * mixed["size"]).all()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, at.collect()))


def test_pipeline_of_nothing(spark, documents, tmp_path):
    docs = documents([])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench(spark, []).write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_verbatim_copies_in_other_lines_and_letters(spark, documents):
    item = "The quick river runs in the old town of Springfield as of 1990 and nobody in Boston knows why it went there in 1985"
    rows = [
        (1, item.replace(" ", "\n")), (2, item.upper()), (3, item.lower()), (4, item.replace(" ", " \t ").replace("town", "town\r\n")), (5, item.replace(" ", " ")),
        (6, item.upper().replace("1990", "1970").replace("TOWN", "CITY").replace("WENT", "CAME")), (7, item.replace("Springfield", "Shelbyville")), (8, item.replace("as of ", "as\nof ").replace("of Springfield", "of\nSpringfield")),
    ]
    got = {r["doc_id"]: (r["contaminated"], r["reparameterised"]) for r in dc.mark(documents(rows), bench(spark, [(1, item)])).collect()}
    assert got == {i: (i != 6, i == 7) for i in range(1, 9)}
