import pytest

from quarry.llm import mixing


def water_fill(sizes, weights, cap):
    """Targets by the stated loop: share by weight, stop at the cap, share the rest again."""
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > cap * sizes[i] + 1e-9}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            return target
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets_and_taken(documents):
    rows, k = [], 0
    for s, n in (("a", 5), ("b", 60), ("c", 40), (None, 30), ("é", 25)):
        for i in range(n):
            rows.append((k, "w " * (i % 17 + 1), "en", s))
            k += 1
    found = mixing.entropy_balance(documents(rows, clash=True)).toPandas()
    order = ["a", "b", "c", "é", None]
    sizes = [int(found[found.source.isna() if s is None else found.source == s]["size"].sum()) for s in order]
    want = water_fill(sizes, [5, 2, 1, 5, 2], 3)
    for s, size, target in zip(order, sizes, want, strict=True):
        own = found[found.source.isna() if s is None else found.source == s]
        assert set(own.source_size) == {size}
        assert own.target.iloc[0] == pytest.approx(target)
        assert abs(own.taken.sum() - target) <= max(1.0, 0.01 * target)
    assert (found.taken <= 3 * found["size"]).all()


def test_reruns_agree_and_odd_rows(documents, odd):
    docs = documents(odd)
    one, two = (sorted(map(str, mixing.entropy_balance(docs).collect())) for _ in range(2))
    assert one == two and len(one) == len(odd)


def test_base_rates_and_cap(documents, spark):
    from pyspark.sql import functions as F

    docs = documents([(i, "w " * 10, "en", "s" if i < 50 else "t") for i in range(100)])
    found = mixing.entropy_balance(docs, weights=(5, 1), base_rate=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25)).toPandas()
    own = found[found.source == "s"]
    assert own.rate.max() <= 3 and own[own.doc_id % 2 == 0].rate.mean() > own[own.doc_id % 2 == 1].rate.mean()
    assert own.taken.sum() == pytest.approx(own.target.iloc[0], rel=0.02)


def test_large_cell_is_dealt_by_chunks(documents):
    docs = documents([(i, "w w w", "en", "a" if i % 3 else "b") for i in range(3000)])
    found = mixing.entropy_balance(docs).toPandas()
    for _, own in found.groupby("source"):
        assert own.taken.sum() == pytest.approx(own.target.iloc[0], rel=0.02)


def test_empty(documents):
    assert mixing.entropy_balance(documents([])).count() == 0
    assert mixing.entropy_balance(documents([(1, None), (2, "")])).toPandas()["taken"].tolist() == [0, 0]


def solved(sizes, target, cap, base):
    """The optimum by halving: rates of documents of these sizes and base rates that use the target."""
    import math

    low, high = -5.0, 5.0
    rates = lambda x: [min(cap, b * math.exp(min(x * s, 50))) for s, b in zip(sizes, base, strict=True)]
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(r * s for r, s in zip(rates(mid), sizes, strict=True)) < target else (low, mid)
    return rates(low)


def test_rates_are_the_optimum_and_differ_within_a_source(documents):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k, "w " * int(rng.lognormvariate(3, 1) + 1), "en", "abc"[k % 3] if k % 7 else "c") for k in range(600)]
    docs = documents(rows)
    for base in (None, F.when(F.col("doc_id") % 2 == 0, 0.3).otherwise(1.7)):
        found = mixing.entropy_balance(docs, base_rate=base).toPandas()
        for s, own in found.groupby("source"):
            want = solved(own["size"].tolist(), own.target.iloc[0], 3, [1.0 if base is None else (0.3 if d % 2 == 0 else 1.7) for d in own.doc_id])
            assert own.rate.tolist() == pytest.approx(want, rel=1e-6), s
            assert own.rate.max() > own.rate.min() + 0.05
            assert abs(own.taken.sum() - own.target.iloc[0]) <= max(1.0, 0.01 * own.target.iloc[0])
            assert (abs(own.copies - own.rate) < 1 + 1e-9).mean() > 0.95


def test_newton_takes_steps(spark):
    cells = spark.createDataFrame([("a", s, 1.0, 5) for s in (1, 10, 100, 400)] + [("b", s, 1.0, 5) for s in (3, 30)], "skey string, size long, base double, n long")
    targets = spark.createDataFrame([("a", 2555.0, 4000.0), ("b", 165.0, 495.0)], "skey string, source_size double, target double")
    tilts, steps = mixing.solve_tilts(cells, targets, 3)
    lam = {r["skey"]: r["lam"] for r in tilts.collect()}
    assert 2 < steps < 20 and solved([1, 10, 100, 400] * 5, 4000, 3, [1] * 20)[2] == pytest.approx(min(3, 2.718281828459045 ** (lam["a"] * 100)), rel=1e-6)
    assert lam["b"] == pytest.approx(1.0986122886681098 / 3)


def test_documents_of_base_rate_0_are_never_taken(documents):
    from pyspark.sql import functions as F

    rows = [(1, "w " * 900, "en", "a"), (2, "w " * 1200, "en", "a"), (3, "w " * 2, "en", "a"), (4, "w " * 3, "en", "a"), (5, "w " * 5000, "en", "b"), (6, "w " * 40, "en", "c")]
    base = F.when(F.col("doc_id").isin(1, 5), 0.0).when(F.col("doc_id") == 2, F.lit(float("nan"))).otherwise(1.0)
    found = {r["doc_id"]: r for r in mixing.entropy_balance(documents(rows), base_rate=base).collect()}
    assert {i: (found[i]["rate"], found[i]["taken"]) for i in (1, 2, 5)} == {1: (0, 0), 2: (0, 0), 5: (0, 0)}
    # Sizes and targets know the words that may be taken only; a source without any has the target 0.
    assert [found[i]["source_size"] for i in (1, 5, 6)] == [5, 0, 40] and found[5]["target"] == 0 and found[1]["target"] == 15 and found[3]["taken"] + found[4]["taken"] == 15
