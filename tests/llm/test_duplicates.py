import random
from collections import Counter

import numpy as np

from quarry.llm import line_dedup, near_dedup
from quarry.llm.components import components


def weighted(a, b):
    return sum((a & b).values()) / max(sum((a | b).values()), 1)


def bag(text):
    words = text.encode().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def copies(seed=0):
    """Texts, exact copies, and copies with words changed from few to many."""
    rng = random.Random(seed)
    rows = []
    for _ in range(12):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 40, 150]))]
        rows.append(" ".join(words))
        for changes in (0, 1, 1, 2, 3, 5, 8):
            own = list(words)
            for _ in range(changes):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rows += ["go go go go go go go go", "go go go go go go go", "short", "short", "one two"]
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def brute(rows):
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    bags = [bag(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and weighted(bags[i], bags[j]) >= 0.8:
                above[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 10**9), doc)
    return {doc: least[top(i)] for i, (doc, _) in enumerate(rows)}


def test_classes_are_those_of_all_pairs(documents):
    rows = copies()
    found = near_dedup.near_duplicates(documents(rows, clash=True)).toPandas()
    assert dict(zip(found.doc_id, found.class_id, strict=True)) == brute(rows)
    sizes = Counter(brute(rows).values())
    assert all(sizes[c] == n for c, n in zip(found.class_id, found.class_size, strict=True))


def test_blocks_find_what_stars_miss(documents, monkeypatch):
    """A chain of texts, each near the next only, in blocks of two: one class."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(8):
        rows.append((k, " ".join(words[3 * k : 3 * k + 90])))
    found = near_dedup.near_duplicates(documents(rows)).toPandas()
    assert dict(zip(found.doc_id, found.class_id, strict=True)) == brute(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        ids, n = rng.integers(0, 2**63, 200).astype(np.uint64), rng.integers(1, 9, 200)
        m = np.where(rng.random(200) < 0.6, n, rng.integers(1, 9, 200))
        made = near_dedup.signatures([(ids, n), (ids, m)])
        errors.append((made[0] == made[1]).mean() - np.minimum(n, m).sum() / np.maximum(n, m).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_overlaps_of_multisets():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(9)]
    got = near_dedup.overlaps(sets[:4], sets[4:])
    for i, a in enumerate(sets[:4]):
        for j, b in enumerate(sets[4:]):
            assert got[i, j] == sum((Counter(a.tolist()) & Counter(b.tolist())).values()) == near_dedup.similarity(a, b)[0]


def test_odd_rows_one_of_each_and_empty(documents, odd):
    docs = documents(odd, clash=True)
    classes = near_dedup.near_duplicates(docs)
    assert classes.count() == len(odd)
    kept = near_dedup.one_of_each(docs, classes)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 5]
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in edges:
        if a != b:
            above[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in above if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_units(text, least):
    """Units by their definition: whole clauses; every line, and from each clause on the shortest run, of ``least`` words or more."""
    clauses, at = [], 0
    for line_no, line in enumerate(text.split("\n")):
        start = at
        for i, ch in enumerate(line + "\n"):
            if ch in ".!?,;:\n":
                piece = text[start : at + i]
                if piece.split():
                    a = start + len(piece) - len(piece.lstrip())
                    clauses.append((line_no, a, a + len(piece.strip()), piece.lower().split()))
                start = at + i + 1
        at += len(line) + 1
    runs = set()
    for i in range(len(clauses)):
        for j in range(i, len(clauses)):
            if sum(len(c[3]) for c in clauses[i : j + 1]) >= least:
                runs.add((i, j))
                break
        if i == 0 or clauses[i - 1][0] != clauses[i][0]:
            j = max(k for k in range(len(clauses)) if clauses[k][0] == clauses[i][0])
            if sum(len(c[3]) for c in clauses[i : j + 1]) >= least:
                runs.add((i, j))
    return sorted((clauses[i][1], clauses[j][2], " ".join(w for c in clauses[i : j + 1] for w in c[3])) for i, j in runs)


def test_units_are_those_of_the_definition():
    rng = random.Random(13)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb ", "cc ", " ", ". ", ", ", "\n", "é", "x y z "]) for _ in range(rng.randrange(0, 90)))
        for least in (1, 4, 9):
            assert sorted(set(line_dedup.units(text, least))) == sorted(set(plain_units(text, least))), (text, least)


def test_passages_and_short_lines(documents, odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", 3)
    passage = "This passage of many words stands here, in several texts. It is the same in each of the texts that hold it. No more."
    footer = "All of these words are at the foot of each and every page of this place and nowhere else at all"
    rows = [
        (22, f"Intro one two three four.\n{passage}\nEnd of the second text here."), (21, f"First line of this text is.\n{passage}"), (23, f"Words before. {passage} Words after it."), (24, "tiny line of words\ntiny line of words"),
        (25, "One  TWO three four five\nx\none two three four five"), (26, passage.replace(" ", "  ").upper()), *[(30 + i, f"own text {i} of some words\n{footer}") for i in range(9)], *odd,
    ]
    found = line_dedup.deduplicate(documents(rows, clash=True), keep=["doc_id", "text"])
    first, occurrences = {}, []
    for doc, text in rows:
        for a, b, unit in plain_units(text or "", line_dedup.LEAST):
            key = (doc is None, doc or 0, a)
            occurrences.append((unit, doc, text, a, b, key))
            first[unit] = min(first.get(unit, key), key)
    for r in found.collect():
        want = sorted({(a, b) for unit, doc, text, a, b, key in occurrences if (doc, text) == (r["doc_id"], r["text"]) and key != first[unit]})
        merged = []
        for a, b in want:
            if merged and merged[-1][1] >= a:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        assert [[s["start"], s["end"]] for s in r["removed"]] == merged, r["doc_id"]
    left = {r["doc_id"]: r["left"] for r in found.select("doc_id", line_dedup.cut(found["text"], found["removed"]).alias("left")).collect()}
    assert "This passage" in left[21] and all("passage" not in left[i].lower() and "same in each" not in left[i].lower() for i in (22, 23, 26)) and left[21].startswith("First line")
    assert left[24] == "tiny line of words\ntiny line of words" and footer in left[30] and left[38] == "own text 8 of some words\n"
    assert found.count() == len(rows)
    assert line_dedup.deduplicate(documents([])).count() == 0
    short = line_dedup.deduplicate(documents(rows), keep=["doc_id"], least=3).filter("doc_id = 24").first()
    assert [[s["start"], s["end"]] for s in short["removed"]] == [[19, 37]]


def test_blocks_of_large_components(documents, monkeypatch):
    """Blocks of one component don't meet each other, but do meet the rest: the classes are those of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(15)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(60):
        own = list(words[:150])
        for _ in range(k % 5):
            own[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, " ".join(words[3 * k : 3 * k + 130])) for k in range(12)]
    found = near_dedup.near_duplicates(documents(rows)).toPandas()
    assert dict(zip(found.doc_id, found.class_id, strict=True)) == brute(rows)
