"""The audit of sources against plain Python, over blocks and strips of every size."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, least=3, best=200):
    seen, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        own = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        seen[lang, source].update(own)
        docs[lang].update(set(own))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        sources = sorted({s for x, s in groups if x == lang}, key=str.encode)
        counts = {s: {t: seen[lang, s][t] for t in kept} for s in sources}
        total = {t: sum(counts[s][t] for s in sources) for t in kept}

        def p(own):
            n = sum(own.values()) + len(kept)
            return {t: 1 + 10**9 * (c + 1) // n for t, c in own.items()}

        weights, whole = {s: p(counts[s]) for s in sources}, p(total)

        def far(a, b, t):
            return (a[t] - b[t]) ** 2 // b[t]

        for s in sources:
            pairs = [(sum(far(weights[s], weights[o], t) for t in kept), o) for o in sources if o != s]
            above = [(far(weights[s], whole, t), t) for t in kept if counts[s][t] and weights[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", above, best)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)}
    return out


def corpus(n, rng):
    words = ["Stone", "stone", "mühle", "Öl", "river's", "a1b", "é", "日本", "x", "Z", "-", "über"] + [f"w{chr(97 + i)}" for i in range(26)]
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(25))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "S1", "ü", None, "s3"])) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")


@pytest.mark.parametrize(("block", "strip", "best"), [(4096, 128, 200), (5, 2, 4), (1, 1, 200)])
def test_as_by_hand(spark, monkeypatch, block, strip, best):
    rows = corpus(150, random.Random(block))
    rows += [(None, "xx", "only"), ("once", "yy", "s1"), ("", "yy", "s2"), *[("same same text", "en", "s1")] * 4]
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SOURCES", strip)
    monkeypatch.setattr(divergence, "_tile", _with_strip(strip))
    got = divergence.audit(frame(spark, rows), best=best).collect()
    assert {tuple(r) for r in got} == by_hand(rows, best=best) and len(got) == len({tuple(r) for r in got})


def _with_strip(strip):
    own = divergence._tile

    def work(best, key, table):
        from quarry.llm import divergence as there

        before, there.SOURCES = there.SOURCES, strip
        try:
            return own(best, key, table)
        finally:
            there.SOURCES = before

    return work


def test_odd_tables(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    assert divergence.audit(frame(spark, [(None, None, None)])).collect() == []
    got = divergence.audit(frame(spark, [("a", "en", "s1"), ("b", "en", "s2")])).collect()
    assert {tuple(r) for r in got} == {("en", "s1", "pair", "s2", 0, 1), ("en", "s2", "pair", "s1", 0, 1)}
    long = [("Word " * 300_000, "en", "s1"), ("é" * 1_500_000 + " word", "en", "s2"), ("word", "en", "s2")]
    assert {tuple(r) for r in divergence.audit(frame(spark, long)).collect()} == by_hand(long)


def test_counts_beyond_nine_milliards_are_exact():
    counts, size = np.array([[0, 5 * 10**12, 10**13]]), np.array([[3 * 10**13]])
    assert divergence._weights(counts, size).tolist() == [[1 + 10**9 * (c + 1) // (3 * 10**13) for c in counts[0].tolist()]]


def test_long_texts_are_split_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 7)
    text = "Alpha beta, GAMMA-delta ünlü  x" * 9
    assert [t for some in divergence.terms(text.encode()) for t in some] == [t.encode() for t in TERM.findall(text.translate(LOWER))]
