import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#\x0b\x85\xa0é😀", max_size=80))
def test_counts(text):
    assert qr.counts(text)[:5] == brute(text)


def test_ledger_policies_and_ablation(spark, documents, odd):
    rows = [*odd, (10, "SHOUT!! " * 3 + " ".join(f"W{i}!!" for i in range(20))), (11, " ".join(f"plain{i} word" for i in range(30))), (12, "a### b*** " * 9)]
    led = qr.ledger(qr.measure(documents(rows, clash=True)))
    kept = led.select("doc_id", "failures", qr.passes("base").alias("base"), qr.passes("v1").alias("v1")).collect()
    assert len(kept) == len(rows)
    by = {r["doc_id"]: r for r in kept}
    assert by[11]["v1"] and not by[10]["v1"] and not by[1]["base"] and not by[5]["base"]
    for r in qr.ablation(led, "v1").collect():
        own = [x["failures"] & qr.mask("v1") for x in kept]
        assert r["failed"] == sum(bool(f & r["bit"]) for f in own)
        assert r["failed_alone"] == sum(f == r["bit"] for f in own)
        assert r["kept_without_rule"] == sum(not f & ~r["bit"] for f in own)
    assert qr.ledger(qr.measure(documents([]))).count() == 0
