"""Quality rules as a bitmask ledger.

``measure`` reads each text once and returns plain counts. ``ledger`` evaluates every rule once on those counts and
stores one failure bit a rule beside them. Policies are versioned sets of rules: applying one, or another, or asking
what each rule costs (``ablation``) is bit arithmetic on the ledger and reads no text again.

Defined cases: a null or blank text has no words, all counts 0, and fails ``few_words``; repeated rows get a row each; an
empty table gives an empty ledger; columns other than the id and the text are ignored. A word is a run
of characters other than ASCII white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import picked

#: Characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts"]

#: Name and failure condition of each rule; its bit is its place here. New rules go to the end, so old ledgers stay valid.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("upper_case", "n_upper > n_lower"),
    ("shouting", "10 * n_shouts > n_words"),
]
#: Version: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(name for name, _ in RULES),
}


def repeated(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of ``size`` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    # Ranks of windows, a word longer each time: exact, as rank and word id fit in 64 bits.
    rank, base = ids[:n], len(seen)
    for k in range(1, size):
        values, rank = np.unique(rank * base + ids[k : k + n], return_inverse=True)
        if len(values) == n:
            return 0
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    letters = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return (
        len(words), len(text) - int(sum(letters[ord(c)] for c in BLANKS)), int(sum(letters[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)), repeated(words), len(lines),
        int(letters[65:91].sum()), int(letters[97:123].sum()), text.count("!!"),
    )


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every text: the id and ``COUNTS``."""
    importable(docs.sparkSession)
    rows = picked(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([counts(x) for x in batch["text"]], columns=COUNTS, dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInPandas(count, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def ledger(measured: DataFrame) -> DataFrame:
    """``measured`` with ``failures``: bit i is set where rule i fails."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, test) in enumerate(RULES)]
    out = bits[0]
    for bit in bits[1:]:
        out = out.bitwiseOR(bit)
    return measured.withColumn("failures", out)


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(name) for name in POLICIES[policy])


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that all rules together still keep.

    Documents with like bits are counted first, so what follows is as small as the number of bit patterns.
    """
    patterns = rows.groupBy("failures").agg(F.count(F.lit(1)).alias("n"), F.bit_or("failures").alias("bits"))
    names = [name for name, _ in RULES]
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << names.index(name)).cast("long").alias("bit")) for name in POLICIES[policy]])
    own = F.col("bits").bitwiseAND(F.lit(mask(policy)))
    fails = F.col("rule.bit").bitwiseAND(F.col("bits")) != 0
    return patterns.withColumn("rule", F.explode(rules)).groupBy(F.col("rule.rule").alias("rule"), F.col("rule.bit").alias("bit")).agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(own == F.col("rule.bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(own == 0, F.col("n")).otherwise(0)).alias("kept"),
        F.sum(F.when(own.bitwiseAND(F.bitwise_not("rule.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without_rule"),
    )
