"""Substring deduplication by hashing lines and the paragraphs that consecutive clauses make up.

A text is cut into clauses, at line breaks and at . ! ? , ; and :, and units are made of whole clauses: every line, and from
each clause on the shortest run of clauses of at least ``LEAST`` words, so that a passage is found in mid-line and across lines too. Units
are normalised (lower case, words only, one space between) and those of fewer than ``LEAST`` words are left alone: a short sentence or line that
stands in two documents is no copied passage. (A lower ``least`` has short lines removed as well.) Digests are grouped over all
documents; the occurrence of the lowest rank (doc_id, then offset) stays and every other is removed. What is removed is given as offsets
in the original text (code points, end exclusive); of a repeated run, clauses of together fewer than ``LEAST`` words may stay at its end.

Grouping takes two steps, as most units occur once: 64-bit digests that occur twice or more are found by counting, and only units
that bear one are grouped by all 128 bits. Counting combines within tasks first. Digests of more than ``HEAVY`` occurrences meet their
units by a broadcast while they are at most ``BROADCAST_ROWS``, all others by a shuffle, so no task gathers the units of a hot line.

Defined cases: a null or blank text has no units; rows alike in id and text are one document, each gets the same result; texts that share an
id are ranked by a hash of the text; a null id ranks last; an empty table gives an empty result; columns named like the
result's, in any case, give way, others are kept if asked for. In scripts without spaces ten characters count as a word. A very long
text is cut in memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, importable, materialize
from .common import Box, picked

LEAST = 15
HEAVY, BROADCAST_ROWS = 500, 500_000
CLAUSE = re.compile(r"[^.!?,;:\n]+")
SPANS = "array<struct<start:int,end:int>>"


def units(text: str | None, least: int = LEAST) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit) of the lines of a text and of its runs of clauses."""
    text = text or ""
    clauses = []  # start, end, words, size
    for m in CLAUSE.finditer(text):
        words = m[0].lower().split()
        if words:
            lead, trail = len(m[0]) - len(m[0].lstrip()), len(m[0].rstrip())
            clauses.append((m.start() + lead, m.start() + trail, words, max(len(words), trail // 10)))
    given, end, size = set(), 0, 0
    for i, (start, _, _, own) in enumerate(clauses):
        while end < len(clauses) and size < least:
            size += clauses[end][3]
            end += 1
        if size < least:
            break
        given.add((i, end))
        yield start, clauses[end - 1][1], " ".join(w for c in clauses[i:end] for w in c[2])
        size -= own
    i = 0
    while i < len(clauses):
        stop = text.find("\n", clauses[i][0])
        end, size = i, 0
        while end < len(clauses) and (stop < 0 or clauses[end][0] < stop):
            size += clauses[end][3]
            end += 1
        if size >= least and (i, end) not in given:
            yield clauses[i][0], clauses[end - 1][1], " ".join(w for c in clauses[i:end] for w in c[2])
        i = end


def digests(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, mark (a hash of the text), start, end and the halves of the digest of every unit."""
    importable(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, one, two = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                at = pa.array(row, pa.int32())
                made = [batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
                for x in (row, start, end, one, two):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, ["doc_id", "mark", "start", "end", "h1", "h2"])

            for i, x in enumerate(batch.column("text")):
                for a, b, unit in units(x.as_py(), least):
                    digest = xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))
                    row.append(i)
                    start.append(a)
                    end.append(b)
                    one.append(int.from_bytes(digest[:8], "little", signed=True))
                    two.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(row) >= 100_000:
                    yield flush()
            yield flush()

    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, mark bigint, start int, end int, h1 bigint, h2 bigint")


def united(spans: DataFrame) -> DataFrame:
    """(_id, _mark, removed) of ``spans`` with ``found``, an array of spans: in order, and those that overlap as one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.column("found"):
                start, end = (row.values.field(k).to_numpy() for k in ("start", "end"))
                order = np.lexsort((end, start))
                start, upto = start[order], np.maximum.accumulate(end[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > upto[:-1]
                last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
                made.append([{"start": a, "end": b} for a, b in zip(start[new].tolist(), upto[last].tolist(), strict=True)])
            removed = pa.array(made, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_mark"), removed], ["_id", "_mark", "removed"])

    return spans.select("_id", "_mark", "found").mapInArrow(work, f"_id {dict(spans.dtypes)['_id']}, _mark bigint, removed {SPANS}")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """_id, _mark and the ``removed`` spans of every document of ``docs`` (doc_id, text) that has units to remove."""
    found = materialize(digests(docs, least), "units")
    several = materialize(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    heavy = several.filter(F.col("n") > HEAVY).select("h1")
    few = heavy.count() <= BROADCAST_ROWS
    sides = [(several.filter(F.col("n") <= HEAVY).select("h1"), False), (heavy, few)]
    meet = lambda side, small: F.broadcast(side) if small else side
    shared = [materialize(found.join(meet(side, small), "h1", "left_semi"), "shared") for side, small in sides]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start", F.col("end").alias("end"))
    parts, firsts = [], []
    for own, (_, small) in zip(shared, sides, strict=True):
        first = materialize(own.groupBy("h1", "h2").agg(F.min(rank).alias("first")), "first")
        # Two digests of 128 bits that share 64 of them are all but impossible, so these rows are as few as those of the side.
        parts.append(own.join(meet(first, small), ["h1", "h2"]).filter(rank > F.col("first")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.struct("start", "end").alias("span")))
        firsts.append(first)
    spans = parts[0].unionByName(parts[1]).groupBy("_id", "_mark").agg(F.collect_set("span").alias("found"))
    out = materialize(united(spans), "removed")
    discard(found, several, *shared, *firsts)
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with ``removed``, the spans to cut from the text (empty: none)."""
    found = repeats(picked(docs, doc_id=doc_id, text=text), least)
    box = Box(docs, keep, ["removed"])
    rows = box.rows(_own=box[doc_id], _hash=F.xxhash64(box[text].cast("string")))
    joined = rows.join(found, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left")
    return box.open(joined, removed=F.coalesce("removed", F.array().cast(SPANS)))


def cut(text: Column, removed: Column) -> Column:
    """What is left of a text without its removed spans."""
    bounds = F.concat(F.transform(removed, lambda x: x["end"]), F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(removed, lambda x: x["end"]))
    ends = F.concat(F.transform(removed, lambda x: x["start"]), F.slice(bounds, -1, 1))
    return F.when(F.size(removed) == 0, text).otherwise(F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a)), ""))
