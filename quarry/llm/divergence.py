"""Which terms set the sources of a language apart, and how far sources are from each other: an audit in whole numbers.

Terms are counted on the executors, a row a term, source and task; those in too few documents of their language go. The rest are dealt into blocks of
about ``BLOCK`` terms a language, and each block is a dense matrix of groups by terms. All pairs of its rows are compared by broadcasting; the partial matrices of pairs are
summed up, and of each group's terms a block hands on the best only, from which the best of all are taken. Languages of more than ``SOURCES``
sources are cut in tiles of sources too, so no tile is larger than two such strips.

With ``N`` occurrences of kept terms and ``V`` kept terms, a term that occurs ``c`` times weighs ``p = 1 + 10**9 * (c + 1) // (N + V)``, and ``f = (p - q) ** 2 // q``.

Defined cases: null texts, languages and sources are empty strings; a group without terms is compared like others, with ``N`` 0; a language without kept terms
has pairs of value 0 and no terms; ties of value go by the bytes of the item; repeated rows are documents of their own; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, importable, materialize
from .common import picked

#: Terms of a block about, sources of a strip at most.
BLOCK, SOURCES = 4096, 128
#: Entries that a task counts before it hands them on, and bytes of a text that are split at once.
HELD, SLICE = 400_000, 1 << 20
#: Groups that are broadcast at most, a row each of two names and a few numbers.
BROADCAST_GROUPS = 20_000
UNIT = 10**9

#: ASCII letters in lower case, all bytes of other characters as they are, the rest as spaces.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, a stretch at a time."""
    folded = text.translate(_FOLDED)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in times.items():
            k, seen = len(own) + 1, docs[lang, source]
            # The row without a term says that the group is there.
            cols = [pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array([*own, None], pa.binary()), pa.array([*own.values(), 0], pa.int64()), pa.array([*[seen[t] for t in own], 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        times.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")], strict=True):
            key = lang.as_py(), source.as_py()
            own, seen = times.setdefault(key, Counter()), docs.setdefault(key, Counter())
            before, once = len(own), set()
            for some in terms(text.as_py()):
                own.update(some)
                once.update(some)
            seen.update(once)
            held += len(own) - before
            if held >= HELD:
                yield from flush()
                held = 0
    yield from flush()


def _weights(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p of counts, exact: in Python's whole numbers where 64 bits are too few."""
    more = counts + 1
    if more.size and int(more.max()) > (2**63 - 1) // UNIT:
        more = more.astype(object)
    return (1 + UNIT * more // size).astype(np.int64)


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _tile(best: int, key: tuple, table: pa.Table) -> pa.Table:
    """Pairs and best terms of a block: rows of part, source, item and value."""
    lang, rows, cols = key[0].as_py(), key[2].as_py(), key[3].as_py()
    empty = table.column("term").is_null()
    heads, cells = table.filter(empty).sort_by("i"), table.filter(pc.invert(empty))
    index, names = heads.column("i").to_numpy(), heads.column("source").to_pylist()
    size, v, whole = heads.column("size").to_numpy(), int(heads.column("v")[0].as_py()), int(heads.column("whole")[0].as_py())
    own = cells.column("term").combine_chunks().dictionary_encode()
    listed = own.dictionary.to_pylist()
    order = sorted(range(len(listed)), key=listed.__getitem__)
    place = np.empty(len(listed), np.int64)
    place[order] = np.arange(len(listed))
    listed = [listed[k] for k in order]
    col = place[own.indices.to_numpy()]
    # Terms of the block that no source of these strips has are alike: one column, which counts as many times.
    times = np.ones(len(listed) + 1, np.int64)
    times[-1] = int(heads.column("terms")[0].as_py()) - len(listed)
    counts, total = np.zeros((len(index), len(times)), np.int64), np.zeros(len(times), np.int64)
    counts[np.searchsorted(index, cells.column("i").to_numpy()), col] = cells.column("n").to_numpy()
    total[col] = cells.column("total").to_numpy()
    p = _weights(counts, np.maximum(size + v, 1)[:, None])
    strip = index // SOURCES
    left, right = np.flatnonzero(strip == rows), np.flatnonzero(strip == cols)
    out: list[tuple] = []
    for a in left.tolist():
        there = (_far(p[a], p[right]) * times).sum(1)
        out += [("pair", names[a], names[b].encode(), x) for b, x in zip(right.tolist(), there.tolist(), strict=True) if a != b]
        if rows != cols:
            back = (_far(p[right], p[a]) * times).sum(1)
            out += [("pair", names[b], names[a].encode(), x) for b, x in zip(right.tolist(), back.tolist(), strict=True)]
    if rows == cols and listed:
        q = _weights(total, np.int64(whole + v))
        for a in left.tolist():
            above = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            far = _far(p[a][above], q[above])
            top = np.argsort(-far, kind="stable")[:best]  # terms are in the order of their bytes
            out += [("term", names[a], listed[t], x) for t, x in zip(above[top].tolist(), far[top].tolist(), strict=True)]
    part, source, item, value = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table({"part": pa.array(part, pa.string()), "lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "item": pa.array(item, pa.binary()), "value": pa.array(value, pa.int64())})


def _block() -> Column:
    return F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")


def audit(docs: DataFrame, least: int = 3, best: int = 200) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: all other sources of the language, and the ``best`` terms above their share in the language.

    ``least``: documents of a language that a term needs.
    """
    importable(docs.sparkSession)
    rows = picked(docs, lang="lang", source="source", text="text")
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term binary, n bigint, docs bigint")
    counts = materialize(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    kept = materialize(kept, "kept")
    known = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "known")

    groups = counts.filter("term is null").select("lang", "source")
    sums = known.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    each = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("whole"))
    zero = F.lit(0).cast("bigint")
    by_lang = W.partitionBy("lang")
    heads = groups.join(sums, ["lang", "source"], "left").join(each, "lang", "left").select(
        "lang", "source", F.coalesce("size", zero).alias("size"), F.coalesce("v", zero).alias("v"), F.coalesce("whole", zero).alias("whole"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).alias("i"), F.count(F.lit(1)).over(by_lang).alias("sources"),
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK)).cast("int")
    strips = F.ceil(F.col("sources") / SOURCES).cast("int")
    heads = materialize(heads.withColumn("blocks", blocks).withColumn("strips", strips).withColumn("strip", F.floor(F.col("i") / SOURCES).cast("int")), "groups")

    langs = heads.filter("i = 0").select("lang", "blocks")
    # As many rows as blocks.
    terms_of = kept.join(langs, "lang").groupBy("lang", _block().alias("block")).agg(F.count(F.lit(1)).alias("terms"))
    few = heads.select("lang", "source", "i", "blocks", "strips", "strip")
    few = F.broadcast(few) if heads.count() <= BROADCAST_GROUPS else few
    cells = known.join(few, ["lang", "source"]).withColumn("block", _block())
    cells = cells.select("lang", "block", "strip", "strips", "i", F.lit(None).cast("string").alias("source"), "term", "n", "total", *[zero.alias(c) for c in ("size", "v", "whole", "terms")])
    shared = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(terms_of, ["lang", "block"], "left").withColumn("terms", F.coalesce("terms", zero))
    shared = shared.select("lang", "block", "strip", "strips", "i", "source", F.lit(None).cast("binary").alias("term"), *[zero.alias(c) for c in ("n", "total")], "size", "v", "whole", "terms")
    dealt = cells.unionByName(shared).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    dealt = dealt.withColumns({"rows": F.least("strip", "other"), "cols": F.greatest("strip", "other")}).drop("strip", "strips", "other")

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        return _tile(best, key, table)

    made = dealt.groupBy("lang", "block", "rows", "cols").applyInArrow(tile, "part string, lang string, source string, item binary, value bigint")
    made = materialize(made.groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value")), "tiles")
    discard(counts, kept, known, heads)
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = made.filter("part = 'pair'").withColumn("rank", rank)
    best_terms = made.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= best)
    return pairs.unionByName(best_terms).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", F.col("rank").cast("int").alias("rank"))
