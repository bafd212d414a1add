"""Mixing sources to target weights by entropy balancing. DataFrame functions only.

A document ``i`` of base rate ``b`` and ``size`` words is to be used ``r_i`` times. The rates minimise the relative entropy to
the base rates, each document counting alike, under one constraint a source: the words used equal the target, and no
rate exceeds ``cap``. The convex dual has one multiplier a source and the optimum is the exponential tilt
``r_i = min(cap, b_i * exp(lambda_source * size_i))``: a source that has to grow takes its long documents more often, one that
has to shrink takes them less. Newton steps on the logarithm of the words used find the multipliers, from 0 on; a step reads
sums only, and one that leaves the range in which the multiplier must be halves that range instead.

Rates are alike within a cell (source, size, base rate), so copies are rounded a cell at a time, with the error
carried from size to size and the rest of a source soaked up by its best fitting cells, and then dealt to the
documents of the cell by hash, in chunks of ``CHUNK`` rows: a cell with a third of all rows is no single task.

Defined cases: a null or blank text has size 0 and is taken 0 words; null sources form one source, ranked last; repeated
rows are documents of their own; an empty table gives an empty result; base rates that are null, no number or not above 0 count
as 0: such documents are never taken and their words count neither for sizes nor for targets; columns of the input other than those named are ignored. Sources are compared by code point, and ordered in
one task, a row a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, materialize
from .common import Box, word_count

#: Rows that one task orders at a time when a cell's copies are dealt out.
CHUNK = 256
#: Times that what is left of a source's target is given to its best fitting cells; at first only rounding may turn.
STRICT, PASSES = 2, 5


def source_targets(cells: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source of ``cells`` (skey, size, n): its size and target.

    Targets share all words by weight; a target stops at ``cap`` times its source's size and what it leaves is
    shared again by weight. The level at which this ends is found on the sources ordered by cap over weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cells.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    every = W.partitionBy(F.lit(0))
    ranked = sources.withColumns({
        "weight": F.get(cycle, (F.row_number().over(W.partitionBy(F.lit(0)).orderBy("skey")) - 1) % len(weights)),
        "total": F.sum("source_size").over(every).cast("double"),
    }).withColumn("most", cap * F.col("source_size"))
    before = W.partitionBy(F.lit(0)).orderBy(F.col("most") / F.col("weight"), "skey").rowsBetween(W.unboundedPreceding, -1)
    levels = ranked.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    fits = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.struct(F.col("most") / F.col("weight"), "skey", "level"))
    level = F.min(fits).over(every)["level"]
    return levels.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("skey", "source_size", "target")


def solve_tilts(cells: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, most_steps: int = 60) -> tuple[DataFrame, int]:
    """Multipliers ``lam`` of the dual, a row a source, and the steps it took: ``cells`` is (skey, size, base, n), ``targets`` has a target per skey.

    A step is one grouped sum over the executors and writes one row a source; only whether all are settled comes to the driver. A source
    whose target is all that the cap allows has the multiplier at which every rate is capped.
    """
    own = cells.filter("size > 0 and base > 0 and n > 0")
    words = F.col("n") * F.col("size").cast("double")
    ends = own.groupBy("skey").agg(F.sum(words * F.col("base")).alias("free"), F.sum(words).alias("words"), F.min("size").alias("least"), F.min("base").alias("low"))
    state = targets.join(ends, "skey").filter("target > 0").select(
        "skey", "target", F.when(F.col("target") >= cap * F.col("words") * (1 - 1e-12), F.log(F.lit(float(cap)) / F.col("low")) / F.col("least")).otherwise(0.0).alias("lam"),
        F.least(F.log(F.col("target") / F.col("free")) / F.col("least"), F.lit(0.0)).alias("lo"), F.greatest(F.log(F.lit(float(cap)) / F.col("low")) / F.col("least"), F.lit(0.0)).alias("hi"),
    )
    state = materialize(state, "tilt")
    for step in range(most_steps):
        rate = F.col("base") * F.exp(F.col("lam") * F.col("size"))
        moved = own.join(state.select("skey", "target", "lam", "lo", "hi"), "skey").groupBy("skey").agg(
            *[F.first(c).alias(c) for c in ("target", "lam", "lo", "hi")], F.sum(words * F.least(rate, F.lit(float(cap)))).alias("got"),
            F.sum(F.when(rate < cap, words * F.col("size") * rate).otherwise(0.0)).alias("slope"),
        )
        open_ = (F.abs(F.col("target") - F.col("got")) > tolerance * F.col("target")) & (F.col("slope") > 0)
        lo, hi = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") + F.log(F.col("target") / F.col("got")) * F.col("got") / F.col("slope")
        after = F.when((newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        bounded = moved.withColumn("open", open_).withColumn("lo", lo).withColumn("hi", hi)
        found = materialize(bounded.select("skey", "target", F.when(F.col("open"), after).otherwise(F.col("lam")).alias("lam"), "lo", "hi", "open"), "tilt")
        discard(state)
        state = found
        if not found.filter("open").limit(1).count():
            break
    return state.select("skey", "lam"), step + 1


def round_cells(cells: DataFrame, cap: float) -> DataFrame:
    """Copies of each cell (skey, size, base, n, rate, target), near n * rate and near the target for each source.

    The windows hold the distinct sizes and base rates of one source, which longer documents bound, not more of them.
    """
    by_size = W.partitionBy("skey").orderBy("size", "base").rowsBetween(W.unboundedPreceding, 0)
    own = W.partitionBy("skey")
    wish = F.col("n") * F.col("rate")
    done = cells.withColumn("wish", wish).withColumn("run", F.sum("wish").over(by_size))
    done = done.withColumn("copies", F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("wish") + 0.5))
    for i in range(PASSES):
        # Positive: words are missing, cells rounded down may gain a copy. Negative: cells rounded up may lose one.
        # Then any cell may, as the few words that are left by now are worth less than a copy of most cells.
        done = done.withColumn("short", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own))
        wish = F.col("wish") if i < STRICT else F.lit(None).cast("double")
        more = (F.col("copies") < F.coalesce(wish, F.col("copies") + 1)) & (F.col("copies") < cap * F.col("n"))
        less = (F.col("copies") > F.coalesce(wish, F.col("copies") - 1)) & (F.col("copies") > 0)
        free = F.when(F.col("short") > 0, more).otherwise(less) & ((F.col("base") > 0) | (F.col("short") < 0))
        done = done.withColumn("part", F.when(free & (F.col("size") > 0) & (F.col("size") <= F.abs("short")), F.col("size")).otherwise(0))
        upto = W.partitionBy("skey").orderBy(F.desc("part"), F.desc("size"), "base").rowsBetween(W.unboundedPreceding, 0)
        taken = (F.col("part") > 0) & (F.sum("part").over(upto) <= F.abs("short"))
        done = done.withColumn("copies", F.col("copies") + F.when(taken, F.signum("short")).otherwise(0.0))
    return done.withColumn("copies", F.col("copies").cast("long")).drop("wish", "run", "short", "part")


def entropy_balance(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", base_rate: Column | None = None,
) -> DataFrame:
    """Rate and whole copies of every document: doc_id, source, size, source_size, target, rate, copies, taken.

    ``base_rate`` prefers documents before the mix; by default all have 1. Each pair of size and base rate of a
    source is a cell, and a window holds the cells of one source, so base rates should be grades rather than measurements.
    """
    box = Box(docs.select("*", (F.lit(1.0) if base_rate is None else base_rate).cast("double")), [])
    given = F.col(f"c{len(docs.columns)}")
    base = F.when((given > 0) & ~F.isnan(given), given).otherwise(0.0)
    own = box[source].cast("string")
    key = F.when(own.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), own))
    sized = materialize(box.docs.select(box[doc_id].alias("doc_id"), own.alias("source"), key.alias("skey"), word_count(box[text].cast("string")).alias("size"), base.alias("base")), "sized")
    cells = materialize(sized.groupBy("skey", "size", "base").agg(F.count(F.lit(1)).alias("n")), "cells")
    targets = materialize(source_targets(cells.filter("base > 0"), weights, cap), "targets")
    tilts, _ = solve_tilts(cells, targets, cap)
    # Base 0 first: 0 times a tilt beyond all doubles is no number.
    rate = F.when(F.col("base") > 0, F.least(F.lit(float(cap)), F.col("base") * F.exp(F.coalesce("lam", F.lit(0.0)) * F.col("size")))).otherwise(0.0)
    sums = {"source_size": F.coalesce("source_size", F.lit(0).cast("bigint")), "target": F.coalesce("target", F.lit(0.0))}
    rated = cells.join(targets, "skey", "left").withColumns(sums).join(tilts, "skey", "left").withColumn("rate", rate)
    rounded = round_cells(rated, cap).select("skey", "size", "base", "n", "rate", "copies", "source_size", "target")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK), F.lit(1))
    mark = F.xxhash64(F.col("doc_id").cast("string"), F.lit(9))
    dealt = sized.join(rounded, ["skey", "size", "base"]).withColumns({"mark": mark, "chunks": chunks}).withColumn("chunk", F.pmod("mark", "chunks"))
    # Dealt by chunk, as else the windows below would stay where the join has put a whole cell.
    dealt = dealt.repartition("skey", "size", "base", "chunk")
    chunk = W.partitionBy("skey", "size", "base", "chunk")
    extra = F.col("copies") - F.floor(F.col("copies") / F.col("n")) * F.col("n")
    dither = F.pmod(F.xxhash64("skey", "size", "base", "chunk"), F.lit(1 << 20)) / float(1 << 20)
    mine = F.when(F.col("chunks") == 1, extra).otherwise(F.floor(F.count(F.lit(1)).over(chunk) * extra / F.col("n") + dither))
    rank = F.row_number().over(chunk.orderBy(F.xxhash64("mark"), "doc_id"))
    got = (F.floor(F.col("copies") / F.col("n")) + (rank <= mine).cast("long")).cast("long")
    return dealt.select("doc_id", "source", "size", "source_size", "target", "rate", got.alias("copies"), (got * F.col("size")).alias("taken"))
