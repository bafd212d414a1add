"""Near duplicates by BagMinHash signatures, banding and an exact check.

A text is the multiset of its windows of five words. Its signature has ``BANDS * ROWS`` registers, filled by
Poisson processes over the weights: a window of weight w owns the dyadic pieces [0,1), [1,2), [2,4), ... of [0, w); each piece has a
process of points in time, of the rate of the piece's width, drawn from a hash of window and piece. A point falls on a
register and on a weight, counts if the weight is below w, and a register keeps its earliest point. Processes run only until no
register can gain, so long texts take little more than a point a window. Two registers agree with the probability of
the weighted Jaccard similarity.

Texts of the same words are one node. Nodes that share a band are candidates:

1. in every band each node meets the least one; pairs whose registers agree enough are checked on the words themselves, and
   those of similarity ``SIMILARITY`` or more are linked;
2. in bands where several components are left, the nodes meet in blocks of ``BLOCK`` by ``BLOCK``: first by signature, which
   leaves the nodes that agree enough with one of another component, then by their windows, with the overlap of all pairs of a block
   from products of slices of its incidence matrix. A block returns the links that join its components, no more than it has
   nodes; pairs themselves are never rows, and pairs within a component are not looked for, as they cannot change the classes.

Classes are the connected components, so a class is never lost to the order of texts, and a bucket of any
size is dealt out in blocks.

Defined cases: a null or blank text is a class of its own row; a text of fewer than five words is one window of all its words;
repeated rows and repeated texts share a class; a null id takes part and ``class_id``, the least id of a class, passes over it (null if
a class has no other); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, importable, materialize
from .common import Box, picked
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 6
REGISTERS = BANDS * ROWS
#: Registers' share that must agree before texts are compared: four standard errors below SIMILARITY.
AGREE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Rows and bytes of a block, and columns of a slice of its matrix.
BLOCK, BYTES, SLICE = 256, 4_000_000, 4096
#: Rows of two numbers that are broadcast at most; beyond, Spark joins as it sees fit.
BROADCAST_ROWS = 1_000_000
#: Windows that a worker works on at once, and words it remembers.
AT_ONCE, MEMO = 250_000, 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits (public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of the word windows of a text."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def word(self, word: bytes) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def windows(self, text: str | None) -> tuple[np.ndarray, int]:
        """Hashes of all windows, in order, and a hash of the words together."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            return np.zeros(0, np.uint64), 0
        ids = np.fromiter(map(self.word, words), np.uint64, len(words))
        n = max(len(ids) - WORDS + 1, 1)
        out = np.full(n, min(len(ids), WORDS), np.uint64)
        for k in range(min(WORDS, len(ids))):
            out = mix(out + ids[k : k + n])
        return out, xxhash.xxh3_64_intdigest(b" ".join(words))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Registers (float32) of bags, each given as distinct hashes and their weights."""
    sizes = [len(h) for h, _ in bags]
    element = np.concatenate([h for h, _ in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([w for _, w in bags]).astype(np.float64) if bags else np.zeros(0)
    of = np.repeat(np.arange(len(bags)), sizes)
    parts = [(element, of, np.zeros(len(of)), np.ones(len(of)), weight)]
    low = 1.0
    while (more := weight > low).any():
        seed = mix(element[more] ^ mix(np.array([low]).view(np.uint64)))
        parts.append((seed, of[more], np.full(more.sum(), low), np.full(more.sum(), low), weight[more]))
        low *= 2
    seed, of, start, width, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    registers = np.full(len(bags) * REGISTERS, np.inf)
    time, drawn = np.zeros(len(seed)), 0
    while len(seed):
        k = int(np.clip(AT_ONCE // len(seed) // 4, 1, 64))
        steps = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
        first = mix(seed[:, None] + steps)
        second = mix(first + np.uint64(0x9E3779B97F4A7C15))
        gaps = -np.log(((first >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        gaps[:, 0] += time
        at = np.cumsum(gaps, axis=1)
        register = of[:, None] * REGISTERS + (second >> np.uint64(32)).astype(np.int64) % REGISTERS
        placed = start[:, None] + width[:, None] * ((second & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight[:, None]
        np.minimum.at(registers, register[placed], at[placed])
        drawn += k
        time = at[:, -1]
        live = time < registers.reshape(-1, REGISTERS).max(axis=1)[of]
        seed, of, start, width, weight, time = (x[live] for x in (seed, of, start, width, weight, time))
    return registers.reshape(-1, REGISTERS).astype(np.float32)


def digest(registers: np.ndarray) -> np.ndarray:
    """16 bits of each register: two that differ look alike once in 65,536 times."""
    return (mix(registers.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash of each band, which tells bands apart."""
    bits = registers.view(np.uint32).astype(np.uint64).reshape(len(registers), BANDS, ROWS)
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(registers), 1))
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, k])
    return out.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), node (a hash of the words, null without words), sig and bands of every text."""
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts, begin = batch.column("text"), 0
            while begin < len(texts):
                bags, nodes, total, end = [], [], 0, begin
                while end < len(texts) and total < AT_ONCE:
                    hashes, node = hasher.windows(texts[end].as_py())
                    values, counts = np.unique(hashes, return_counts=True)
                    bags.append((values, counts))
                    nodes.append(np.uint64(node).astype(np.int64) if len(hashes) else None)
                    total += len(values) + REGISTERS
                    end += 1
                made = signatures(bags)
                keys = bands(made)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, end - begin), batch.column("mark").slice(begin, end - begin), pa.array(nodes, pa.int64()),
                     pa.array([x.tobytes() if n is not None else None for x, n in zip(digest(made), nodes, strict=True)], pa.binary()),
                     pa.array([x.tolist() if n is not None else None for x, n in zip(keys, nodes, strict=True)], pa.list_(pa.int64()))],
                    ["doc_id", "mark", "node", "sig", "bands"])
                begin = end

    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, mark bigint, node bigint, sig binary, bands array<bigint>")


def agreeing(pairs: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b, sig_a, sig_b) whose registers agree enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            keep = pa.array((one == two).mean(axis=1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(keep)

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(compare, "a bigint, b bigint")


def similarity(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """Sizes of overlap and union of two multisets of hashes."""
    a, n = np.unique(one, return_counts=True)
    b, m = np.unique(two, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both, len(one) + len(two) - both


def bags(texts: DataFrame) -> DataFrame:
    """(node, bag, bytes): the windows of each text of ``texts`` (node, text), as bytes of sorted hashes, and how many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [np.sort(hasher.windows(x.as_py())[0]).tobytes() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary()), pa.array([len(x) for x in made], pa.int64())], ["node", "bag", "bytes"])

    return texts.select("node", "text").mapInArrow(work, "node bigint, bag binary, bytes bigint")


def checked(pairs: DataFrame, bagged: DataFrame, least: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose multisets of windows are ``least`` similar."""
    joined = pairs.join(bagged.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bagged.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True):
                both, union = similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                keep.append(both >= least * union - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a bigint, b bigint")


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the overlaps of all multisets of ``one`` with all of ``two``: hashes, sorted.

    The k-th of equal hashes is an element of its own, so the least of two counts is a sum of products. Columns of the incidence
    matrix are taken SLICE at a time.
    """
    every = one + two
    hashes = np.concatenate(every)
    row = np.repeat(np.arange(len(every)), [len(x) for x in every])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(hashes)), 0))
    element = mix(hashes + (np.arange(len(hashes)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(two)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        own = slice(*np.searchsorted(column, [low, low + SLICE]))
        matrix = np.zeros((len(every), SLICE), np.float32)
        matrix[row[own], column[own] - low] = 1
        out += matrix[: len(one)] @ matrix[len(one) :].T
    return out


def _blocks(members: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of blocks of each bucket, and the table they read: ``members`` (key, node, component) in blocks of BLOCK rows or BYTES at most, about.

    ``payloads`` has a payload and its bytes for each node; it moves once, when blocks are known. A component of half a block or more has blocks of
    its own, which don't meet each other; smaller ones share blocks. Blocks are paired by name first, and each pair is a row that any task may take,
    so a bucket of any size is spread over all tasks.
    """
    sized = members.join(payloads.select("node", "bytes"), "node").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    large = F.col("n") >= BLOCK // 2
    sized = sized.select("key", "component", "n", "bytes", large.alias("large"), F.when(large, F.col("component")).otherwise(F.lit(0)).alias("group"))
    totals = sized.groupBy("key", "large", "group").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.sum("bytes") / BYTES)).alias("blocks"))
    # Dealt anew after grouping, so that the joins are plain ones, whose hot keys Spark splits.
    place = sized.hint("rebalance").join(totals.hint("rebalance"), ["key", "large", "group"]).select("key", "component", "large", "group", "blocks")
    block = F.struct("large", "group", F.pmod(F.xxhash64("node", F.lit(8)), F.col("blocks")).alias("chunk"))
    rows = members.join(place.hint("rebalance"), ["key", "component"]).select("key", "node", "component", block.alias("block"))
    rows = rows.join(payloads.select("node", "payload"), "node")
    made = materialize(rows.groupBy("key", "block").agg(F.collect_list(F.struct("node", "component", "payload")).alias("rows")), "blocks")
    names = [made.select("key", F.col("block").alias(f"block_{side}")) for side in "ab"]
    one, two = F.col("block_a"), F.col("block_b")
    pairs = names[0].join(names[1], "key").filter((one < two) & ~(one["large"] & two["large"] & (one["group"] == two["group"])))
    for side in "ab":
        pairs = pairs.join(made.select("key", F.col("block").alias(f"block_{side}"), F.col("rows").alias(f"rows_{side}")), ["key", f"block_{side}"])
    # Most buckets are one block, which meets itself where it is.
    alone = made.filter(~F.col("block.large")).select("key", F.col("rows").alias("rows_a"), F.lit(None).cast(dict(made.dtypes)["rows"]).alias("rows_b"))
    return alone.unionByName(pairs.select("key", "rows_a", "rows_b")), made


def _sides(row: dict, kind: type) -> tuple:
    """Nodes, components and payloads of the two blocks of a row; without a second one the first meets itself."""
    out = []
    for rows in (row["rows_a"], row["rows_b"] or row["rows_a"]):
        out += [np.array([x[c] for x in rows], np.int64) for c in ("node", "component")]
        out.append([np.frombuffer(x["payload"], kind) for x in rows])
    return tuple(out)


def across(members: DataFrame, nodes: DataFrame, bagged: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between nodes of different components of a bucket. ``members``: (key, node, component)."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                a, ca, sa, b, cb, sb = _sides(row, np.uint16)
                sb = np.stack(sb)
                left, right = np.zeros(len(a), bool), np.zeros(len(b), bool)
                for i in range(len(a)):
                    hit = (cb != ca[i]) & ((sb == sa[i]).mean(axis=1) >= AGREE)
                    left[i] = hit.any()
                    right |= hit
                found = np.unique(np.concatenate([a[left], b[right]]))
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "node"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                a, ca, wa, b, cb, wb = _sides(row, np.uint64)
                both = overlaps(wa, wb)
                union = np.array([len(x) for x in wa])[:, None] + np.array([len(x) for x in wb])[None, :] - both
                i, j = np.nonzero((both >= least * union - 1e-9) & (ca[:, None] != cb[None, :]))
                above: dict[int, int] = {}

                def top(x: int) -> int:
                    while above.setdefault(x, x) != x:
                        above[x] = above[above[x]]
                        x = above[x]
                    return x

                left, right = [], []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    one, two = top(int(ca[x])), top(int(cb[y]))
                    if one != two:
                        above[max(one, two)] = min(one, two)
                        left.append(int(a[x]))
                        right.append(int(b[y]))
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    pairs, made = _blocks(members, nodes.select("node", F.col("sig").alias("payload"), F.lit(2 * REGISTERS).alias("bytes")))
    close = materialize(pairs.mapInArrow(agree, "key bigint, node bigint").distinct(), "close")
    discard(made)
    pairs, made = _blocks(members.join(close, ["key", "node"], "left_semi"), bagged.select("node", F.col("bag").alias("payload"), "bytes"))
    found = materialize(pairs.select("rows_a", "rows_b").mapInArrow(join, "a bigint, b bigint"), "links")
    discard(close, made)
    return found


def _small(side: DataFrame) -> DataFrame:
    """``side``, to be broadcast if it has few rows, so that texts are not shuffled to meet it."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of the class), class_size, mark (a hash of the text) and component of every row of ``docs``.

    ``component`` tells classes apart and is null for texts without words, which are alone.
    """
    importable(docs.sparkSession)
    docs = picked(docs, doc_id=doc_id, text=text)
    signed = materialize(sign(docs), "signed")
    nodes = materialize(signed.filter("node is not null").groupBy("node").agg(F.min("mark").alias("mark"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialize(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1"), "shared")
    met = materialize(buckets.join(shared, "key"), "met")
    sigs = nodes.select("node", "sig")
    sided = lambda pairs: pairs.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b").join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a")
    stars = met.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(agreeing(sided(stars)), "stars")
    meeting = met.select("node").distinct()
    needed = nodes.join(meeting, "node", "left_semi").select("node", "mark")
    whole = docs.select(F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").alias("text"))
    needed = materialize(needed, "needed")
    texts = whole.join(_small(needed), "mark").groupBy("node").agg(F.any_value("text").alias("text"))
    bagged = materialize(bags(texts), "bags")
    links = materialize(checked(stars, bagged, least), "links")
    found = materialize(components(links), "components")
    placed = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("key")
    members = materialize(placed.join(several, "key", "left_semi").select("key", "node", "component"), "members")
    more = across(members, nodes, bagged, least)
    final = materialize(components(links.union(more)), "components")
    discard(nodes, shared, met, stars, needed, bagged, links, found, members, more)
    classed = signed.select("doc_id", "mark", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")
    sizes = classed.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    out = classed.join(sizes.hint("rebalance"), "component", "left")
    one = F.coalesce("class_size", F.lit(1)) == 1
    return out.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "mark", "component")


def one_of_each(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the least id, once; texts without words all stay."""
    key = lambda c: F.coalesce(F.xxhash64(c.cast("string")), F.lit(0))
    rows = classes.filter("component is not null").groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "times")).alias("first")
    chosen = rows.groupBy("component").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"), F.col("first.times").alias("_times"))
    chosen = materialize(chosen.withColumn("_key", key(F.col("_id"))), "chosen")
    box = Box(docs)
    whole = box[text].cast("string")
    blank = ~F.coalesce(whole.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    own = box.rows(_own=box[doc_id], _key=key(box[doc_id]), _mark=F.xxhash64(whole), _blank=blank)
    met = own.join(_small(chosen), ["_key", "_mark"], "left").withColumn("_hit", F.col("_times").isNotNull() & F.col("_own").eqNullSafe(F.col("_id")))
    kept = met.filter(F.col("_blank") | (F.col("_hit") & (F.col("_times") == 1)))
    if not chosen.filter("_times > 1").limit(1).count():
        return box.open(kept)
    # Only rows that are repeated as they are need to come together.
    again = met.filter(~F.col("_blank") & F.col("_hit") & (F.col("_times") > 1)).groupBy("_key", "_mark").agg(F.any_value("row").alias("row"))
    return box.open(kept.select("row").unionByName(again.select("row")))
