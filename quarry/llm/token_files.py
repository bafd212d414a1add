"""Token ids of documents in files of shards, each shard compressed by a grammar of pairs (Re-Pair) and open to random access.

``write`` sorts documents by id over range partitions, encodes them with a public tokenizer and cuts the ids of a partition into shards of at most
``SHARD`` ids. In a shard the pairs of neighbouring symbols that are most frequent become nonterminals, round by round, until a round saves
little. A shard keeps its rules, the number of ids that each of them stands for, and the rest of the sequence, so that a stretch of ids is decoded from the
symbols that cover it. The files are Parquet, a row a shard, so Spark's own commit guards them: a lost executor costs a partition.

    part     number of the range partition; parts follow each other in the order of ids
    shard    number within the part
    n        ids in the shard
    docs     what it holds, in order: number of the document in its part, doc_id, ids here, whether it begins and ends here
    grammar  ``MAGIC``, then as little-endian unsigned 32-bit integers: first nonterminal, number of rules, length of the body, ids; two symbols for each
             rule; ids for each rule; the body

Defined cases: a null or empty text is the end id alone; null ids come last; rows of one id are ordered by the hash of their text, then as they are read; equal rows are
documents of their own; a document of more than ``SHARD`` ids lies in several shards; an empty table gives files without shards.
Columns other than doc_id and text don't matter.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import importable
from .common import picked

MAGIC = b"RPG1"
#: Ids of a shard at most.
SHARD = 1 << 18
#: A pair is frequent from so many occurrences on; so many pairs become rules in a round at most; a round that saves a smaller share is the last.
LEAST, TOP, GAIN = 8, 4096, 0.03
#: Id that ends each document.
END = 0
#: From so many distinct pieces on a worker remembers those of its last texts only, and none of more bytes than this; bytes of text that are encoded at once.
REMEMBERED, LONGEST, AT_ONCE = 1_000_000, 64, 16_000_000
#: Distinct pieces in a text that is given to the library, such texts in a call, and pieces whose ids are copied at once.
JOINED, CALLED, SOME = 1000, 32, 1 << 16


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Whether a byte lies in one of the ranges, both ends included."""
    return np.array([any(a <= x <= b for a, b in ranges) for x in range(256)])


#: Bytes that are a letter or digit, or a printable ASCII character other than the space.
_WORD, _PRINTED = _bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)), _bytes((0x21, 0x7E))
#: First bytes of two and three, of characters that are white space in no version of Unicode.
_TWO, _THREE = _bytes((0xC3, 0xDF)), _bytes((0xE0, 0xE0), (0xE4, 0xED))
_FIRST = _PRINTED | _TWO | _THREE


def _closed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is certainly no white space."""
    last, two, three = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return _PRINTED[last] | (last >= 0x80) & (_TWO[two] | _THREE[three])


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 of texts, one after another, that begin and end at ``offsets``.

    With tokenizers of the usual pattern a token begins there whatever is around: at white space that follows other characters, after a line break
    between such characters, and at a full stop or comma that follows a letter or digit. Pieces give the same ids alone as in their text.
    """
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    white = np.flatnonzero((data == 0x20) | (data == 0x0A))
    white = white[_closed(data, white)]
    begins[white] = True
    lines = white[data[white] == 0x0A]
    lines = lines[_FIRST[data[np.minimum(lines + 1, len(data) - 1)]]]
    begins[lines + 1] = True
    marks = np.flatnonzero((data == 0x2E) | (data == 0x2C))
    begins[marks[_WORD[data[marks - 1]]]] = True
    return np.flatnonzero(begins[:-1])


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts in a row, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _strung(flat: np.ndarray, at: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` in a row: the numbers in ``which`` say which, ``at`` and ``size`` where they lie. Some at a time, so that little memory is held."""
    out, done = np.empty(int(size[which].sum()), flat.dtype), 0
    for some in (which[i : i + SOME] for i in range(0, len(which), SOME)):
        own = size[some]
        ends = np.cumsum(own)
        n = int(ends[-1])
        out[done : done + n] = flat[np.repeat(at[some] - ends + own, own) + np.arange(n)]
        done += n
    return out


class Encoder:
    """Ids of texts. Texts are cut where the tokenizer cuts them for certain, and of many at once each distinct piece is encoded once; those of the last are remembered.

    Tokenizers that are not byte-level ones of the usual pattern encode texts whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        known = json.loads(self.tokenizer.to_str())
        how, added = known.get("pre_tokenizer") or {}, known.get("added_tokens") or []
        self.cuts = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and not known.get("normalizer")
        # An added token must not go across a cut.
        self.cuts = self.cuts and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"[\s.,]", x["content"]) for x in added)
        names = self.tokenizer.get_vocab()
        #: Bytes of each token: a byte is a character of its name.
        self.bytes = np.zeros(max(names.values(), default=0) + 1, np.int64)
        self.bytes[list(names.values())] = [len(x) for x in names]
        for x in added:
            self.bytes[x["id"]] = len(x["content"].encode())
        self.pieces = pa.array([], pa.binary())
        self.flat, self.size = np.empty(0, "<u4"), np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.whole(pieces)
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row and how many each has: many in one call, as a token begins where white space follows the piece before.

        The bytes that tokens stand for tell where pieces begin in the ids.
        """
        data, offsets = _parts(pieces)
        cut = [*offsets[:-1:JOINED].tolist(), len(data)]
        found = [np.empty(0, "<u4")]
        for some in (cut[i : i + CALLED + 1] for i in range(0, len(cut) - 1, CALLED)):
            texts = [data[a:b].tobytes().decode() for a, b in pairwise(some)]
            found += [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(found)
        ends = np.append(0, np.cumsum(self.bytes[flat]))
        at = np.searchsorted(ends, offsets)
        if ends[-1] != len(data) or (ends[at] != offsets).any():
            return self._each([x.decode() for x in pieces.to_pylist()])
        return flat, np.diff(at)

    def _learned(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces in a row and how many each has."""
        data, offsets = _parts(pieces)
        first, closed = data[offsets[:-1]], _closed(data, offsets[1:])
        spaced, bare = closed & (first == 0x20), closed & _FIRST[first]
        # After a line break, which is a token of its own, stand the pieces that follow no space.
        lined = pc.binary_join_element_wise(pa.scalar(b"\n"), pieces.filter(pa.array(bare)), pa.scalar(b"", pa.binary()))
        with_break, size = self._joined(lined)
        breaks = np.zeros(len(with_break), bool)
        breaks[np.cumsum(size) - size] = True
        rest = [x.decode() for x in pieces.filter(pa.array(~spaced & ~bare)).to_pylist()]
        made = [self._joined(pieces.filter(pa.array(spaced))), (with_break[~breaks], size - 1), self._each(rest)]
        order = np.argsort(np.concatenate([np.flatnonzero(x) for x in (spaced, bare, ~spaced & ~bare)]))
        flat, size = (np.concatenate(x) for x in zip(*made, strict=True))
        return _strung(flat, np.cumsum(size) - size, size, order), size[order]

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, ``END`` after each, and how many each has with it."""
        if not self.cuts:
            found = self.whole(texts.to_pylist())
            end = np.array([END], "<u4").tobytes()
            return np.frombuffer(b"".join(x + end for x in found), "<u4"), np.array([len(x) // 4 + 1 for x in found], np.int64)
        data, offsets = _parts(texts)
        starts = _cuts(data, offsets)
        places = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(data)])
        # What is remembered has the first numbers, what is new the others.
        old = len(self.pieces)
        numbered = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        codes, self.pieces = numbered.indices.to_numpy()[old:], numbered.dictionary
        flat, size = self._learned(self.pieces.slice(old))
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        at = np.cumsum(self.size) - self.size
        # The end id is one more piece.
        flat, at, size = np.append(self.flat, np.uint32(END)), np.append(at, len(self.flat)), np.append(self.size, 1)
        last = np.searchsorted(starts, offsets[1:])
        codes = np.insert(codes, last, len(self.pieces))
        ends = np.append(0, np.cumsum(size[codes]))[last + np.arange(1, len(last) + 1)]
        out = _strung(flat, at, size, codes)
        stay = np.diff(_parts(self.pieces)[1]) <= LONGEST
        if len(stay) > REMEMBERED:
            used = np.zeros(len(size), bool)
            used[codes] = True
            stay &= used[:-1]
        if not stay.all():
            kept = np.flatnonzero(stay)
            self.pieces, self.flat, self.size = self.pieces.take(pa.array(kept)), _strung(flat, at, size, kept), size[kept]
        return out, np.diff(ends, prepend=0)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, without the end id."""
        flat, size = self.encoded(pa.array(texts, pa.string()))
        ends = np.cumsum(size).tolist()
        return [flat[b - n : b - 1].tobytes() for b, n in zip(ends, size.tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker: what it has learned serves its next tasks."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _spread(keys: np.ndarray) -> np.ndarray:
    """Slots of 16 bits."""
    if keys.dtype == np.uint32:
        return keys * np.uint32(2654435769) >> np.uint32(16)
    return keys * np.uint64(11400714819323198485) >> np.uint64(48)


def _round(seq: np.ndarray, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that a round replaces, most frequent first, left and right symbols, and the sequence with nonterminals from ``new`` on in their places.

    Where occurrences overlap, the more frequent pair goes first and, in a run of one symbol, every other place is taken. Symbols of 16 bits make keys of 32.
    """
    none = np.int32(TOP)
    half = 16 if seq.dtype == np.uint16 else 32
    wide = np.uint32 if half == 16 else np.uint64
    keys = seq[:-1].astype(wide) << wide(half) | seq[1:]
    ranked = np.sort(keys)
    ends = np.append(np.flatnonzero(ranked[1:] != ranked[:-1]), len(ranked) - 1)
    counts = np.diff(ends, prepend=-1)
    pairs, counts = ranked[ends][counts >= LEAST], counts[counts >= LEAST]
    pairs = pairs[np.argsort(-counts, kind="stable")[:TOP]]
    # Ranks by a table of hashes; of pairs that share a slot the most frequent has it, others wait for a later round.
    slots, table, ranks = _spread(pairs), np.zeros(1 << 16, wide), np.full(1 << 16, none)
    table[slots[::-1]], ranks[slots[::-1]] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
    at = _spread(keys)
    rank = ranks[at]
    rank[table[at] != keys] = none
    best = rank < none
    best[1:] &= rank[1:] <= rank[:-1]
    best[:-1] &= rank[:-1] <= rank[1:]
    places = np.flatnonzero(best)
    # Neighbouring places have one pair, of one symbol twice: a run, of which every other place is taken.
    starts = np.append(True, np.diff(places) > 1)[: len(places)]
    if not starts.all():
        number = np.arange(len(places))
        places = places[(number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0]
    used = np.bincount(rank[places], minlength=len(pairs)) > 1
    places = places[used[rank[places]]]
    number = np.cumsum(used) - 1
    out, stay = seq.copy(), np.ones(len(seq), bool)
    out[places], stay[places + 1] = new + number[rank[places]], False
    pairs = pairs[used]
    return pairs >> wide(half), pairs & wide((1 << half) - 1), out[stay]


def compress(ids: np.ndarray) -> bytes:
    """A shard's grammar."""
    base = int(ids.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    seq, spans = ids, np.ones(base, np.int64)
    while len(seq) > 1:
        seq = seq.astype(np.uint16 if len(spans) + TOP <= 1 << 16 else np.uint32)
        left, right, shorter = _round(seq, len(spans))
        saved = len(seq) - len(shorter)
        if not saved:
            break
        rules.append(np.stack([left, right], 1).astype("<u4"))
        spans = np.concatenate([spans, spans[left] + spans[right]])
        seq = shorter
        if saved < GAIN * len(ids):
            break
    parts = np.concatenate([np.empty((0, 2), "<u4"), *rules])
    head = struct.pack("<4s4I", MAGIC, base, len(parts), len(seq), len(ids))
    return head + parts.tobytes() + spans[base:].astype("<u4").tobytes() + seq.astype("<u4").tobytes()


class Grammar:
    """A shard that is read."""

    def __init__(self, data: bytes) -> None:
        magic, self.base, n_rules, n_body, self.n = struct.unpack_from("<4s4I", data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        own = np.frombuffer(data, "<u4", offset=struct.calcsize("<4s4I"))
        self.rules, self.spans, self.body = own[: 2 * n_rules].reshape(-1, 2), own[2 * n_rules : 3 * n_rules], own[3 * n_rules : 3 * n_rules + n_body]
        # Ids of every symbol in one array: terminals stand for themselves, rules follow.
        spans = self.spans.astype(np.int64)
        self.size = np.concatenate([np.ones(self.base, np.int64), spans])
        self.at = np.concatenate([np.arange(self.base), self.base + np.cumsum(spans) - spans])
        self.flat = np.concatenate([np.arange(self.base, dtype=np.uint32), self._unfolded(np.arange(self.base, self.base + n_rules, dtype=np.uint32))])
        self.ends: np.ndarray | None = None

    def _unfolded(self, symbols: np.ndarray) -> np.ndarray:
        while (inner := symbols >= self.base).any():
            width = inner + np.int64(1)
            at = np.cumsum(width) - width
            out = np.empty(int(width.sum()), np.uint32)
            out[at[~inner]] = symbols[~inner]
            halves = self.rules[symbols[inner] - self.base]
            out[at[inner]], out[at[inner] + 1] = halves[:, 0], halves[:, 1]
            symbols = out
        return symbols

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.at[symbols] - ends + size, size) + np.arange(total)]

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        """``n`` ids from ``start`` on; only the symbols that cover them are expanded."""
        if start == 0 and n in (None, self.n):
            return self._expand(self.body)
        n = self.n - start if n is None else n
        if self.ends is None:
            self.ends = np.cumsum(self.size[self.body])
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, start + n, "left")
        skip = start - (int(self.ends[first - 1]) if first else 0)
        return self._expand(self.body[first : last + 1])[skip : skip + n]


def _shards(path: str, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned, part = encoder(path), TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    docs: list[tuple] = []
    size = shard = number = 0
    fields = pa.struct([("d", pa.int64()), ("doc_id", kind), ("n", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())])

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, shard
        if size:
            listed = [dict(zip(("d", "doc_id", "n", "first", "last"), x, strict=True)) for x in docs]
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([listed], pa.list_(fields)), pa.array([compress(np.concatenate(held))], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["part", "shard", "n", "docs", "grammar"])
            shard += 1
        held.clear()
        docs.clear()
        size = 0

    def some() -> Iterator[tuple[list, pa.Array]]:
        ids, texts, length = [], [], 0
        for batch in batches:
            every = batch.column("text").cast(pa.string()).fill_null("")
            ends, at = np.cumsum(pc.binary_length(every).to_numpy().astype(np.int64)), 0
            while at < len(every):
                begun = int(ends[at - 1]) if at else 0
                to = min(len(every), int(np.searchsorted(ends, begun + AT_ONCE - length)) + 1)
                ids += batch.column("doc_id").slice(at, to - at).to_pylist()
                texts.append(every.slice(at, to - at))
                length, at = length + int(ends[to - 1]) - begun, to
                if length >= AT_ONCE:
                    yield ids, pa.concat_arrays(texts)
                    ids, texts, length = [], [], 0
        if texts:
            yield ids, pa.concat_arrays(texts)

    for ids, texts in some():
        found, sizes = learned.encoded(texts)
        ends = np.cumsum(sizes).tolist()
        for doc_id, begun, n in zip(ids, [0, *ends], sizes.tolist(), strict=False):
            if size + n > SHARD:
                yield from flush()
            for at in range(0, n, SHARD):
                piece = found[begun + at : begun + min(n, at + SHARD)]
                held.append(piece)
                docs.append((number, doc_id, len(piece), at == 0, at + SHARD >= n))
                size += len(piece)
                if at + SHARD < n:
                    yield from flush()
            number += 1
    yield from flush()
    pa.default_memory_pool().release_unused()  # the worker waits for its next task


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encodes ``docs`` (doc_id, text) with the tokenizers library's file ``tokenizer`` and writes the shards to the folder ``path``."""
    importable(docs.sparkSession)
    rows = picked(docs, doc_id="doc_id", text="text").withColumn("text", F.col("text").cast("string"))
    # The last column deals out the rows of one id and text, if they are many.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc(), F.col("_tie").asc()]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    kind = dealt.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    schema = f"part int, shard int, n bigint, docs array<struct<d: bigint, doc_id: {kind.simpleString()}, n: bigint, first: boolean, last: boolean>>, grammar binary"
    dealt.mapInArrow(lambda batches: _shards(tokenizer, arrow, batches), schema).write.parquet(path)


def _join(head: int, tail: int, n: int) -> int:
    """crc32 of two stretches of bytes in a row from their own; the second has ``n`` bytes."""
    blank = bytes(min(n, 1 << 20))
    moved, zero, left = head, 0, n
    while left:
        step = blank[: min(left, len(blank))]
        moved, zero, left = zlib.crc32(step, moved), zlib.crc32(step, zero), left - len(step)
    return moved ^ zero ^ tail


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, listed, data in zip(batch.column("part"), batch.column("shard"), batch.column("docs"), batch.column("grammar"), strict=True):
            docs, ids = listed.values, Grammar(data.as_py()).ids().astype("<u4")
            sizes = docs.field("n").to_numpy()
            ends, raw = np.cumsum(sizes) * 4, memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[a - 4 * n : a]) for a, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            k = len(docs)
            own = [pa.array([part.as_py()] * k, pa.int32()), pa.array([shard.as_py()] * k, pa.int32()), *[docs.field(f) for f in ("d", "doc_id", "n", "first", "last")], pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(own, ["part", "shard", "d", "doc_id", "n", "first", "last", "crc"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone: each shard is decoded.

    ``start`` counts the ids of all documents before; parts are summed up first, so only a row a part meets in one task.
    """
    importable(spark)
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    digests = lambda some: some.select("part", "shard", "docs", "grammar").mapInArrow(_digests, f"part int, shard int, d bigint, doc_id {kind}, n bigint, first boolean, last boolean, crc bigint")

    def joined(rows):
        rows = rows.sort_values("shard")
        crc = 0
        for own, n in zip(rows["crc"], rows["n"], strict=True):
            crc = _join(crc, int(own), 4 * int(n))
        one = rows.head(1)[["part", "d", "doc_id"]].copy()
        one["n"], one["crc"] = int(rows["n"].sum()), crc
        return one

    plain = ["part", "d", "doc_id", "n", "crc"]
    pieces = digests(files.filter(F.exists("docs", lambda x: ~(x["first"] & x["last"])))).filter("not (first and last)")
    torn = pieces.groupBy("part", "d").applyInPandas(joined, f"part int, d bigint, doc_id {kind}, n bigint, crc bigint")
    docs = digests(files).filter("first and last").select(*plain).unionByName(torn.select(*plain))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = W.partitionBy("part").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    placed = docs.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
    return placed.select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """part, d, doc_id, place and ids of the documents whose doc_id is in ``wanted``, by random access: of a shard only their stretches are decoded.

    A row a piece, ``place`` counts the pieces of a document; those of up to ``SHARD`` ids have one. Null ids are never found.
    """
    importable(spark)
    files = spark.read.parquet(path)
    kind = files.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    before = F.transform("docs", lambda x, i: F.struct(x["d"].alias("d"), x["doc_id"].alias("doc_id"), x["n"].alias("n"), F.aggregate(F.slice("docs", F.lit(1), i), F.lit(0).cast("bigint"), lambda s, y: s + y["n"]).alias("at")))
    index = files.select("part", "shard", F.explode(before).alias("x")).select("part", "shard", "x.*")
    asked = index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("part", "shard").agg(F.collect_list(F.struct("d", "doc_id", "n", "at")).alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, listed, data in zip(*[batch.column(c) for c in ("part", "shard", "asked", "grammar")], strict=True):
                grammar, docs = Grammar(data.as_py()), listed.values
                ids = [grammar.ids(a, n).astype(np.int32) for a, n in zip(docs.field("at").to_pylist(), docs.field("n").to_pylist(), strict=True)]
                k = len(docs)
                own = [pa.array([part.as_py()] * k, pa.int32()), docs.field("d"), docs.field("doc_id"), pa.array([shard.as_py()] * k, pa.int32()), pa.array(ids, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(own, ["part", "d", "doc_id", "place", "ids"])

    return files.select("part", "shard", "grammar").join(asked, ["part", "shard"]).mapInArrow(work, f"part int, d bigint, doc_id {kind}, place int, ids array<int>")
