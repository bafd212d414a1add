"""Language identification by cross-parsing entropy.

A suffix automaton is built from labelled text of each language. A text is parsed, left to right, into the longest
phrases that occur in a language's sample; a phrase names a place in the sample, which takes log2(sample size) bits.
The language whose sample needs the fewest bits a character wins.

The samples are bounded: of each language at most ``SAMPLE_DOCS`` documents, lowest hash of the id first, and ``SAMPLE_CHARS``
characters, the document that goes beyond them cut. All letters of all samples are told apart; a letter that a language's sample
lacks is a phrase of its own. The automata are laid into one table, row over row where their moves leave room, and workers parse
many pieces of text side by side, a character a step. A text's pieces are then joined exactly: the phrase that a piece cuts is followed into
the next one up to a place where both ways of parsing begin a phrase, from where on they are the same. A text without such a place
is parsed as a whole.

Text is lower-cased and runs of anything but letters are one space. Defined cases: a null text, or one without a letter, is
``und`` with score 0, as is every text if no document is labelled; ties go to the language first by code point; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import importable
from . import labelled
from .common import picked

SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
#: Characters of a piece, which sets the speed and not the result, and characters that a worker parses at once.
PIECE = 256
BLOCK = 1_000_000
#: Places that are tried for the moves of a state.
TRIES = 16
SPACE, OTHER, BREAK = 0, 1, 2


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Moves of the suffix automaton of ``codes``: state 0 is the empty phrase."""
    moves, links, sizes = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(moves)
        moves.append({})
        links.append(0)
        sizes.append(sizes[last] + 1)
        at = last
        while at != -1 and c not in moves[at]:
            moves[at][c] = new
            at = links[at]
        if at != -1:
            to = moves[at][c]
            if sizes[to] == sizes[at] + 1:
                links[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                links.append(links[to])
                sizes.append(sizes[at] + 1)
                while at != -1 and moves[at].get(c) == to:
                    moves[at][c] = copy
                    at = links[at]
                links[to] = links[new] = copy
        last = new
    return moves


def laid(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves of all states in one table: ``base`` of each state, and of each place the state that owns it and the target, in one number.

    The move of state s for code c is at base[s] + c if s owns that place. States with most moves are placed first, where all
    their codes fall on free places, after a few tries behind all others; the many states of one move then fill the gaps.
    """
    size = 2 * sum(map(len, rows)) + 2 * width
    owner, target, base = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(len(rows), np.int64)
    near, free, top = width, width, width  # where to try, the first place that may be free, the end of what is taken
    for state in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
        codes = np.fromiter(rows[state], np.int64, len(rows[state]))
        if len(codes) == 1:
            while owner[free] >= 0:
                free += 1
            at = free - int(codes[0])
        elif len(codes):
            at = near - int(codes.min())
            for _ in range(TRIES):
                if (owner[at + codes] < 0).all():
                    break
                at += 1
            else:
                at = top - int(codes.min())
            near = at + int(codes.min())
        else:
            continue
        base[state] = at
        owner[at + codes], target[at + codes] = state, list(rows[state].values())
        top = max(top, at + int(codes.max()) + 1)
        if top + 2 * width + TRIES > len(owner):
            owner, target = np.concatenate([owner, np.full(size, -1, np.int64)]), np.concatenate([target, np.zeros(size, np.int64)])
    return base, owner << 32 | target


class CrossParser:
    """Languages' automata as one table; fields are plain arrays, so it travels to workers as it is."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        alphabet = sorted({ch for lang in self.langs for ch in samples[lang].lower() if ch.isalpha()})
        self.letters = {ord(ch): i + 3 for i, ch in enumerate(alphabet)}
        self.width = len(alphabet) + 3
        self.lookup: np.ndarray | None = None
        rows: list[dict[int, int]] = []
        self.bits, roots = [], []
        for lang in self.langs:
            codes, _ = self.encode([samples[lang]])
            moves = automaton(codes)
            roots.append(len(rows))
            rows += [{c: to + roots[-1] for c, to in own.items()} for own in moves]
            self.bits.append(np.log2(max(len(codes), 2)))
        self.roots = np.array(roots, np.int64)
        #: Of each language and code: where a phrase that begins with the code leads, or the root if the sample lacks it.
        self.begins = np.repeat(self.roots[:, None], self.width, axis=1)
        for i, root in enumerate(roots):
            for c, to in rows[root].items():
                self.begins[i, c] = to
            rows[root] = {}  # at a root every code begins a phrase, as where a move is lacking
        self.base, self.moves = laid(rows, self.width)
        self.lookup = None
        self.lists: tuple | None = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one after the other, and the text that each code is of."""
        if self.lookup is None:
            table = np.fromiter((OTHER if chr(c).isalpha() else SPACE for c in range(0x110000)), np.int32, 0x110000)
            for c, code in self.letters.items():
                table[c] = code
            table[0] = BREAK
            self.lookup = table
        joined = "\0".join(x.replace("\0", " ") for x in texts).lower()
        codes = self.lookup[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not len(codes):
            return codes, np.zeros(0, np.int64)
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        codes = codes[keep]
        of = np.cumsum(codes == BREAK)
        own = codes != BREAK
        return codes[own], of[own]

    def step(self, state: np.ndarray, code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the phrase goes on with the ``code``, and the state after it; ``begin`` is the state if a phrase begins with it."""
        found = self.moves.take(self.base.take(state) + code)
        on = found >> 32 == state
        return on, np.where(on, found & 0xFFFFFFFF, begin)

    def side_by_side(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The ranges of ``codes``, longest first, parsed each from its beginning: for each place the ranges that reach it, where phrases go on and the states (language, range)."""
        state = np.repeat(self.roots[:, None], len(begin), axis=1)
        shorter = -length
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(shorter, -t, side="left"))
            code = codes[begin[:live] + t]
            on, state[:, :live] = self.step(state[:, :live], code, self.begins.take(code, axis=1))
            yield live, on, state

    def phrases(self, codes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Phrases of each of ``n`` texts for each language: an array of languages by texts."""
        langs = len(self.langs)
        sizes = np.bincount(of, minlength=n)
        first = np.cumsum(sizes) - sizes
        pieces = -(-sizes // PIECE)
        text = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, length = first[text] + nth * PIECE, np.minimum(PIECE, sizes[text] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        on = np.ones((min(PIECE, int(sizes.max(initial=0))), langs, len(begin)), bool)  # beyond its end a range goes on
        last = np.zeros((langs, len(begin)), np.int64)
        for t, (live, goes, last) in enumerate(self.side_by_side(codes, begin[order], length[order])):
            on[t, :, :live] = goes
        each = len(on) - on.sum(axis=0)[:, place]
        # The phrase that the end of a piece cuts goes on: what begins up to the place where both ways meet is counted anew.
        own = np.flatnonzero(nth > 0)
        lang, own = np.repeat(np.arange(langs), len(own)), np.tile(own, langs)
        state, at = last[lang, place[own - 1]], np.zeros(len(own), np.int64)
        torn = np.zeros((langs, n), bool)
        while len(own):
            code = codes[begin[own] + at]
            goes, state = self.step(state, code, self.begins[lang, code])
            went = on[at, lang, place[own]]
            each[lang, own] += went.astype(np.int64) - goes
            at += 1
            met, end = ~goes & ~went, at == length[own]
            torn[lang[end & ~met], text[own[end & ~met]]] = True
            rest = ~met & ~end
            lang, own, state, at = lang[rest], own[rest], state[rest], at[rest]
        out = np.zeros((langs, n), np.int64)
        np.add.at(out, (slice(None), text), each)
        for i, j in zip(*np.nonzero(torn), strict=True):
            out[i, j] = self.one_by_one(codes[first[j] : first[j] + sizes[j]], i)
        return out

    def one_by_one(self, codes: np.ndarray, lang: int) -> int:
        """Phrases of a text whose pieces never meet, as where it repeats itself: plain steps, which take no longer for one text than many do side by side."""
        if self.lists is None:
            self.lists = self.base.tolist(), self.moves.tolist(), self.begins.tolist()
        base, moves, begins = self.lists[0], self.lists[1], self.lists[2][lang]
        state, n = int(self.roots[lang]), 0
        for code in codes.tolist():
            found = moves[base[state] + code]
            if found >> 32 == state:
                state = found & 0xFFFFFFFF
            else:
                state = begins[code]
                n += 1
        return n

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        codes, of = self.encode([x or "" for x in texts])
        letters = np.bincount(of[codes != SPACE], minlength=n)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        cost = self.phrases(codes, of, n) * np.array(self.bits)[:, None]
        best = cost.argmin(axis=0)
        with np.errstate(under="ignore"):
            score = 1 / np.exp2(-np.minimum(cost - cost.min(axis=0), 1000)).sum(axis=0)
        return [self.langs[i] if k else "und" for i, k in zip(best, letters, strict=True)], np.where(letters > 0, score, 0.0)


def sample(known: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Text of each language of ``known`` (doc_id, text, lang), within the bounds above."""
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("mark", F.xxhash64("text"))
    # At most ``docs`` rows a language; texts are fetched for those alone.
    ids = labelled.lowest(known.select("doc_id", F.col("lang").alias("label"), "mark"), docs, "mark").select(F.col("doc_id").alias("_id"), "label", F.col("mark").alias("_mark"), "rank")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")) & (F.col("lang") == F.col("label"))
    rows = known.join(F.broadcast(ids), same).groupBy("lang", "rank").agg(F.any_value("text").alias("text"))
    upto = W.partitionBy("lang").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    room = F.lit(chars) - F.coalesce(F.sum(F.length("text")).over(upto), F.lit(0))
    fit = rows.withColumn("room", room).filter("room > 0").select("lang", "rank", F.expr("left(text, int(room))").alias("text"))
    out: dict[str, list[tuple[int, str]]] = {}
    for row in fit.collect():
        out.setdefault(row["lang"], []).append((row["rank"], row["text"]))
    return {lang: " ".join(text for _, text in sorted(texts)) for lang, texts in out.items()}


def identify(docs: DataFrame, learn_from: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred and score of every text of ``docs``; labels are read only where ``learn_from`` holds."""
    importable(docs.sparkSession)
    known = picked(docs.filter(learn_from), doc_id=doc_id, text=text, lang=lang).withColumns({"text": F.col("text").cast("string"), "lang": F.col("lang").cast("string")})
    model = docs.sparkSession.sparkContext.broadcast(CrossParser(sample(known)))
    rows = picked(docs, doc_id=doc_id, text=text).withColumn("text", F.col("text").cast("string"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = model.value
        for batch in batches:
            edges = np.cumsum(batch["text"].str.len().fillna(0).to_numpy()) // BLOCK
            for _, part in batch.groupby(edges, sort=False):
                langs, score = parser.classify([x if isinstance(x, str) else None for x in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "lang_pred": langs, "score": score})

    return rows.mapInPandas(parse, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")
