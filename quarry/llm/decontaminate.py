"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Texts become templates: numbers, names (capitalised words within a sentence) and units after a number turn into typed
placeholders, words are lower-cased, all else is dropped; white space of any kind and length is one space. A window with placeholders is
looked for in plain words too, lower-cased, so a verbatim copy is found however it writes its names. Windows of ``WINDOW`` template tokens of every document are
hash-joined to those of the benchmark, so a question whose numbers or names were changed still meets its item.

A document and an item belong together if the windows that met cover at least ``COVER`` of the item's, and their slots
are consistent: equal values of the item stand against equal values in the document. Values that all equal the item's
are a verbatim copy, others a re-parameterised question. Where all windows of a pair together are not consistent, both are
tested per occurrence: among windows whose positions in document and item differ by the same, or nearly the same where
a copy has gained or lost tokens. One occurrence that passes is enough.

An item without a window, as it is shorter or has too few plain words in each, is one window of its own length: its words and
numbers, lower-cased, are looked for as they are in documents, so verbatim copies are found and no others.

Only windows that meet a benchmark window leave their task. The benchmark side is broadcast after its rows and bytes are
counted, up to ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; beyond, Spark joins as it sees fit. The same holds for the documents found.

Defined cases: a null or empty text has no tokens and is clean, an item without any meets nothing; an item of one word is
found wherever the word stands; letters of scripts that put no spaces between words are tokens one by one; repeated rows each get the same result; an empty table of
either kind gives clean documents or none; columns named like the result's, in any case, give way. A very long text makes one row of a
few hundred bytes a token, in the task that reads it. Items with equal text are items of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import Box, picked

WINDOW = 8
COVER = 0.5
#: A window of the benchmark counts if so many of its tokens are words.
LEAST_WORDS = 5
#: Windows of the benchmark, and bytes of their slots, that are broadcast at most; and rows of found documents and their items.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000
#: Units that may follow a number.
UNITS = [
    "mm", "cm", "m", "km", "inch", "inches", "ft", "feet", "yard", "yards", "mile", "miles", "meter", "meters", "metre",
    "metres", "mg", "g", "kg", "gram", "grams", "oz", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "l", "liter",
    "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h",
    "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar",
    "dollars", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh",
]
NUMBER, NAME, UNIT = "0", "@", "%"
#: Letters of scripts without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: Possessive, as a group that can give back recurses once for each turn in the matcher of the JVM.
TOKEN = rf"@?[a-zA-Z[[\p{{L}}\p{{M}}]&&[^{ALONE}]]]++|[[{ALONE}]&&[\p{{L}}]]\p{{M}}*+|[0-9]++(?:[.,:/][0-9]++)*+"
#: White space other than a space.
BLANKS = "\t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before a capitalised word that follows a word or a comma, not the end of a sentence.
NAMED = r"(?=\p{Lu}\p{Ll})(?<=[\p{L}\p{N},;:] )"


def tokens(text: Column) -> Column:
    """Words and numbers of a text; names start with ``@``."""
    bare = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "@" + BLANKS, " " * (len(BLANKS) + 1)), "  ++", " ")
    return F.regexp_extract_all(F.regexp_replace(bare, NAMED, NAME), F.lit(TOKEN), F.lit(0))


def template(raw: Column) -> Column:
    """The typed token of each raw token."""
    number = lambda x: (x >= "0") & (x < ":")
    return F.transform(raw, lambda x, i: F.when(number(x), NUMBER).when(x.startswith(NAME), NAME).when(x.isin(UNITS) & number(F.get(raw, i - 1)), UNIT).otherwise(F.lower(x)))


def windows(rows: DataFrame, text: str, item: bool = False, lengths: Sequence[int] = ()) -> DataFrame:
    """``rows`` without ``text`` but with ``at``, ``hash``, ``slots`` and ``length`` of every window; slots hold null for words.

    A window with slots comes twice, typed and in plain words, without slots then; an item's windows have ``typed``, the hash of the template, both times. Of an ``item`` the windows with enough words, or the whole if there is none (then ``whole``). Of a document all windows, and
    those of the ``lengths`` that whole items have.
    """
    is_slot = lambda x: x.isin(NUMBER, NAME, UNIT)
    keep = [c for c in rows.columns if c != text]
    raw = rows.select(*keep, tokens(F.col(text)).alias("_raw"))
    slotted = raw.withColumn("_typed", template(F.col("_raw"))).withColumn("_slots", F.when(F.exists("_typed", is_slot), F.zip_with("_raw", "_typed", lambda r, t: F.when(is_slot(t), r))))
    own = lambda i: F.slice("_typed", i, WINDOW)
    typed = lambda x: [x.alias("typed")] if item else []
    values = lambda i: F.when(F.exists(F.slice("_slots", i, WINDOW), lambda x: x.isNotNull()), F.slice("_slots", i, WINDOW))

    def starts(n: Column | int) -> Column:
        last = F.size("_typed") - n + 1
        return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))

    def bare(n: Column) -> Callable[[Column], Column]:
        return lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit("whole"), F.slice("_plain", i, n)).alias("hash"), F.lit(None).cast("array<string>").alias("slots"), n.alias("length"), F.lit(True).alias("whole"), *typed(F.xxhash64(F.lit("whole"), F.slice("_plain", i, n))))

    at = starts(WINDOW)
    if item:
        at = F.filter(at, lambda i: F.size(F.filter(own(i), lambda x: ~is_slot(x))) >= LEAST_WORDS)
    made = F.transform(at, lambda i: F.struct(i.alias("at"), F.xxhash64(own(i)).alias("hash"), values(i).alias("slots"), F.lit(WINDOW).alias("length"), F.lit(False).alias("whole"), *typed(F.xxhash64(own(i)))))
    slotted = slotted.withColumn("_plain", F.when(F.col("_slots").isNotNull() | F.lit(item or bool(lengths)), F.transform("_raw", lambda x: F.lower(F.ltrim(x, F.lit(NAME))))))
    # Windows around the slots only, as most have none.
    last = F.size("_typed") - WINDOW + 1
    around = lambda i: F.sequence(F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i, last))
    slots = F.filter(F.sequence(F.lit(1), F.size("_slots")), lambda i: F.get("_slots", i - 1).isNotNull())
    with_slots = F.when(last > 0, F.array_distinct(F.flatten(F.transform(slots, around)))).otherwise(F.array().cast("array<int>"))
    with_slots = F.array_intersect(with_slots, at) if item else with_slots
    plain = F.transform(with_slots, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("_plain", i, WINDOW)).alias("hash"), F.lit(None).cast("array<string>").alias("slots"), F.lit(WINDOW).alias("length"), F.lit(False).alias("whole"), *typed(F.xxhash64(own(i)))))
    made = F.when(F.col("_slots").isNotNull(), F.concat(made, plain)).otherwise(made)
    if item:
        made = F.when((F.size(made) == 0) & (F.size("_raw") > 0), F.array(bare(F.size("_raw"))(F.lit(1)))).otherwise(made)
    for n in lengths:
        made = F.concat(made, F.transform(starts(n), bare(F.lit(n))))
    return slotted.select(*keep, F.inline(made))


def occurrences(diff: Column, span: Column) -> Column:
    """Groups that a match belongs to, by the difference of its positions: those of the very difference, and half-overlapping
    ranges of 4, 16, ... up to twice the item's ``span``, so that a copy which gained or lost tokens lies in one of them."""
    levels = F.sequence(F.lit(0), F.ceil(F.log(4.0, span + 1) + 0.5).cast("int"))
    width = lambda k: F.pow(F.lit(4.0), k)
    group = lambda k, half: F.struct(k.alias("level"), F.lit(half).alias("half"), F.floor((diff + half * F.floor(width(k) / 2)) / width(k)).alias("range"))
    return F.concat(F.transform(levels, lambda k: group(k, 0)), F.transform(F.filter(levels, lambda k: k > 0), lambda k: group(k, 1)))


def tested(met: DataFrame, total: DataFrame, by: list[str], cover: float) -> DataFrame:
    """The ``by`` groups of ``met`` that cover enough of their item: coverage, slots, verbatim, and whether they are consistent."""
    covered = met.groupBy(*by).agg(F.count_distinct("typed").alias("met")).join(total, "item_id").withColumn("coverage", F.col("met") / F.col("total")).filter(F.col("coverage") >= cover)
    both = F.filter(F.arrays_zip(F.col("_theirs").alias("theirs"), F.col("_ours").alias("ours")), lambda x: x["theirs"].isNotNull() & x["ours"].isNotNull())
    pairs = met.filter("_ours is not null and _theirs is not null").select(*by, F.explode(both).alias("pair")).select(*by, "pair.theirs", "pair.ours").distinct()
    slots = pairs.groupBy(*by, "theirs").agg(F.count(F.lit(1)).alias("values"), F.bool_and(F.col("ours") == F.col("theirs")).alias("same"))
    slots = slots.groupBy(*by).agg(F.count(F.lit(1)).alias("slots"), F.max("values").alias("most"), F.bool_and("same").alias("verbatim"))
    joined = covered.alias("c").join(slots.alias("s"), [F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in by], "left")
    made = {"slots": F.coalesce("slots", F.lit(0)), "verbatim": F.coalesce("verbatim", F.lit(True)), "consistent": F.coalesce(F.col("most"), F.lit(1)) == 1}
    return joined.select(*[f"c.{x}" for x in by], "coverage", "span", *[v.alias(k) for k, v in made.items()])


def bounded(side: DataFrame, length: Column) -> DataFrame:
    """``side``, to be broadcast if its rows and the bytes of their ``length`` are few."""
    rows, size = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))).first()
    return F.broadcast(side) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else side


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", cover: float = COVER) -> DataFrame:
    """Pairs of a document and an item: _id, _mark, item_id, coverage, slots, verbatim.

    ``docs`` has _id, _mark and the text. Rows alike in all three are one document here. A pair that is found by occurrences
    has the figures of the one that covers most, a verbatim one first.
    """
    items = materialize(windows(benchmark.select("item_id", F.col("text").alias("_item")), "_item", item=True), "items")
    lengths = sorted(r[0] for r in items.filter("whole").select("length").distinct().collect())
    total = items.groupBy("item_id").agg(F.count_distinct("typed").alias("total"), F.max("at").alias("span"))
    side = items.select("item_id", "hash", "typed", F.col("at").alias("_at"), F.col("slots").alias("_theirs"))
    length = F.aggregate("_theirs", F.lit(0), lambda n, x: n + 16 + F.coalesce(F.octet_length(x), F.lit(0)))
    side = bounded(side, 16 + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + F.coalesce(length, F.lit(0)))
    diff = (F.col("at") - F.col("_at")).alias("diff")
    met = materialize(windows(docs, text, lengths=lengths).join(side, "hash").select("_id", "_mark", "item_id", "typed", diff, F.col("slots").alias("_ours"), "_theirs"), "met")
    pair = ["_id", "_mark", "item_id"]
    whole = materialize(tested(met, total, pair, cover), "whole")
    torn = whole.filter("not consistent").select(*[F.col(x).alias(f"_{x}") for x in pair], "span")
    again = met.join(torn, [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in pair]).withColumn("group", F.explode(occurrences(F.col("diff"), F.col("span"))))
    best = F.max(F.struct("coverage", "verbatim", "slots")).alias("best")
    parts = tested(again.drop("span"), total, [*pair, "group"], cover).filter("consistent").groupBy(*pair).agg(best)
    result = [*pair, "coverage", "slots", "verbatim"]
    return whole.filter("consistent").select(*result).unionByName(parts.select(*pair, "best.*").select(*result))


def mark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (default: all) with contaminated, items (sorted), coverage and reparameterised."""
    box = Box(docs, keep, ["contaminated", "items", "coverage", "reparameterised"])
    whole = box[text].cast("string")
    own = F.xxhash64(F.coalesce(whole, F.lit("")), F.length(whole))
    found = matches(box.docs.select(box[doc_id].alias("_id"), own.alias("_mark"), whole.alias("_text")), picked(benchmark, item_id="item_id", text="text"), "_text")
    hits = materialize(found.groupBy("_id", "_mark").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("coverage").alias("coverage"), F.bool_or(~F.col("verbatim")).alias("reparameterised")), "hits")
    hits = bounded(hits.withColumnsRenamed({"_id": "_hit", "_mark": "_hash"}), 32 + 24 * F.size("items"))
    rows = box.rows(_own=box[doc_id], _mark=own)
    joined = rows.join(hits, F.col("_own").eqNullSafe(F.col("_hit")) & (F.col("_mark") == F.col("_hash")), "left")
    none = F.array().cast(dict(hits.dtypes)["items"])
    return box.open(joined, contaminated=F.col("_hash").isNotNull(), items=F.coalesce("items", none), coverage=F.coalesce("coverage", F.lit(0.0)), reparameterised=F.coalesce("reparameterised", F.lit(False)))
