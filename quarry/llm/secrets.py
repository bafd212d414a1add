"""Secret scan with multipart credential linking. DataFrame functions only.

Base spans are certain by their form. Weak candidates (names of users, clients and accounts; bare high-variety
tokens; endpoints) mean little alone. Each belongs to a class (id, secret, endpoint), as do the base spans, and is
reported only if complementary classes stand within ``SCOPE`` code points of it, from the end of the one to the start of the other:

* a weak id needs a secret, a weak secret needs an id or an endpoint, an endpoint needs both an id and a secret.

The scope test is an interval join by buckets of ``SCOPE`` code points: a part lies in every bucket between its start and ``SCOPE`` beyond its
end, parts are reduced to the least start and largest end for each (text, bucket, class), which is all that the test can depend on, and a
candidate meets the other classes of its buckets. So no pairs of parts are made, however many parts one text has.

Texts are scanned where they are read. Only offsets of matches move; they come back to their texts by a broadcast while they are
at most ``BROADCAST_SPANS``, else by a shuffle.

Defined cases: a null text counts as empty and has no spans; repeated rows each get the same spans; an empty table gives
an empty result; other columns of the input are kept as they are, those named like the result's give way.
Columns named like the result's, in any case, give way. Offsets are code points, the end exclusive. A very long text takes memory in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import discard, materialize
from .common import Box

#: Code points between parts that belong together.
SCOPE = 300
#: Spans, and texts that have any, that are broadcast at most.
BROADCAST_SPANS = 500_000
#: Spans that are replaced in one piece of a text.
PIECE = 256
#: Kind, class, pattern, group whose length counts, least length, cheap test that a text may have it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [
    ("assign", "secret", ASSIGN, 2, 8, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    ("access", "id", r"AKIA[A-Z0-9]+", 0, 16, None),
    ("hex", "secret", r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
]
#: The same for the weak kinds.
WEAK = [
    ("id", "id", r"""(?i)\b(?:access_?key_?id|client_?id|account_?id|user_?name|user_?id|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", 1, 3, r"(?i)(?:id|name|user|login|account)[\"']?\x20*[:=]"),
    ("key", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20, r"[A-Za-z0-9+/_-]{20}"),
    ("endpoint", "endpoint", r"""\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s"'<>]+""", 0, 6, None),
]
ORDER = [kind for kind, *_ in BASE + WEAK]
SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,class:string>>"
CUTS = "array<struct<start:bigint,end:bigint>>"
FIELDS = ["start", "rank", "end", "kind", "class"]


def pieces(text: Column, kind: str, pattern: str, group: int, test: str | None) -> Column:
    """What lies before each leftmost match that does not overlap another, the match, and its group: their lengths. Null if the text has none.

    Java's split cuts a text at the very matches that regexp_extract_all returns.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    cut = F.zip_with(F.split(text, pattern, -1), F.zip_with(whole, part, lambda a, b: F.struct(F.length(a).alias("len"), F.length(b).alias("part"))), lambda x, y: F.struct(F.length(x).alias("gap"), y["len"].alias("len"), y["part"].alias("part")))
    may = text.contains({"access": "AKIA", "endpoint": "://"}[kind]) if test is None else text.rlike(test)
    return F.when(may, cut)


def scan(docs: DataFrame) -> DataFrame:
    """Spans of ``docs`` (key, text): key, start, rank, end, kind, class, weak; a weak span that touches a base span is no candidate."""
    kinds = BASE + WEAK
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("key", *[pieces(text, k, pattern, group, test).alias(f"cut{i}") for i, (k, _, pattern, group, _, test) in enumerate(kinds)])
    cut = materialize(cut.filter(F.greatest(*[F.coalesce(F.size(f"cut{i}"), F.lit(0)) for i in range(len(kinds))]) > 1).dropDuplicates(["key"]), "scan")
    tag = lambda i, k, cls, least: F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.lit(cls).alias("class"), F.lit(least).alias("least"), F.lit(i >= len(BASE)).alias("weak"), F.col(f"cut{i}").alias("cut"))
    each = cut.select("key", F.explode(F.array(*[tag(i, k, cls, least) for i, (k, cls, _, _, least, _) in enumerate(kinds)])).alias("t")).select("key", "t.rank", "t.kind", "t.class", "t.least", "t.weak", F.posexplode("t.cut").alias("pos", "x"))
    upto = W.partitionBy("key", "rank").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("x.gap") + F.coalesce("x.len", F.lit(0))).over(upto).cast("bigint")
    found = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("x.len")).filter(F.col("x.part") >= F.col("least")).select("key", *FIELDS, "weak")
    before = W.partitionBy("key").orderBy("start", "weak", "rank").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy("key").orderBy("start", "weak", "rank").rowsBetween(0, W.unboundedFollowing)
    base = lambda c: F.when(~F.col("weak"), F.col(c))
    touched = (F.coalesce(F.max(base("end")).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(base("start")).over(after), F.col("end")) < F.col("end"))
    out = materialize(found.withColumn("touched", touched).filter("not weak or not touched").drop("touched"), "spans")
    discard(cut)
    return out


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``parts`` (key, start, rank, end, kind, class, weak): the weak ones that complementary parts stand by."""
    several = parts.groupBy("key").agg(F.bool_or("weak").alias("any"), F.count_distinct("class").alias("classes")).filter("any and classes > 1").select("key")
    buckets = F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope)))
    placed = parts.join(several, "key", "left_semi").withColumn("bucket", buckets)
    reach = placed.groupBy("key", "bucket", "class").agg(F.min("start").alias("least"), F.max("end").alias("most"))
    near = placed.filter("weak")
    met = near.alias("n").join(reach.alias("r"), (F.col("n.key") == F.col("r.key")) & (F.col("n.bucket") == F.col("r.bucket")) & (F.col("n.class") != F.col("r.class")) & (F.col("r.least") - F.col("n.end") <= scope) & (F.col("n.start") - F.col("r.most") <= scope))
    with_ = met.groupBy("n.key", "n.start", "n.rank", "n.end", "n.kind", "n.class").agg(*[F.bool_or(F.col("r.class") == c).alias(f"by_{c}") for c in ("id", "secret", "endpoint")])
    enough = F.when(F.col("class") == "id", F.col("by_secret")).when(F.col("class") == "secret", F.col("by_id") | F.col("by_endpoint")).otherwise(F.col("by_id") & F.col("by_secret"))
    return with_.filter(enough).select("key", *FIELDS)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans``, arrays of (start, rank, end, kind, class) in text order, and ``cuts``, the stretches (start, end) that all spans cover.

    ``keep``: columns of ``docs`` to return, all by default.
    """
    box = Box(docs, keep, ["base_spans", "all_spans", "cuts"])
    whole = box[text].cast("string")
    own = box[doc_id].cast("string")
    # The length of the id tells where it ends, whatever it holds.
    key = F.md5(F.concat_ws("|", F.coalesce(F.length(own), F.lit(-1)), own, F.coalesce(whole, F.lit(""))).cast("binary"))
    spans = scan(box.docs.select(key.alias("key"), whole.alias("text")))
    linked = link(spans, scope)
    span = F.struct(*FIELDS)
    every = spans.filter("not weak").select("key", F.lit(True).alias("base"), span.alias("s")).unionByName(linked.select("key", F.lit(False).alias("base"), span.alias("s")))
    sorted_ = lambda x: F.array_sort(F.collect_list(x)).cast(SPAN)
    in_order = W.partitionBy("key").orderBy("s.start", "s.end")
    above = F.max("s.end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    opened = every.withColumn("new", F.when(F.col("s.start") <= above, 0).otherwise(1))
    cut = opened.withColumn("at", F.sum("new").over(in_order.rowsBetween(W.unboundedPreceding, 0))).groupBy("key", "at").agg(F.min("s.start").alias("start"), F.max("s.end").alias("end"))
    cuts = cut.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).cast(CUTS).alias("cuts"))
    by_key = every.groupBy("key").agg(sorted_(F.when(F.col("base"), F.col("s"))).alias("base_spans"), sorted_(F.col("s")).alias("all_spans"))
    hits = materialize(by_key.join(cuts, "key"), "hits")
    discard(spans)
    texts, most = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("all_spans")), F.lit(0))).first()
    side = F.broadcast(hits) if texts <= BROADCAST_SPANS and most <= BROADCAST_SPANS else hits
    none = F.array().cast(SPAN)
    joined = box.rows(key=key).join(side, "key", "left")
    return box.open(joined, base_spans=F.coalesce("base_spans", none), all_spans=F.coalesce("all_spans", none), cuts=F.coalesce("cuts", F.array().cast(CUTS)))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, text: str = "text", found: str = "cuts", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the stretches of ``found``, which don't touch and are in order, replaced by ``mark``.

    ``PIECE`` stretches at a time are replaced in the part of the text that they lie in, as to reach a place in a text takes a walk from its start.
    """
    box = Box(docs)
    whole, cuts = box[text], box[found]

    def part(b: Column) -> Column:
        own, lo = F.slice(cuts, b * PIECE + 1, F.lit(PIECE)), F.coalesce(F.get(cuts, b * PIECE - 1)["end"], F.lit(0).cast("bigint"))
        return F.struct(own.alias("own"), lo.alias("lo"), F.substring(whole, (lo + 1).cast("int"), (F.element_at(own, -1)["end"] - lo).cast("int")).alias("body"))

    def replaced(p: Column) -> Column:
        before = lambda i: F.coalesce(F.get(p["own"], i - 1)["end"], p["lo"])
        return F.array_join(F.transform(p["own"], lambda x, i: F.concat(F.substring(p["body"], (before(i) - p["lo"] + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(mark))), "")

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(cuts) - 1) / PIECE).cast("int")), part)
    rest = F.substr(whole, (F.element_at(cuts, -1)["end"] + 1).cast("int"))
    new = F.when(F.size(cuts) > 0, F.concat(F.array_join(F.transform(parts, replaced), ""), rest)).otherwise(whole)
    return box.docs.select(*[(new if i == box.place(text) else F.col(f"c{i}")).alias(n) for i, n in enumerate(box.names)])
