"""URL filter: rules first, then a tree of path templates per host, judged by the labels that its urls bear.

1. A url's host and path are cut out; of the rules that fit, the longest decides.
2. Per host, paths become templates: segments that are variable by form (numbers, dates, long hex) turn into ``*``, then, level by
   level, the children of a node turn into ``*`` if they are many for the distinct paths below it; repeats of a url change nothing.
3. Branches of a host with the same shape merge if their shares of blocked labels do not differ from the pooled share by
   more than ``Z`` standard errors. A branch without labels joins the merged ones of its shape if they are ``AGREE`` or more and the mean length of its paths
   does not differ from theirs by more than ``Z`` standard errors.
4. Purity is smoothed level by level: a node's is (blocked + M * that of its parent) / (labelled + M), the root's parent has the share of all labels. A template's own labels,
   or those it has joined, are smoothed by its parent node in the same way. It is rejected if its purity reaches ``PURITY`` and these labels are ``LEAST`` or more.
5. A template that has no labels and has joined none has the purity of the nearest node with any. That alone rejects it only if ``AGREE`` templates or more below that node have labels, all of them pure:
   one bad branch says nothing of its neighbours. Labels are those given, by default the urls that a rule decides.

Counts are grouped sums of (host, template); no task reads the rows of a host together, and at most AT_ONCE distinct paths of a node.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is allowed; repeated rows each get the same
verdict; a host without labels has no purity and nothing of it is rejected; an empty table gives an empty result; columns of the
input named like the result's, in any case, give way, the others are kept. Paths of any length and depth are read whole; the
tree takes rows in proportion to the segments of its templates.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable, materialize
from .common import Box

#: Rules as (verdict, host, path).
RULES = [
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
]
#: A node's children turn into a wildcard if they are at least MANY and at least VARIED of the distinct paths below it.
MANY, VARIED = 20, 0.2
#: Distinct paths below a node that one task generalises to the end; nodes with more go down a level a round.
AT_ONCE = 50_000
M, PURITY, LEAST, Z = 5.0, 0.8, 5, 1.96
#: Labelled templates that must agree before they speak for one without labels.
AGREE = 3
#: Forms of segments that vary from page to page. Possessive, as other groups recurse in the matcher of the JVM.
VARIABLE = r"^(?:[0-9]+|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F]{12,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4,12}+)++|[A-Za-z_-]*[0-9]{3,}[A-Za-z0-9_-]*)(?:\.[A-Za-z0-9]{1,5})?$"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def by_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Segments of a path, variable ones by form as ``*``."""
    own = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.transform(own, lambda x: F.when(x.rlike(VARIABLE), F.lit("*")).otherwise(x))


def varied(children: int | Column, paths: int | Column) -> bool | Column:
    return (children >= MANY) & (children >= VARIED * paths)


def generalised(paths: list[list[str]]) -> list[list[str]]:
    """``paths`` below one node with the varied children of every node below as ``*``, from the top down."""
    out: list[list[str]] = [[] for _ in paths]
    todo = [(list(range(len(paths))), 0)]
    while todo:
        here, level = todo.pop()
        if len(here) < MANY:
            for i in here:
                out[i] += paths[i][level:]
            continue
        children = defaultdict(list)
        for i in here:
            if len(paths[i]) > level:
                children[paths[i][level]].append(i)
        if varied(len(children), len(here)):
            children = {"*": [i for own in children.values() for i in own]}
        for seg, own in children.items():
            for i in own:
                out[i].append(seg)
            todo.append((own, level + 1))
    return out


def wildcards(paths: DataFrame) -> DataFrame:
    """(host, sid, made) of ``paths`` (host, sid, segs): the segments with every node's varied children as ``*``.

    What stands below a wildcard is told apart only after its branches have become one, so nodes are decided from the top down. A node
    of fewer than MANY paths has nothing to decide, one of up to AT_ONCE is a group for one task, larger ones go on with their children.
    """
    importable(paths.sparkSession)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        below = generalised([x.tolist() for x in group["rest"]])
        return pd.DataFrame({"host": group["host"], "sid": group["sid"], "made": [[*a, *b] for a, b in zip(group["made"], below, strict=True)]})

    state, done = paths.select("host", "sid", F.array().cast("array<string>").alias("made"), F.col("segs").alias("rest")), []
    while True:
        sizes = state.groupBy("host", "made").agg(F.count(F.lit(1)).alias("paths"))
        sized = materialize(state.join(sizes, ["host", "made"]), "nodes")
        done.append(sized.filter(F.col("paths") < MANY).select("host", "sid", F.concat("made", "rest").alias("made")))
        middle = sized.filter((F.col("paths") >= MANY) & (F.col("paths") <= AT_ONCE)).select("host", "made", "sid", "rest")
        done.append(middle.groupBy("host", "made").applyInPandas(finish, "host string, sid string, made array<string>"))
        large = sized.filter(F.col("paths") > AT_ONCE)
        if not large.limit(1).count():
            break
        done.append(large.filter(F.size("rest") == 0).select("host", "sid", "made"))
        seg = F.get("rest", F.lit(0))
        on = large.filter(F.size("rest") > 0)
        children = on.select("host", "made", seg.alias("seg")).distinct().groupBy("host", "made").agg(F.count(F.lit(1)).alias("children"))
        step = F.when(varied(F.col("children"), F.col("paths")), F.lit("*")).otherwise(seg)
        state = materialize(on.join(children, ["host", "made"]).select("host", "sid", F.concat("made", F.array(step)).alias("made"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest")), "level")
    return materialize(reduce(DataFrame.unionByName, done), "templates")


def prefixes(templates: DataFrame) -> DataFrame:
    """(host, tid, depth, node) of every node from the root down to each of ``templates`` (host, tid, made); ``node`` is a hash of the way."""
    importable(templates.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, made in enumerate(batch.column("made")):
                way, nodes = xxhash.xxh3_64(), [0]
                for seg in made.as_py():
                    way.update(f"{seg}/".encode("utf-8", "surrogatepass"))
                    nodes.append(way.intdigest())
                own = pa.array(np.zeros(len(nodes), np.int32))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("host").take(own), one.column("tid").take(own), pa.array(np.arange(len(nodes), dtype=np.int32)), pa.array(np.array(nodes, np.uint64).view(np.int64))], ["host", "tid", "depth", "node"])

    return templates.select("host", "tid", "made").mapInArrow(work, "host string, tid string, depth int, node bigint")


def judge(templates: DataFrame) -> DataFrame:
    """host, tid, labels, purity and reject of ``templates`` (host, tid, made, n, chars, squares, blocked, allowed), after like branches have merged.

    ``chars`` and ``squares`` are sums of path lengths and of their squares; ``tid`` tells the templates of a host apart. What is joined by host is written first, so that Spark can
    split hosts of many templates.
    """
    shape = F.md5(F.array_join(F.transform("made", lambda x: F.when(x == "*", x).otherwise(F.lit("w"))), "/").cast("binary"))
    rows = materialize(templates.withColumn("shape", shape).withColumn("labelled", F.col("blocked") + F.col("allowed")), "templates")
    labelled = rows.filter("labelled > 0").drop("made")
    pooled = labelled.groupBy("host", "shape").agg((F.sum("blocked") / F.sum("labelled")).alias("share"))
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / F.col("labelled"))
    tested = labelled.join(pooled, ["host", "shape"]).withColumn("alike", F.abs(F.col("blocked") / F.col("labelled") - F.col("share")) <= Z * error + 1e-12)
    merged = tested.withColumn("branch", F.when(F.col("alike"), F.lit("merged")).otherwise(F.col("tid")))
    sums = merged.groupBy("host", "shape", "branch").agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l"), F.count(F.lit(1)).alias("branches"), *[F.sum(c).alias(f"_{c}") for c in ("n", "chars", "squares")])
    sums = materialize(sums, "branches")
    own = merged.join(sums, ["host", "shape", "branch"]).select("host", "tid", "b", "l")
    own = materialize(own.unionByName(joined(rows, sums)), "labels")
    prior = rows.agg((F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0))).alias("prior"))

    nodes = prefixes(rows.select("host", "tid", "made")).join(rows.select("host", "tid", F.size("made").alias("depth_of"), "blocked", "labelled"), ["host", "tid"])
    nodes = materialize(nodes.join(own, ["host", "tid"], "left"), "nodes")
    pure = (F.col("b") >= PURITY * F.col("l")).cast("int")
    below = nodes.filter("labelled > 0").groupBy("host", "node").agg(F.sum("blocked").alias("nb"), F.sum("labelled").alias("nl"), F.count(F.lit(1)).alias("templates"), F.sum(pure).alias("pure"))
    below = materialize(below, "below")
    way = nodes.join(below, ["host", "node"]).groupBy("host", "tid", "depth_of", "b", "l").agg(F.array_sort(F.collect_list(F.struct("depth", "nb", "nl", "templates", "pure"))).alias("way"))
    way = way.join(F.broadcast(prior), how="cross")  # one row
    smoothed = lambda x, until: F.aggregate(F.filter(x, lambda v: v["depth"] < until), F.col("prior"), lambda p, v: (v["nb"] + p * M) / (v["nl"] + M))
    last = F.element_at("way", -1)
    agreed = F.when((last["templates"] >= AGREE) & (last["pure"] == last["templates"]), last["nl"]).otherwise(F.lit(0))
    purity = F.when(F.col("l").isNull(), smoothed("way", F.col("depth_of") + 1)).otherwise((F.col("b") + smoothed("way", F.col("depth_of")) * M) / (F.col("l") + M))
    found = way.select("host", "tid", F.coalesce("l", agreed).alias("labels"), purity.alias("purity"))
    return found.withColumn("reject", (F.col("purity") >= PURITY) & (F.col("labels") >= LEAST))


def joined(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """(host, tid, b, l) of templates without labels that are like the merged branches of their shape."""
    bare = rows.filter("labelled = 0")
    squares = F.col("squares") - F.col("chars") * F.col("chars") / F.col("n") + F.col("_squares") - F.col("_chars") * F.col("_chars") / F.col("_n")
    error = F.sqrt(F.greatest(squares, F.lit(0.0)) / F.greatest(F.col("n") + F.col("_n") - 2, F.lit(1)) * (1 / F.col("n") + 1 / F.col("_n")))
    alike = F.abs(F.col("chars") / F.col("n") - F.col("_chars") / F.col("_n")) <= Z * error + 1e-9
    return bare.join(sums.filter((F.col("branch") == "merged") & (F.col("branches") >= AGREE)), ["host", "shape"]).filter(alike).select("host", "tid", "b", "l")


def filter_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, label: str | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, template and purity.

    ``label``: a column that holds ``block``, ``allow`` or null; by default the verdicts of the rules are the labels.
    """
    box = Box(pages, None, ["host", "path", "rule", "verdict", "template", "purity"])
    address = box[url].cast("string")
    host, path = parts(address)
    read = box.rows(host=host, path=path, label=F.lit(None).cast("string") if label is None else box[label].cast("string"))
    read = read.withColumn("ruled", by_rule(rules, F.col("host"), F.col("path"))).withColumn("segs", segments(F.col("path")))
    way = lambda x: F.md5(F.array_join(x, "/").cast("binary"))
    mark = F.col("ruled.verdict") if label is None else F.col("label")
    length = F.length("path").cast("double")
    counts = materialize(
        read.filter("host <> ''").groupBy("host", "segs").agg(
            F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars"), F.sum(length * length).alias("squares"), F.count_if(mark == "block").alias("blocked"), F.count_if(mark == "allow").alias("allowed"),
        ).withColumn("sid", way("segs")),
        "paths",
    )
    made = wildcards(counts.select("host", "sid", "segs")).withColumn("tid", way("made"))
    sums = [F.sum(c).alias(c) for c in ("n", "chars", "squares", "blocked", "allowed")]
    of = made.join(counts.drop("segs"), ["host", "sid"]).groupBy("host", "made", "tid").agg(*sums)
    judged = judge(of)
    verdicts = made.join(judged, ["host", "tid"], "left").select("host", "sid", F.concat(F.lit("/"), F.array_join("made", "/")).alias("template"), "purity", "reject")
    out = read.withColumn("sid", way("segs")).drop("segs").join(verdicts, ["host", "sid"], "left")
    verdict = F.coalesce("ruled.verdict", F.when(F.col("reject"), F.lit("block")), F.lit("allow"))
    return box.open(out, host=F.col("host"), path=F.col("path"), rule=F.col("ruled.rule"), verdict=verdict, template=F.col("template"), purity=F.col("purity"))
