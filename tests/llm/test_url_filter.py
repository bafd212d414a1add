from quarry.llm import url_filter as uf


def pages(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")


def test_parts_and_rules(spark):
    urls = [
        "https://A.Example.COM/en/1?x#y", "http://x.example.com/en/7a", "http://com/en/", "http://telecom/en/1", "http://b.net/de/8", "http://m.example.net/de/8", "http://x.org/es/", None, "no scheme", "x://y://z/p", "http://é.com?en", "ftp://h#f/en/",
        "http://x.com/EN/1",
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.filter_urls(pages(spark, urls)).collect()}
    assert got == {
        0: ("a.example.com", "/en/1", "com/en/", "block"), 1: ("x.example.com", "/en/7a", "example.com/en/7", "allow"), 2: ("com", "/en/", "com/en/", "block"), 3: ("telecom", "/en/1", None, "allow"),
        4: ("b.net", "/de/8", "net/de/", "allow"), 5: ("m.example.net", "/de/8", "example.net/de/8", "block"), 6: ("x.org", "/es/", "org/es/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("y:", "//z/p", None, "allow"), 10: ("é.com", "", None, "allow"), 11: ("h", "", None, "allow"), 12: ("x.com", "/EN/1", None, "allow"),
    }


def test_templates_learn_from_labels(spark):
    from pyspark.sql import functions as F

    bad = [f"http://h.xyz/promo/name{chr(97 + i % 26)}{i}" for i in range(60)]
    good = [f"http://h.xyz/docs/{i}.html" for i in range(60)]
    df = pages(spark, bad + good)
    label = F.when(F.col("page_id") < 40, "block").when((F.col("page_id") >= 60) & (F.col("page_id") < 100), "allow")
    got = uf.filter_urls(df.withColumn("mine", label), label="mine").toPandas().set_index("page_id").sort_index()
    assert (got.verdict[:60] == "block").all() and (got.verdict[60:] == "allow").all()
    assert set(got.template) == {"/promo/*", "/docs/*"}


def test_branches_without_labels_take_those_of_like_branches(spark):
    from pyspark.sql import functions as F

    urls, want = [], []
    three = ("/en/{}", "/de/{}", "/es/{}")
    for host, known, new, verdict in (
        ("bad.xyz", three, "/fr/{}", "block"), ("bad.xyz", three, "/fr/a-much-longer-name-{}/x/y", "block"), ("good.xyz", three, "/fr/{}", "allow"), ("none.xyz", (), "/fr/{}", "allow"), ("lone.xyz", three[:1], "/fr/{}", "allow"),
    ):
        for of, label in [*((k, "allow" if host == "good.xyz" else "block") for k in known), (new, None)]:
            urls += [(f"http://{host}{of.format(1000 + i)}", label) for i in range(20)]
            want += [label or verdict for _ in range(20)]
    # Half of the labels below the host's root say otherwise, so a branch of another shape is not rejected.
    urls += [(f"http://mixed.xyz/{a}/{i}", b) for a, b in (("en", "block"), ("de", "allow")) for i in range(1000, 1020)] + [("http://mixed.xyz/fr/x/y/1000", None)]
    want += ["block"] * 20 + ["allow"] * 21
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(urls)], "page_id long, url string, mine string")
    got = uf.filter_urls(df, rules=[], label="mine").orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == want
    assert all((r["purity"] is None) == (r["host"] == "none.xyz") for r in got)


def test_varied_children_become_wildcards(spark):
    df = pages(spark, [f"http://h.xyz/tag/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'qwertzuiop'[i // 26]}/page" for i in range(200)])
    assert {r[0] for r in uf.filter_urls(df).select("template").collect()} == {"/tag/*/page"}


def test_empty_repeats_and_clashes(spark):
    from pyspark.sql import functions as F

    assert uf.filter_urls(pages(spark, [])).count() == 0
    df = pages(spark, ["http://a.com/en/1"] * 3).withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "template", "purity", "n", "segs", "made")})
    got = uf.filter_urls(df).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == {"block"}


def tree(paths, depth=0):
    """Templates by recursion over nodes, as the docstring words it."""
    if len(paths) < uf.MANY:
        return {p: p[depth:] for p in paths}
    out, below = {p: () for p in paths if len(p) == depth}, {}
    for p in paths:
        if len(p) > depth:
            below.setdefault(p[depth], []).append(p)
    if len(below) >= uf.MANY and len(below) >= uf.VARIED * len(paths):
        below = {"*": [p for own in below.values() for p in own]}
    for seg, own in below.items():
        out |= {p: (seg, *rest) for p, rest in tree(own, depth + 1).items()}
    return out


def verdicts(templates, counts):
    """Purity of each template and whether it is rejected, in plain loops. counts: template -> [lengths], blocked, allowed."""
    shape = lambda t: tuple(x if x == "*" else "w" for x in t)
    all_b, all_l = sum(b for _, b, _ in counts.values()), sum(b + a for _, b, a in counts.values())
    prior = all_b / all_l if all_l else 0.0
    merged, own = {}, {}
    for s in {shape(t) for t in templates}:
        with_ = [t for t in templates if shape(t) == s and counts[t][1] + counts[t][2]]
        if not with_:
            continue
        share = sum(counts[t][1] for t in with_) / sum(counts[t][1] + counts[t][2] for t in with_)
        for t in with_:
            n = counts[t][1] + counts[t][2]
            if abs(counts[t][1] / n - share) <= uf.Z * (share * (1 - share) / n) ** 0.5 + 1e-12:
                merged.setdefault(s, []).append(t)
            else:
                own[t] = (counts[t][1], n)
        for t in merged.get(s, []):
            own[t] = (sum(counts[x][1] for x in merged[s]), sum(counts[x][1] + counts[x][2] for x in merged[s]))
    for t in templates:
        s, mine = shape(t), counts[t][0]
        if t not in own and len(merged.get(s, [])) >= uf.AGREE:
            theirs = [x for m in merged[s] for x in counts[m][0]]
            mean = lambda x: sum(x) / len(x)
            spread = sum((x - mean(mine)) ** 2 for x in mine) + sum((x - mean(theirs)) ** 2 for x in theirs)
            error = (spread / max(len(mine) + len(theirs) - 2, 1) * (1 / len(mine) + 1 / len(theirs))) ** 0.5
            if abs(mean(mine) - mean(theirs)) <= uf.Z * error + 1e-6:
                own[t] = (sum(counts[x][1] for x in merged[s]), sum(counts[x][1] + counts[x][2] for x in merged[s]))
    below = lambda way: [x for x in templates if x[: len(way)] == way and counts[x][1] + counts[x][2]]

    def smoothed(way, levels):
        p = prior
        for k in range(levels):
            near = below(way[:k])
            if near:
                p = (sum(counts[x][1] for x in near) + p * uf.M) / (sum(counts[x][1] + counts[x][2] for x in near) + uf.M)
        return p

    out = {}
    for t in templates:
        if t in own:
            b, n = own[t]
            out[t] = ((b + smoothed(t, len(t)) * uf.M) / (n + uf.M), n)
            continue
        near = next((x for x in (below(t[:k]) for k in range(len(t), -1, -1)) if x), [])
        sure = len(near) >= uf.AGREE and all(own[x][0] >= uf.PURITY * own[x][1] for x in near)
        out[t] = (smoothed(t, len(t) + 1), sum(counts[x][1] + counts[x][2] for x in near) if sure else 0)
    return {t: (p, p >= uf.PURITY and n >= uf.LEAST) for t, (p, n) in out.items()}


def test_tree_and_purity_agree_with_recursion(spark, monkeypatch):
    import random
    from collections import defaultdict

    rng = random.Random(11)
    words = ["news", "shop", "tag", "user", "blog", "a", "bb", "ccc"]
    rows = []
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.3:
            path = f"/user/{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}/{rng.choice(words)}"
        elif kind < 0.5:
            path = f"/tag/{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}"
        else:
            path = "".join(f"/{rng.choice(words)}" for _ in range(rng.randrange(0, 5)))
        bad = "user" in path[:6] or path.startswith("/shop")
        rows.append((len(rows), "http://h.xyz" + path, None if rng.random() < 0.7 or path.startswith("/blog") else ("block" if bad != (rng.random() < 0.1) else "allow")))
    df = spark.createDataFrame(rows, "page_id long, url string, mine string")
    cut = lambda u: tuple(x for x in u[12:].split("/") if x)
    made = tree(sorted({cut(u) for _, u, _ in rows}))
    counts = defaultdict(lambda: [[], 0, 0])
    for _, u, label in rows:
        c = counts[made[cut(u)]]
        c[0].append(len(u) - 12)
        c[1] += label == "block"
        c[2] += label == "allow"
    want = verdicts(list(counts), counts)
    assert any("*" in t for t in counts)
    for at_once in (50_000, 60):
        monkeypatch.setattr(uf, "AT_ONCE", at_once)
        got = {r["page_id"]: r for r in uf.filter_urls(df, rules=[], label="mine").collect()}
        for i, u, _ in rows:
            t = made[cut(u)]
            assert got[i]["template"] == "/" + "/".join(t), u
            assert abs(got[i]["purity"] - want[t][0]) < 1e-9 and (got[i]["verdict"] == "block") == want[t][1], u
    assert len({r["verdict"] for r in got.values()}) == 2


def test_repeats_change_no_template(spark):
    urls = [f"http://h.xyz/user/{a}{b}/{c}" for a in "abcdef" for b in "ghijkl" for c in ("x", "y", "z")]
    once = {r["url"]: r["template"] for r in uf.filter_urls(pages(spark, urls)).collect()}
    often = {r["url"]: r["template"] for r in uf.filter_urls(pages(spark, urls * 7)).collect()}
    assert once == often and set(once.values()) == {f"/user/*/{c}" for c in "xyz"}


def test_one_bad_branch_says_nothing_of_its_neighbours(spark):
    lone = [(f"http://a.shop.com/en/{i}", "block") for i in range(6)] + [(u, None) for u in ("http://a.shop.com/", "http://a.shop.com/fr/about", "http://a.shop.com/docs/x/y", "http://a.shop.com/fr/77")]
    many = [(f"http://b.shop.com/{x}/{i}", "block") for x in ("en", "fr", "de") for i in range(6)] + [(u, None) for u in ("http://b.shop.com/es/1", "http://b.shop.com/es/2", "http://b.shop.com/")]
    split = [(f"http://c.shop.com/{x}/{i}", "block" if x == "bad" else "allow") for x in ("bad", "good", "fine") for i in range(9)] + [("http://c.shop.com/bad/x/y", None), ("http://c.shop.com/bad/new", None), ("http://c.shop.com/good/new", None)]
    rows = [(i, u, x) for i, (u, x) in enumerate(lone + many + split)]
    got = {r["url"]: r for r in uf.filter_urls(spark.createDataFrame(rows, "page_id long, url string, mine string"), rules=[], label="mine").collect()}
    assert {got[u]["verdict"] for u, x in lone if x is None} == {"allow"} and {got[u]["verdict"] for u, x in lone if x} == {"block"}
    assert {got[u]["verdict"] for u, _ in many} == {"block"}
    # Two verdicts on one host, by branch; labels of one branch do not reach another one.
    assert {(u.split("/")[3], got[u]["verdict"]) for u, x in split if x} == {("bad", "block"), ("good", "allow"), ("fine", "allow")}
    assert {got[u]["verdict"] for u, x in split if x is None} == {"allow"} and got["http://c.shop.com/bad/x/y"]["purity"] > got["http://c.shop.com/good/new"]["purity"]
