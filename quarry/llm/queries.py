"""The thin queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written_to
from . import decontaminate, divergence, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, secrets, token_files, toxicity, url_filter, whitening
from .common import fold


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels, ~held_out), keep=["doc_id"])
    offending = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), offending.alias("offending"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.as_text(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), secrets.as_text(F.col("all_spans")).alias("spans"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    return marked.select("doc_id", "contaminated", items.alias("items"), "coverage", "reparameterised")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes("v1").alias("kept"), "failures",
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    cut = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("removed").alias("n_removed"), cut.alias("chars_removed"), spans.alias("removed"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language_id.identify(docs.select("doc_id", "text", "lang"), learn_from=~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Grades: 0 poor, 1 good but toxic, 2 good.
    rating = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = table(spark, sf_dir, "labels").select("doc_id", rating.alias("label"))
    held_out = fold(F.col("doc_id"), 5) == 0
    graded = quality_classifier.grade(docs, quality_classifier.train(docs, ratings, ~held_out), least=1)
    return graded.select("doc_id", held_out.alias("held_out"), "expected_grade", "tail", (F.col("tail") >= 0.5).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.entropy_balance(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def parts_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op2, which SQL can find too."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def parts_mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op9, which SQL can find too."""
    return op9_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def parts_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, paths and rules of op10, which SQL can find too, and the verdicts that rules give."""
    verdict = F.when(F.col("rule").isNotNull(), F.col("verdict"))
    return op10_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", verdict.alias("by_rule"))


def parts_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op4's policies costs, from one ledger."""
    rows = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    each = [quality_rules.ablation(rows, policy).select(F.lit(policy).alias("policy"), "rule", "bit", "failed", "failed_alone", "kept", "kept_without_rule") for policy in sorted(quality_rules.POLICIES)]
    return reduce(DataFrame.unionByName, each)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def parts_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, components, sizes and exact deviations of op12, which SQL can find too."""
    return op12_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = written_to(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_near_dedup": op8_near_dedup,
    "op9_mixing": op9_mixing,
    "op10_url_filter": op10_url_filter,
    "op11_divergence": op11_divergence,
    "op12_whitening": op12_whitening,
    "op13_token_files": op13_token_files,
    "parts_secret_spans": parts_secret_spans,
    "parts_mix_targets": parts_mix_targets,
    "parts_url_rules": parts_url_rules,
    "parts_quality_ablation": parts_quality_ablation,
    "parts_whitening": parts_whitening,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_COUNTED = f"""
texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
lines AS (SELECT k, l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM texts) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
by_line AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY k),
starts AS (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM texts),
windows AS (SELECT k, i, count(*) OVER (PARTITION BY k, array_to_string(w[i:i + 4], ' ')) AS n FROM starts),
covered AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS j FROM windows WHERE n > 1) GROUP BY k),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower, (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouts
  FROM texts LEFT JOIN by_line USING (k) LEFT JOIN covered USING (k)),
bits AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN n_upper > n_lower THEN 32 ELSE 0 END + CASE WHEN 10 * n_shouts > n_words THEN 64 ELSE 0 END AS BIGINT) AS failures
  FROM counted)"""
_NAMED = "'[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]'"
_ASSIGN = """'(' || {0} || ')["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)'""".format(_NAMED)


def _spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    cut = f"SELECT k, list_transform(string_split_regex(t, {pattern}), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(t, {pattern}, 0), lambda x: length(x)) AS len, list_transform(regexp_extract_all(t, {pattern}, {group}), lambda x: length(x)) AS part FROM texts"
    at = f"SELECT k, unnest(range(1, len(len) + 1)) AS i, gap, len, part FROM ({cut})"
    return f"SELECT k, '{kind}' AS kind, {rank} AS rank, list_sum(gap[1:i]) + coalesce(list_sum(len[1:i - 1]), 0) AS s, len[i] AS n FROM ({at}) WHERE part[i] >= {least}"


SQL: dict[str, str] = {
    "op4_quality_rules": f"""WITH {_COUNTED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM bits""",
    "parts_quality_ablation": f"""WITH {_COUNTED},
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16), ('upper_case', 32), ('shouting', 64)) r(rule, bit)),
policies AS (SELECT 'base' AS policy, 3 AS mask UNION ALL SELECT 'v1', 127)
SELECT policy, rule, CAST(bit AS BIGINT) AS bit, CAST(count(*) FILTER (failures & bit <> 0) AS BIGINT) AS failed, CAST(count(*) FILTER (failures & mask = bit) AS BIGINT) AS failed_alone,
  CAST(count(*) FILTER (failures & mask = 0) AS BIGINT) AS kept, CAST(count(*) FILTER (failures & mask & ~bit = 0) AS BIGINT) AS kept_without_rule
FROM bits JOIN policies ON true JOIN rules ON mask & bit <> 0 GROUP BY policy, rule, bit""",
    "op11_divergence": r"""WITH texts AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
seen AS (SELECT k, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS total FROM seen GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM seen JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM texts),
sizes AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
langs AS (SELECT l.lang, count(term) AS v, coalesce(sum(total), 0) AS whole FROM (SELECT DISTINCT lang FROM groups) l LEFT JOIN kept USING (lang) GROUP BY l.lang),
dense AS (SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + 1000000000 * (coalesce(n, 0) + 1) // (size + v) AS BIGINT) AS p, CAST(1 + 1000000000 * (total + 1) // (whole + v) AS BIGINT) AS q
  FROM sizes JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
    "parts_secret_spans": f"""WITH texts AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_spans("assign", 0, _ASSIGN, 2, 8)} UNION ALL {_spans("access", 1, "'AKIA[A-Z0-9]+'", 0, 16)} UNION ALL {_spans("hex", 2, "'[0-9a-f]+'", 0, 32)}),
listed AS (SELECT k, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS said FROM found GROUP BY k)
SELECT doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex, sha256(coalesce(said, '')) AS base_sha256 FROM texts LEFT JOIN listed USING (k)""",
    "parts_mix_targets": f"""WITH sized AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS most, (sum(source_size) OVER ())::DOUBLE AS total FROM sources),
levels AS (SELECT *, (total - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM weighed WINDOW b AS (ORDER BY most / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (SELECT min_by(level, most / w) FILTER (most >= level * w) AS level FROM levels)
SELECT d.doc_id, d.size, l.source_size, round(least(l.most, coalesce(e.level * l.w, l.most)), 3) AS target FROM sized d JOIN levels l ON d.source IS NOT DISTINCT FROM l.source JOIN ends e ON true""",
    "parts_whitening": """WITH grid AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cells AS (SELECT x, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM (SELECT DISTINCT x FROM grid)),
sums AS (SELECT list(s ORDER BY i) AS s FROM (SELECT i, CAST(sum(v) AS BIGINT) AS s FROM cells GROUP BY i)),
sized AS (SELECT count(DISTINCT x) AS n, any_value(len(x)) AS d FROM grid)
SELECT vec_id, CAST(component AS INTEGER) AS component, n, CAST(list_sum(list_transform(range(1, d + 1), lambda i: (n * x[i] - s[i]) * (n * x[i] - s[i]))) AS BIGINT) AS deviation
FROM grid, sums, sized, (SELECT unnest(range(1, 17)) AS component) c WHERE component <= d""",
    "parts_url_rules": """WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) r(verdict, h, p)),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS by_rule FROM named JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, by_rule FROM named LEFT JOIN fits USING (page_id)""",
}
