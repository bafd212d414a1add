"""Review of models by a language model: prompts, a pluggable provider, and the reading of its answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import FINDINGS, Catalog
from ..session import importable, materialize, written_to
from .lineage_rules import in_order

LONGEST_SQL, MOST_COLUMNS, MOST_DESCRIPTIONS, MOST_TESTS = 6000, 30, 15, 10
#: A provider answers a prompt with JSON text, or a ``Reply`` that has it: an object whose ``violations`` have severity, message, suggestion, line_number, rule_id.
Provider = Callable[[str], "str | Reply"]
ANSWER = "ARRAY<STRUCT<rule_id: STRING, severity: STRING, message: STRING, suggestion: STRING, line_number: INT>>"


def silent(prompt: str) -> str:
    """The provider used without one: finds nothing."""
    return '{"violations": []}'


def prompts(c: Catalog) -> DataFrame:
    """project_id, model_id, name, file_path and prompt of every kept model with SQL."""
    by = ["project_id", "model_id"]
    columns = c.columns.groupBy(*by).agg(in_order("pos", "name").alias("_columns"), F.filter(in_order("pos", F.when(F.trim("description") != "", F.concat_ws(": ", "name", "description"))), lambda x: x.isNotNull()).alias("_described"))
    tests = c.tests.groupBy(*by).agg(F.array_sort(F.collect_list("name")).alias("_tests"))
    rows = c.code().join(columns, by, "left").join(tests, by, "left")
    none = F.array().cast("array<string>")
    part = lambda title, x, most, mark: F.when(F.size(F.coalesce(x, none)) > 0, F.concat(F.lit(title), F.array_join(F.slice(x, 1, most), mark)))
    prompt = F.concat_ws(
        "\n", F.concat(F.lit("Model: "), "name"), F.concat(F.lit("Layer: "), "layer"), F.concat(F.lit("Path: "), "file_path"), part("Columns: ", F.col("_columns"), MOST_COLUMNS, ", "),
        part("Descriptions:\n", F.col("_described"), MOST_DESCRIPTIONS, "\n"), part("Tests: ", F.col("_tests"), MOST_TESTS, ", "), F.concat(F.lit("SQL:\n"), F.left("sql", F.lit(LONGEST_SQL))))
    return rows.select(*by, "name", "file_path", prompt.alias("prompt"))


@dataclass
class Reply:
    """An answer with the tokens that it took."""

    text: str
    input_tokens: int = 0
    output_tokens: int = 0


#: Prompts that are asked before what came back is kept, those that a task asks at once, tries of each, and seconds before the second try, doubled each time.
ROUND, AT_ONCE, TRIES, PAUSE = 2000, 4, 3, 0.5
#: Rounds at most, which are longer than ROUND where there are more prompts than that.
MOST_ROUNDS = 20
KEPT = "prompt_id string, model string, answer string, input_tokens bigint, output_tokens bigint"


def _ask(provider: Provider, model: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def one(prompt: str) -> tuple:
        for turn in range(TRIES):
            try:
                said = provider(prompt)
                reply = said if isinstance(said, Reply) else Reply(said)
                return reply.text, reply.input_tokens, reply.output_tokens, None
            except Exception as e:  # one model's failure is a finding, not the end of the review
                failed = f"{type(e).__name__}: {e}"
                if turn + 1 < TRIES:
                    time.sleep(PAUSE * 2**turn)
        return None, 0, 0, failed

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for batch in batches:
                told = list(pool.map(one, batch["prompt"]))
                yield pd.DataFrame({"prompt_id": batch["prompt_id"], "model": model, **{k: [t[i] for t in told] for i, k in enumerate(("answer", "input_tokens", "output_tokens", "failed"))}})

    return ask


def asked(rows: DataFrame, provider: Provider, store: str, model: str = "") -> DataFrame:
    """What ``provider`` has said to the prompts of ``rows`` (prompt_id, prompt): ``KEPT`` with ``failed``, a row a distinct prompt.

    Answers are kept in the folder ``store`` by prompt and model. Prompts that it knows are not asked again, nor is a prompt that several models share. What a round of ``ROUND``
    prompts, or of a ``MOST_ROUNDS``-th of them if that is more, brings is appended before the next begins, so a run that ends halfway costs a round; failures are not kept and are asked
    again in another run. A round reads its own prompts only.
    """
    spark = rows.sparkSession
    importable(spark)
    wanted = materialize(rows.groupBy("prompt_id").agg(F.first("prompt").alias("prompt")), "prompts")
    spark.createDataFrame([], KEPT).write.mode("append").parquet(store)
    known = spark.read.schema(KEPT).parquet(store).filter(F.col("model") == model).dropDuplicates(["prompt_id"])
    new = wanted.join(known.select("prompt_id"), "prompt_id", "left_anti")
    rounds = min(-(-new.count() // ROUND), MOST_ROUNDS)
    path, failures = written_to(spark, "rounds"), []
    if rounds:
        # Dealt by prompt within a round, so all tasks of a round have some to ask.
        new.withColumn("round", F.pmod(F.xxhash64("prompt_id"), F.lit(rounds))).write.partitionBy("round").parquet(path)
    made = spark.read.schema("prompt_id string, prompt string, round bigint").parquet(path) if rounds else None
    for k in range(rounds):
        part = made.filter(F.col("round") == k).drop("round").repartition("prompt_id")
        told = materialize(part.mapInPandas(_ask(provider, model), KEPT + ", failed string"), "told")
        told.filter("failed is null").drop("failed").write.mode("append").parquet(store)
        failures.append(told.filter("failed is not null"))
    kept = spark.read.schema(KEPT).parquet(store).filter(F.col("model") == model).dropDuplicates(["prompt_id"]).join(wanted.select("prompt_id"), "prompt_id", "left_semi")
    return reduce(DataFrame.unionByName, [kept.withColumn("failed", F.lit(None).cast("string")), *failures])


def read_answer(answer: Column) -> Column:
    """The findings of an answer: an object with a list ``violations``, or the list itself.

    Code fences are dropped; text that is no JSON, other objects, and entries without a message are no findings.
    """
    bare = F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*|\s*```$", "")
    listed = F.when(F.startswith(F.ltrim(bare), F.lit("{")), F.from_json(bare, F.lit(f"STRUCT<violations: {ANSWER}>"))["violations"]).otherwise(F.from_json(bare, F.lit(ANSWER)))
    return F.filter(F.coalesce(listed, F.array().cast(ANSWER)), lambda x: F.trim(F.coalesce(x["message"], F.lit(""))) != "")


def answered(c: Catalog, provider: Provider = silent, store: str | None = None, changed_only: bool = False, model: str = "") -> DataFrame:
    """Models with what the provider has said to their prompts; ``changed_only`` asks for the models at changed paths alone."""
    rows = prompts(c)
    if changed_only and c.changed is not None:
        rows = rows.join(c.changed.select("project_id", F.col("path").alias("file_path")).distinct(), ["project_id", "file_path"], "left_semi")
    # Prompts are long to make and read twice.
    rows = materialize(rows.withColumn("prompt_id", F.sha2("prompt", 256)), "asked")
    return rows.drop("prompt").join(asked(rows.select("prompt_id", "prompt"), provider, store or written_to(rows.sparkSession, "answers"), model), "prompt_id")


def findings(rows: DataFrame) -> DataFrame:
    """Findings of ``answered`` models."""
    failed = F.array(F.struct(F.lit("ai.review_error").alias("rule_id"), F.lit("info").alias("severity"), F.col("failed").alias("message"), F.lit(None).cast("string").alias("suggestion"), F.lit(None).cast("int").alias("line_number")))
    rows = rows.select("*", F.explode(F.when(F.col("failed").isNull(), read_answer(F.col("answer"))).otherwise(failed)).alias("x"))
    severity = F.when(F.lower("x.severity").isin("error", "warning", "info"), F.lower("x.severity")).otherwise("warning")
    made = {"rule_id": F.coalesce("x.rule_id", F.lit("ai.general")), "severity": severity, "model_name": F.col("name"), "message": F.col("x.message"), "suggestion": F.col("x.suggestion"), "line_number": F.col("x.line_number")}
    return rows.withColumns(made).select(*FINDINGS)


def review(c: Catalog, provider: Provider = silent, changed_only: bool = False, store: str | None = None) -> DataFrame:
    """Findings of a reviewer."""
    return findings(answered(c, provider, store, changed_only))


def token_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost a model name, to six places: ``usage`` (model, input_tokens, output_tokens), ``prices`` (model, input, output) a million tokens. Unknown models cost 0."""
    sums = usage.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = F.coalesce((F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output")) / 1e6, F.lit(0.0))
    return sums.join(prices, "model", "left").withColumn("cost", F.round(cost, 6)).drop("input", "output")
