"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go; of each group of near duplicates one document stays; documents with benchmark questions go; secrets are
redacted in place; the rest is mixed to the source weights. All but the last stage return the columns of their input. The last returns,
per document, the source, the target, and how often it is taken; documents that are taken 0 times are listed as such. Readers take the texts
themselves from the output of stage ``secrets``.

Defined cases, beside those of the operators: an empty table goes through all stages as an empty table; columns of any name are kept as they are; no stage needs
ids to be unique. A document without text is not toxic beyond the leak, no duplicate, holds no question and no secret, and has size 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, near_dedup, secrets
from quarry.llm import toxicity as toxic
from quarry.llm.common import Box, fold, picked
from quarry.session import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more; the model learns from the labels outside of the held-out fold.

    Without labels of both kinds each document scores the share of label 1 (0 without any). Null and empty texts score the leak; repeated rows share a score.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxic.train(picked(docs, doc_id="doc_id", text="text"), labels, fold(F.col("doc_id"), 5) != 0)
    box = Box(docs)
    kept = toxic.score(box.docs, model, text=f"c{box.place('text')}").filter("score < 0.5")
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class.

    Texts without words are classes of their own and all stay; of rows alike in id and text one stays; a null id ranks last; ties in the id go to
    the text of the lowest hash.
    """
    return near_dedup.one_of_each(docs, materialize(near_dedup.near_duplicates(docs), "classes"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a question of the benchmark, verbatim or with other numbers and names.

    Documents without text stay, as do all if the benchmark is empty; repeated rows share their fate.
    """
    box = Box(docs)
    marked = decontaminate.mark(box.rows(doc_id=box["doc_id"], text=box["text"]), table(spark, sf_dir, "benchmark"), keep=["row"])
    return box.open(marked.filter("not contaminated"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets and the parts linked to them; ``n_chars`` follows the text where the input has it.

    Null texts stay null and empty ones empty; every row comes back, repeated ones alike.
    """
    box = Box(docs)
    found = secrets.find_secrets(box.rows(doc_id=box["doc_id"], text=box["text"].cast("string")), keep=["row", "text"])
    clean = secrets.redact(found)
    own = [F.col("row")[f"c{i}"] for i in range(len(docs.columns))]
    new = {"text": F.col("text"), "n_chars": F.when(F.size("cuts") > 0, F.length("text"))}
    return clean.select(*[F.coalesce(new[n].cast(kind), own[i]).alias(n) if n in new else own[i].alias(n) for i, (n, kind) in enumerate(docs.dtypes)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every document.

    Null sources are one source, ranked last; documents without words have size 0 and are taken 0 words; repeated rows are documents of their own; ties are
    broken by hash, so reruns agree.
    """
    return mixing.entropy_balance(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("secrets", redaction), ("mixing", mix),
]

#: Training, signatures and dealing by hash have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str] = {}
