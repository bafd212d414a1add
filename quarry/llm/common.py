"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[ \t\n\x0B\f\r]+"


def words(text: Column) -> Column:
    """Words of a text; an empty array for null or blank texts."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES[1:], " " * 5))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def word_count(text: Column) -> Column:
    """Number of words, without making them: the spaces that are left once runs of white space are one."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RE, " "))
    inner = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare == "", F.lit(0)).otherwise(inner + 1).cast("long")


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0)).cast("int")


class Box:
    """Columns of an input under names of their own, the ones to keep as one struct ``row``: nothing that an operator adds can clash.

    ``made``: names of the columns that the operator returns; columns of the input named so, in any case, give way.
    A column is found by its very name, else without regard to case.
    """

    def __init__(self, docs: DataFrame, keep: Sequence[str] | None = None, made: Sequence[str] = ()) -> None:
        self.names = docs.columns
        self.docs = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        less = {m.lower() for m in made}
        self.kept = [(self.place(n), n) for n in (self.names if keep is None else keep) if n.lower() not in less]

    def place(self, name: str) -> int:
        folded = [n.lower() for n in self.names]
        return self.names.index(name) if name in self.names else folded.index(name.lower())

    def __getitem__(self, name: str) -> Column:
        return F.col(f"c{self.place(name)}")

    @property
    def row(self) -> Column:
        own = [F.col(f"c{i}") for i in dict.fromkeys(i for i, _ in self.kept)]
        return F.struct(*own or [F.lit(None).cast("int").alias("none")])

    def rows(self, **own: Column) -> DataFrame:
        """``row`` and the ``own`` columns."""
        return self.docs.select(self.row.alias("row"), *[v.alias(k) for k, v in own.items()])

    def open(self, df: DataFrame, **made: Column) -> DataFrame:
        """The kept columns of ``df``'s ``row``, under their names, with those ``made``."""
        return df.select(*[F.col("row")[f"c{i}"].alias(n) for i, n in self.kept], *[v.alias(k) for k, v in made.items()])


def picked(docs: DataFrame, **own: str) -> DataFrame:
    """Columns of ``docs`` as ``new=name``, whatever else it has."""
    box = Box(docs, [])
    return box.docs.select(*[box[name].alias(new) for new, name in own.items()])
