import pytest

#: A column of each result or helper name that the operators use: inputs may have them too.
CLASHES = ["score", "offending", "base_spans", "all_spans", "removed", "contaminated", "items", "coverage", "size", "target", "copies", "node", "mark", "component", "n", "rank", "label", "weight", "key", "chunk", "source_size"]


@pytest.fixture
def documents(spark):
    """Builds documents: rows of (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names on request."""

    def make(rows, clash=False):
        full = [(r + ("en", "s"))[:4] if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHES})
        return df

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null id has text here too"), (4, "same row of text"), (4, "same row of text"), (5, "word " * 30_000)]


@pytest.fixture
def odd():
    return list(ODD)
