import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents: (doc_id, text[, lang])."""

    def make(rows, extra=False):
        rows = [(*r, *[None] * (3 - len(r))) for r in rows]
        df = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for c in ("id", "key", "_hash", "_hit", "found", "a", "b", "start", "component", "stratum", "_bucket", "_at", "_len", "_id", "_sha", "row", "gone", "ID2"):
                from pyspark.sql import functions as F

                df = df.withColumn(c, F.lit("x"))
        return df

    return make


HARD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from here."),
    (2, "The quick  brown fox jumps over the lazy dog\nand runs away from here."),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "word " * 40000),
    (7, "short"),
    (7, "short"),
    (None, "no id at all"),
    (8, "ünïcödé 日本 😀 <|endoftext|> \\ </turn>"),
]


@pytest.fixture
def hard(docs):
    return docs(HARD, extra=True)
