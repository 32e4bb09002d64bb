"""Fixtures for the operators' tests: awkward documents, and the smallest given tables."""

TEXTS = [None, "", " ", "One two three four five.", "One two three four five.", "word " * 3000, "café naïve 漢字 \U0001f600", "a\n\n b  c \t d\n", "x" * 5000]


def docs(spark, texts=TEXTS, ids=None, extra: bool = True):
    """A documents table with repeated and null ids, and columns whose names the operators use inside."""
    ids = ids if ids is not None else list(range(len(texts)))
    rows = [(i, t, "en", "src0", len(t or ""), 1, "x", None) for i, t in zip(ids, texts)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows if extra else [r[:5] for r in rows], shape + (", n long, digest string, queue string" if extra else ""))


def small(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
