"""Small tables for the tests of the text operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    """documents with the given texts; an entry may also be (doc_id, text)."""
    rows = []
    for i, entry in enumerate(texts):
        key, text = entry if isinstance(entry, tuple) else (i, entry)
        rows.append((key, text, lang, "s", len(text or "")))
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
