import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names operators use themselves.
CLASHING = ("size", "score", "fingerprint", "component_id", "block", "pieces", "ids", "label", "target", "word", "n", "a", "b",
            "_size", "_source", "_name", "_hash", "_content", "_before", "_bucket", "_offset", "_target", "_first", "_last", "_source_size", "_piece",
            "_of", "_guess", "guess", "row", "hash", "key", "part", "of", "length", "data", "keys", "lang_pred", "piece", "_text", "base", "spans")


@pytest.fixture(scope="session")
def doc_frame(spark):
    """Documents of (doc_id, text[, lang[, source]]), with further columns of clashing names."""
    from pyspark.sql import functions as F

    def make(rows, clashing=True):
        full = [tuple([*r, *["en", "s"][len(r) - 2 :], len(r[1] or "")]) for r in rows]
        df = spark.createDataFrame(full, DOC_SCHEMA)
        return df.withColumns({c: F.lit("x") for c in CLASHING}) if clashing else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied rows, and a null key."""
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(120_000))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", None), (4, long, "en", "a"), (5, "One two three four", "en", "a"),
        (5, "One two three four", "en", "a"), (6, "one  two\nthree\tfour", None, "b"), (None, "one two three four", "de", "b"),
        (7, "Ünï çödé 中文 🙂 x", "de", ""), (8, "y" * 300_000, "en", "a"), (9, "one two", "fr", "b"),
    ]
