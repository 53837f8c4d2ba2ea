import pytest

TEXTS = [
    (1, "The cat sat on the mat. It was a fine day, and the sun shone on the hill.\nSecond line here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (3, "", None, None),
    (None, "Der Hund lief über die Straße, und alle lachten.", "de", "b"),
    (None, "Der Hund lief über die Straße, und alle lachten.", "de", "b"),
    (4, "x" * 70_000, "en", "c"),
    (5, "word " * 30_000, "en", "c"),
    (6, " \t\n    \n\n\n  tabs\t\tand   runs  ", "en", None),
    (7, "日本語のテキスト ✓ 🎉 é ́", "ja", "d"),
    (8, "!!! ??? ... <|endoftext|> 12345 a.,b ,c . d, e.", "en", "a"),
    (9, "zero \0 byte\0", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty and very long texts, repeated rows, null ids, and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    names = ["row", "n_chars", "size", "hash", "fp", "kept", "lang_pred", "score", "host", "n_words", "shard_bytes", "position", "block", "k", "id", "slot", "at", "mix_row", "mix_slot", "mix_at", "shard", "shard_hash", "shard_", "cell", "template", "url", "page_id", "media", "frame", "words", "root"]
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def docs_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, docs_dir):
    return spark.read.parquet(f"{docs_dir}/documents.parquet")


def listed(df):
    return [tuple(r) for r in df.collect()]
