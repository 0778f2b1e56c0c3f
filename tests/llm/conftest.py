import random

import pytest

#: Names that operators use inside, or might.
CLASHES = (
    "size shard slot row range key rep a b n at doc part length word bands bag ranges runs features score label rule tokens h w p e c1 c2 id block ids n_words "
    "failed sequence_id offset place _doc _ranges _id _extra _dirty host path text_crc32 first_byte class_id"
).split()


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgéß", k=rng.randint(2, 8))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null id, null text, empty and blank texts, a very long text, ties, repeated rows."""
    long = words(60_000, 1)
    return [
        (None, words(80, 2)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, words(80, 3)), (5, words(80, 3)), (6, words(80, 3)),
        (7, "x"), (8, "Ünïcödé 😀 " * 40), (9, words(80, 2)), (-3, "\n".join([words(9, 4)] * 30)), (2**62, words(200, 5)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those rows with extra columns of clashing names."""
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["?"] * len(CLASHES)) for r in odd_rows], schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small_docs(small):
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()
