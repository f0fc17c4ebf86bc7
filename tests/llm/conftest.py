import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """Deterministic words without repeats of long stretches, in sentences."""
    out = []
    for i in range(n):
        w = WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97)
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ("key", "own", "node", "comp", "row", "n_lines", "v", "k0", "copies", "id", "item")],
])


def odd_rows() -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows, ties, a very long text, special characters."""
    base = prose(3, 120)
    near = base.replace("theta", "THETA", 1)
    texts = [
        (1, base), (2, base), (3, near), (4, prose(9, 120)), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one"),
        (10, prose(11, 60) + "\n" + prose(12, 60)), (10, prose(11, 60) + "\n" + prose(12, 60)), (None, "null id text here"), (None, prose(13, 80)),
        (11, "x" * 50_000), (12, "word " * 30_000), (13, "<|endoftext|>\x00 ²½ 日本語 é\r\nz"), (14, "*** %%% $$$"), (15, prose(20, 70) + " " + prose(30, 60)), (16, prose(21, 40) + " " + prose(30, 60)),
    ]
    return [(i, t, None if k % 5 == 0 else "en", "s", None, *["clash"] * 11) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
