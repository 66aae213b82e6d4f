"""Small tables with everything that may go wrong in them."""

import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, mix_size int, near_id long, _sec_row long"
WORDS = "the quick brown fox jumps over lazy dogs while seven wise owls watch from tall old trees near the river bank at dawn".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(f"{r.choice(WORDS)}{r.randint(0, 99) if r.random() < 0.6 else ''}" for _ in range(n))


def odd_rows() -> list[tuple]:
    rest = (1, 0.5, True, 7, 3, 4)
    texts = [
        (1, prose(1, 60), "en", "a"), (2, prose(1, 60), "en", "b"), (3, prose(1, 60) + " extra", "en", "a"), (3, prose(1, 60) + " extra", "en", "a"),
        (4, "", "en", None), (5, None, None, "b"), (None, prose(2, 40), "en", "c"), (None, None, None, None), (6, " \n\t ", "de", "é"), (7, "one two", "en", "c"),
        (8, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" AKIA0123456789ABCD\nx\nx', "en", "a"), (9, prose(3, 40000), "en", "a"), (10, "ÄÖ ß 漢字 😀 don't 'll x" + "y" * 3000, "de", "z"),
        (11, "secret: 'abcdefghijkl' " + prose(5, 30) + "\n" + prose(6, 9) + "\n" + prose(6, 9), "fr", "z"),
    ]
    return [(i, t, lang, src, None if t is None else len(t), *rest) for i, t, lang, src in texts]


@pytest.fixture(scope="session")
def twins():
    """Pairs of words whose letters are one rule and its complement: any polynomial modulo 2 ** 64 gives them one value."""
    word, out = "a", []
    swap = str.maketrans("ab", "ba")
    while len(word) < 8192:
        word += word.translate(swap)
        if len(word) >= 1024:
            out += [word, word.translate(swap)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SHAPE).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (11, 1, None), (None, 1, 1), (8, None, 0), (8, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


@pytest.fixture(scope="session")
def rows(spark, sf_dir):
    """A registered query's result by id."""

    def run(name):
        from leafmill.llm.queries import QUERIES

        return QUERIES[name](spark, sf_dir).toPandas().set_index("doc_id")

    return run
