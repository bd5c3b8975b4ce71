import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: columns whose names the operators use themselves
CLASHING = ", score double, ids string, decoded int, key string, l1 string, bucket int, _row int, links int, toxic string, block int"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions under pale moons near rivers".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abdeghilmnorstu", k=r.randint(3, 9))) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and wordless texts, a very long text, repeated rows."""
    long = prose(30_000, 99)
    return [(1, "one two three four five six seven", "en", "s", 33), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, "one two three four five six eight nine", None, "s", 1), (4, " \n\t.,!", "en", None, 6),
            (5, long, "en", "s", len(long)), (1, "one two three four five six seven", "en", "s", 33),
            (6, "short text", "de", "s", 10), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        if not clashing:
            return spark.createDataFrame(rows, DOCS)
        return spark.createDataFrame([(*r, 0.5, "x", 1, "k", "l", 2, 3, 4, "t", 5) for r in rows], DOCS + CLASHING)
    return make
