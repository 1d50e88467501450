import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words string, size string, kept string, component string, spans string, id string, t string"


def prose(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, ties and odd characters."""
    shared, base = prose(1, 70), prose(2, 300)
    near = base.split()
    near[150] = "other"
    texts = [
        None, "", " \n\t ", "one", "two words", "one", base, base, " ".join(near), base + " tail", prose(3, 120) + " " + shared, shared + " " + prose(4, 90),
        prose(5, 40) + "\n" + shared + "\n" + prose(6, 40), prose(7, 20_000), "a " * 400, "a b c " * 150, "\u00c9t\u00e9\u00a0\u2003x " * 20 + shared, "ONE two\x0bTHREE\x1ffour",
        base.upper(), "x" * 5000, "line one\nline one\n\n \nline two\nline one", prose(8, 60) + " ### $$$ %%% " + prose(9, 5),
    ]
    rows = [(i, text) for i, text in enumerate(texts)]
    return [(i, text, "en", None if i % 5 == 0 else "bca"[i % 3], len(text or ""), "s", "x", "y", "z", "c", "p", "i", "t") for i, text in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def loose(spark):
    """Null ids and repeated rows besides the odd rows."""
    rows = odd_rows()
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, *rows[7][1:]), (None, None, *rows[0][2:])], SCHEMA)
