import random

import pytest

#: Documents plus columns whose names the operators use for themselves.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "node long, size long, key string, score double, n_tokens string, part int, words string, _row string")


def table(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), 1, 2, "k", 0.5, "x", 3, "w", "r") for i, t, s in rows], SCHEMA)


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """Null ids, texts and sources, blank and one-word texts, a very long one, repeats, unusual characters."""
    rng = random.Random(3)
    words = vocabulary(300, 4)
    base = [prose(rng, words, 40) for _ in range(6)]
    rows = [(1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one", "a"), (5, "One", "b"), (None, base[0], None),
            (6, base[0], "a"), (7, base[0].upper(), "a"), (8, base[1] + "\n" + base[2], "b"), (8, base[1] + "\n" + base[2], "b"),
            (9, base[2] + "\n\n" + base[3], "c"), (10, prose(rng, words, 30000), "a"), (11, "x" * 20000, "c"),
            (12, "ΣΑΣ é ﬁ 漢字 😀😀 <|endoftext|> a\x00b", "a"), (13, base[4] + " <|startoftext|>", "é"), (14, base[4], "b"),
            (15, "MIT License, apache  LICENSE; Mit-License", "a"), (16, "\n".join(base), "b"), (None, None, None)]
    for k in range(20, 60):  # near copies of one text
        copy = base[5].split()
        copy[k % 40] = f"w{k}"
        rows.append((k, " ".join(copy), "a"))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return table(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, 0) for k in range(1, 60)] + [(None, 1, 0), (3, None, None)],
                                 "doc_id long, quality int, toxic int")
