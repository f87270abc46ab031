"""Small documents with every awkward case."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string, split string, chunks int, id int, rank int, task int, label string"


def rows_of(texts, langs=None):
    return [(i, t, langs[i] if langs else "en", "s", 1, "x", "x", "x", 1, 1, 1, 1, "x") for i, t in texts]


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    out = [None, "", " \n\t ", "a", "A b", "same text here", "same  text\nhere", "sametexthere", "Ünï cödé ❤ 中文 текст", "<|endoftext|> x <|startoftext|>"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(30)]
    passage = " ".join(rng.choice(words) for _ in range(25))
    for i, b in enumerate(base):
        out.append(b if i % 3 else f"{b} {passage} {b[:50]}")
    out += [base[0]] * 5 + [base[1] + " end", base[2].upper(), base[3].replace(" ", "\n")]
    out += [" ".join(rng.choice(words) for _ in range(20_000)), "x" * 50_000]
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
