import random

import pytest

LETTERS = "the and of ing tion er al ou re est un ly".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="session")
def hard_texts():
    """Texts by id with copies, shared passages, long and odd ones."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = prose(rng, 30)
    texts = dict(enumerate(base))
    for i in range(40, 50):
        texts[i] = base[i - 40]  # exact copies
    for i in range(50, 60):
        texts[i] = prose(rng, 20) + " " + passage + " " + prose(rng, 5)
    for i in range(60, 66):
        texts[i] = base[3] + f" tail{i}"
    texts |= {66: None, 67: "", 68: " \t\n ", 69: "a" * 5000, 70: "a" * 3000, 71: "éü" * 80, 72: "xéü" * 60 + "é", 73: "日本語" * 40,
              74: prose(rng, 30_000), 75: "x" * 49, 76: "x" * 50, 77: "x" * 50, 78: "nul\0byte " * 20, 79: "one", 80: "one\n" * 30,
              81: "12345 67890 " * 40, 82: "word### two$$$ " * 40}
    return texts


@pytest.fixture(scope="session")
def hard_docs(spark, hard_texts):
    """The texts as documents with repeated rows, null ids and sources, and columns named like inner ones."""
    rows = [(i, t, ["en", "de", None][i % 3], ["src0", "src1", "src2", None, "src0", "src0"][i % 6], 1, i, "x", 2, i) for i, t in hard_texts.items()]
    rows += [rows[4], rows[4], (None, rows[5][1], "en", "src1", 1, 1, "x", 2, 3), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, batch int, size long, row string, fp int, n_removed long")


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.limit(0)
