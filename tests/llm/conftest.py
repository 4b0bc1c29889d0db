import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    """prose(seed, n): n words in lines and sentences."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        out = []
        for i in range(n):
            w = rng.choice(words)
            out.append((w.capitalize() if i % 9 == 0 else w) + (".\n" if i % 27 == 26 else "." if i % 9 == 8 else "") + ("" if i % 27 == 26 else " "))
        return "".join(out).strip()

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """frame(texts): documents with these texts, numbered from 0; a text may be (doc_id, text) too."""

    def make(texts, **more):
        rows = []
        for i, t in enumerate(texts):
            doc_id, text = t if isinstance(t, tuple) else (i, t)
            rows.append((doc_id, text, "en", f"s{i % 3}", len(text) if text is not None else None))
        return spark.createDataFrame(rows, SCHEMA)

    return make


#: Nulls, empty and blank texts, one word, odd white space, a long line, repeated rows.
@pytest.fixture(scope="session")
def odd(prose):
    return [None, "", " \t\n ", "word", "a\u00a0b\u2003c\x1cd e\x0bf\x0cg", "x" * 5000, "same same " * 40, prose(1, 120), prose(1, 120), (7, prose(1, 120)), (None, prose(2, 80)), (None, None), "\x00nul \ufffd é É 日本語 \U0001f600"]
