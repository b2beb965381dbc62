import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    def of(rows, schema=DOCS):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows] if schema == DOCS else rows
        return spark.createDataFrame(full, schema)

    return of


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty ones, short ones and a long one."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(12)]
    passage = " ".join(word() for _ in range(60))
    texts = list(base)
    for t in base[:6]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
        texts.append(t)
    texts += [f"{base[7]}\n{passage}\nend {word()}", f"{word()} {word()}\n{passage}", passage, passage.upper()]
    texts += [None, "", " \n\t", "one", "one two three", "one two three", "é日本 ñandú " * 30, "x" * 400, "x" * 90, "Und " * 80]
    texts.append(" ".join(word() for _ in range(6000)) + " " + passage)
    rng.shuffle(texts)
    return list(enumerate(texts))
