import hashlib
import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows with clashing extra columns as a documents table."""
    def make(rows):
        rows = [(i, t, "en", f"s{i}", -1, "x", 7) for i, t in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, label int").repartition(3)
    return make


@pytest.fixture(scope="session")
def prose():
    """Made-up texts with copies, near copies, shared lines, odd characters and empty ones."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij éß世🙂") for _ in range(draw.randint(1, 7))).strip() or "a" for _ in range(300)]
    text = lambda n: " ".join(draw.choice(words) + draw.choice(["", "", ".", "\n", "!"]) for _ in range(n))
    rows = [text(draw.randint(1, 120)) for _ in range(60)]
    for i in range(20):
        some = rows[i].split(" ")
        some[draw.randrange(len(some))] = "changed"
        rows.append(" ".join(some))
    rows += [rows[0]] * 5 + [rows[3].upper()] * 2 + [None, "", " ", "\n\n", "a", "one two", "ONE two", "'s it's don't  x", "<|endoftext|> a<|endoftext|>b  ", "x" * 5000, "🙂" * 40]
    line = "this very long line is shared by many documents"
    rows += [f"{text(5)}\n {line.upper()} \n{text(4)}" for _ in range(6)] + [line]
    return list(enumerate(rows, 10))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
