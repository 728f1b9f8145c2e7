import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from trialmesh.llm import filter_audit as fa


def brute(rows, labels):
    """rows: (doc_id, text, lang); each order is applied to the documents one filter after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    failed = []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [j for j, other, _ in rows if (other or "") == text and j is not None]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and min(copies) < i}
        failed.append((i, lang or "", {f for f, bad in fails.items() if bad}))
    found = {}
    removals = Counter()
    for part in {p for _, p, _ in failed}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in failed if p == part]
            for step, own in enumerate(order, 1):
                gone = [(i, f) for i, f in left if own in f]
                left = [(i, f) for i, f in left if own not in f]
                earlier = sum(own in f and bool(f & set(order[:step - 1])) for _, p, f in failed if p == part)
                removals[part, own] += len(gone)
                found[part, "".join(order), step] = (len(left), len(gone), earlier, sum(f == {own} for _, p, f in failed if p == part),
                                                     sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: (*v, removals[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "doc_id long, text string, lang string, mask int, hash string, part int").repartition(3)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = fa.filter_audit(docs, labelled).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in out}) == len(out)
    return {tuple(r[:3]): tuple(r[3:]) for r in out}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n, vocabulary: " ".join(draw.choices(words[:vocabulary], k=n))
    texts = [text(draw.choice([3, 199, 200, 260]), draw.choice([5, 60, 400])) + draw.choice(["", "", " A|B", " $", " " + "LOUD " * 9]) for _ in range(60)]
    texts += [None, "", "", " \n\x0b", "é" * 500, "X" * 30_000, "one two", "one two", "ONE two"] + [texts[0]] * 25 + [texts[1]] * 2
    found = [(i * 3 % 89, t, draw.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    return found + [(7, texts[0], "en"), (7, texts[0], "en"), (7, "another text of the same id", "en"), (None, texts[0], "en"), (None, "alone", "fr"), (None, "alone", "fr")]


def test_audit_equals_every_order_applied(spark, rows):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 1, None), (None, 1, 1), (999, 1, 1), (6, None, None)]
    want = brute(rows, labels)
    assert got(spark, rows, labels) == want
    assert len(want) == 600 * 4  # en, de, fr and none


def test_audit_without_labels_and_without_rows(spark, rows):
    assert got(spark, rows[:5], []) == brute(rows[:5], [])
    assert got(spark, [], [(1, 1, 1)]) == {}


def test_sketch_never_clears_a_repeat_and_crowding_changes_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").where("doc_id IS NOT NULL").withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    often = defaultdict(int)
    for r in docs.select("hash").collect():
        often[r["hash"]] += 1
    for words in (1, 16, 1024):
        tested = fa.possible_repeats(docs, fa.crowded(docs, words), words).collect()
        assert all(r["possible"] for r in tested if often[r["hash"]] > 1)
        if words == 1024:
            assert sum(r["possible"] for r in tested if often[r["hash"]] == 1) < 3
    want = brute(rows, [])
    monkeypatch.setattr(fa, "MAX_WORDS", 1)  # nearly everything counts as a possible repeat
    assert got(spark, rows, []) == want
