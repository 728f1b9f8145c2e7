import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialmesh.llm import context_tree as ct

START, END = 0xFE, 0xFF


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def spelled(text):
    return b"".join(w + b" " for w in words(text)) + bytes([END])


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


class Tree:
    """Context-tree weighting by its definition: block probabilities of the bits that a node saw, by recursion over contexts."""

    def __init__(self, depth, texts):
        self.depth, self.seen = depth, defaultdict(list)
        for text in texts:
            for node, context, bit in self.decisions(text):
                self.seen[node].append((context, bit))

    def decisions(self, text):
        data = bytes([START] * self.depth) + text
        for at in range(self.depth, len(data)):
            context = data[at - self.depth:at][::-1]  # the nearest byte first
            for k in range(8):
                yield (k, data[at] >> (8 - k)), context, data[at] >> (7 - k) & 1

    def block(self, rows, level=0):
        zeros, ones = sum(b == 0 for _, b in rows), sum(b for _, b in rows)
        own = math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi) - math.lgamma(zeros + ones + 1)
        if level == self.depth:
            return own
        branches = defaultdict(list)
        for context, bit in rows:
            branches[context[level]].append((context, bit))
        below = sum(self.block(b, level + 1) for b in branches.values())
        return math.log(0.5) + np.logaddexp(own, below)

    def score(self, text):
        """Each decision given the training texts: the ratio of the block probabilities with it and without."""
        total = 0.0
        for node, context, bit in self.decisions(text):
            total += self.block([*self.seen[node], (context, bit)]) - self.block(self.seen[node])
        return total / math.log(10)


def base(rows):
    counts = Counter()
    for i, text in rows:
        if not is_held(i):
            counts.update([*words(text), None])
    n, kinds = sum(counts.values()), len(counts)
    for i, text in rows:
        tokens = [*words(text), None]
        yield (i, is_held(i), len(tokens), sum(counts[t] > 0 for t in tokens), n,
               sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (kinds + 1))) for t in tokens))


def check(got, rows, depth, scored=None):
    tree, memory = Tree(depth, [spelled(t) for i, t in rows if not is_held(i)]), {}
    want = defaultdict(list)
    for (i, text), b in zip(rows, base(rows), strict=True):
        if scored is None or i in scored:
            data = spelled(text)
            if data not in memory:
                memory[data] = tree.score(data)
            want[i].append((*b, memory[data], len(data)))
    for i, expected in want.items():
        found = sorted((tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")) for r in got if r["doc_id"] == i), key=lambda r: r[5:])
        assert len(found) == len(expected)
        for f, e in zip(found, sorted(expected, key=lambda r: r[5:]), strict=True):
            assert f[:5] == e[:5] and f[7] == e[7]
            assert f[5] == pytest.approx(e[5], rel=1e-9) and f[6] == pytest.approx(e[6], rel=1e-5)
    for r in got:
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / r["n_bytes"])


ROWS = [(10 + i, t) for i, t in enumerate(["one two one", "ONE\t two\n\x0b", "été 世界 🙂", "", None, " \r\n ", "a", "one two three one", "zzz yyy", "x" * 70 + " one", "x" * 70])]
ROWS += [(i, "one two one two") for i in range(40, 60)] + [(None, "one nobody"), (10, "one two one"), (10, "another")]


@pytest.mark.parametrize("options", [{}, {"keep_grams": 0, "keep_words": 0}, {"keep_grams": 9, "keep_words": 3}])
def test_scores_equal_the_definition(spark, docs_of, options):
    got = ct.score_texts(docs_of(ROWS), depth=2, **options).collect()
    assert len(got) == len(ROWS) and {r["held_out"] for r in got} == {False, True}
    check(got, ROWS, 2)


def test_longest_contexts(spark, docs_of):
    rows = ROWS[:10] + ROWS[-4:]
    check(ct.score_texts(docs_of(rows), depth=5).collect(), rows, 5, scored={10, 12, 17, 18, None})


def test_long_texts_in_pieces(spark, docs_of, monkeypatch):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice(["ab", "ba", "Abba", "b" * 80]) for _ in range(300))) for i in range(1, 9)]
    whole = {r["doc_id"]: r["score"] for r in ct.score_texts(docs_of(rows)).collect()}
    data = ct.spelled([t.encode() for _, t in rows], 5)
    want = [x for _, f in ct.grams(data, 5) for x in f.tolist()]
    monkeypatch.setattr(ct, "PIECE", 97)
    assert [x for _, f in ct.grams(data, 5) for x in f.tolist()] == want
    plain = [int.from_bytes(data[i - 5:i + 1].tobytes()) if data[i] != START else -1 for i in range(5, len(data))]
    assert want == plain
    assert {r["doc_id"]: pytest.approx(r["score"]) for r in ct.score_texts(docs_of(rows)).collect()} == whole


def test_no_training_rows_and_no_rows(spark, docs_of):
    held = [(i, "some words") for i in range(300) if is_held(i)]
    for r in ct.score_texts(docs_of(held)).collect():
        assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)
        assert r["bits_per_byte"] == pytest.approx(8.0)
    assert ct.score_texts(docs_of(held).limit(0)).collect() == []


def test_tally_hands_over_and_counts_the_same():
    texts = [f"word{i % 50} other{i} " * 3 for i in range(400)]
    few, many = ct.Tally(3, most=100), ct.Tally(3)
    sums = []
    for tally in (few, many):
        total = Counter()
        for i in range(0, 400, 40):
            tally.add([t.encode() for t in texts[i:i + 40]], i % 80 == 0)
            for batch in [*tally.full(), *(tally.full(0) if i == 360 else [])]:
                for r in batch.to_pylist():
                    total[r["gram"], r["word"], "n"] += r["n"]
                    total[r["gram"], r["word"], "train"] += r["train"]
        sums.append(total)
    assert sums[0] == sums[1] and sums[0][None, b"", "n"] == 400 and sums[0][None, b"", "train"] == 200


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.25, 100.5, 1e9 + 0.5])
    assert ct.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
