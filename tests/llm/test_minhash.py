import random
import re
import string

import numpy as np

from trialmesh.llm.components import components
from trialmesh.llm.minhash import BINS, band_keys, bit_sketch, near_duplicates, sketch
from trialmesh.llm.shingles import WordHashes, shingle_set

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, size, percent):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets, parent = {}, {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text, size))
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    flat = [(i, s) for i, many in sets.items() for s in many]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), top(i)) for i, s in flat}


def check(docs, rows, size=4, percent=80):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs, size, percent).collect()}
    assert got == brute(rows, size, percent)


def test_equals_all_pairs(docs_of, prose):
    check(docs_of(prose), prose)


def test_chain_of_near_copies_needs_more_centres(docs_of):
    """Neighbours in the chain are linked, most others are not, so one centre a bucket is not enough."""
    draw = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, now = [], words[:120]
    for i in range(60):
        rows.append((1000 - i, " ".join(now)))
        now = now[2:] + [draw.choice(words), draw.choice(words)]
    rows += [(i, f"{' '.join(words[:30])} only here {i} {i + 1} {i * 7}") for i in range(40)]
    draw.shuffle(rows)
    check(docs_of(rows), rows)


def test_hub_of_mutually_distant_copies(docs_of):
    base = [f"b{i}" for i in range(100)]
    rows = [(500, " ".join(base))]
    for i in range(50):
        copy = list(base)
        for at in random.Random(i).sample(range(100), 3):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    check(docs_of(rows), rows)


def test_repeats_nulls_and_empty_table(docs_of):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (7, "a b c d e f"), (3, None), (4, ""), (None, "a b c d e f"), (None, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(docs_of(rows), 4).collect())
    assert got == [(-1, None, True), (-1, None, True), (1, 1, True), (1, 1, True), (3, 3, True), (4, 4, True), (7, 1, False)]
    assert near_duplicates(docs_of([]), 4).count() == 0


def test_sketches_estimate_the_similarity():
    draw, words = np.random.default_rng(5), WordHashes()
    assert len(shingle_set("one two", 5, words)) == 1
    for size in (12, 100, 3000):
        common, left, right = (mixed_rows(draw, n) for n in (int(size * 0.8), size // 10, size // 10))
        a, b = np.unique(np.concatenate((common, left))), np.unique(np.concatenate((common, right)))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        bits = sum(int(x).bit_count() for x in (bit_sketch(a) ^ bit_sketch(b)).view(np.uint64))
        assert abs(1 - 2 * bits / 4096 - true) < 0.08
        assert len(band_keys(sketch(a))) == BINS // 4


def mixed_rows(draw, n):
    return draw.integers(0, 2 ** 64, n, dtype=np.uint64)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(300, 301), (301, 302), (300, 302), (7, 7)]
    table, _ = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["id"]: r["component_id"] for r in table.collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 5 for i in range(200, 260)) and got[302] == 300 and 7 not in got
