import functools
import hashlib
import random

import pytest
import xxhash

from trialmesh.llm.queries import QUERIES
from trialmesh.llm.winnowing import BASE, PRIME, against_next, fingerprints


def brute(hashes, window):
    """Positions chosen by winnowing, from the hashes of all grams."""
    if not hashes:
        return []
    if len(hashes) < window:
        return [max(i for i, h in enumerate(hashes) if h == min(hashes))]
    found = []
    for start in range(len(hashes) - window + 1):
        part = hashes[start:start + window]
        at = start + max(i for i, h in enumerate(part) if h == min(part))
        if at not in found:
            found.append(at)
    return found


def signed(data):
    """The engine's 64-bit hash of bytes."""
    value = xxhash.xxh64(data, seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def gram_hashes(texts, gram):
    """The hash of every gram by Horner's rule over its own symbols; of the whole text, 32 bits, where it is shorter."""
    found = []
    for t in texts:
        symbols = [signed(c.encode("utf-32-be")) & (PRIME - 1) for c in t]
        if 0 < len(t) < gram:
            low = signed(t.encode("utf-32-be")) & 0xFFFFFFFF
            found.append([low - (1 << 32) if low >> 31 else low])
        else:
            found.append([functools.reduce(lambda h, v: (h * BASE + v) % PRIME, symbols[i:i + gram], 0) for i in range(len(t) - gram + 1)])
    return found


def test_fingerprints_equal_brute_force(spark, docs_of, prose):
    rows = [r for r in prose if len(r[1] or "") < 800]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs_of(rows)).collect()}
    hashes = gram_hashes([t or "" for _, t in rows], 8)
    for (i, _), h in zip(rows, hashes):
        assert found[i] == " ".join(str(h[at]) for at in brute(h, 32)), i


@pytest.mark.parametrize("gram", [1, 2, 3, 5, 6, 7, 13])
def test_rolled_hashes_of_any_length(spark, docs_of, gram):
    draw = random.Random(gram)
    rows = [(i, "".join(draw.choice("ab é世🙂") for _ in range(draw.choice([0, 1, 5, 6, 7, 13, 14, 60])))) for i in range(60)]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs_of(rows), gram=gram, window=4).collect()}
    for (i, _), h in zip(rows, gram_hashes([t for _, t in rows], gram)):
        assert found[i] == " ".join(str(h[at]) for at in brute(h, 4)), i


def test_order_of_equal_and_missing_ids(spark, docs_of):
    draw = random.Random(3)
    rows = [(draw.choice([7, 7, None, -5, *range(40), 1 << 60, (1 << 60) + 1]), f"text {i} " + "w" * draw.randint(0, 30)) for i in range(400)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1].encode())))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        want.append((str(i), hashlib.sha256((t[:len(t) - len(t) // 2] + n[:len(t) // 2]).encode()).hexdigest()))
    got = against_next(docs_of(rows)).collect()
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got) == sorted(want)


def test_edited_texts_and_neighbours(spark, docs_of, prose):
    got = {r["doc_id"]: r for r in against_next(docs_of(prose)).collect()}
    order = sorted(prose, key=lambda r: -r[0])
    texts = [t or "" for _, t in order]
    edited = [t[:len(t) - len(t) // 2] + n[:len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1])]
    direct = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs_of([(i, e) for (i, _), e in zip(order, edited)])).collect()}
    plain = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs_of(prose)).collect()}
    cut = lambda s: set(s.split())
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert len(got) == len(prose)
    for k, ((i, _), text, e) in enumerate(zip(order, texts, edited)):
        row, following = got[i], order[(k + 1) % len(order)][0]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert row["fingerprint"] == plain[i] and row["edited_fingerprint"] == direct[i], i
        assert abs(row["near_edited"] - alike(cut(plain[i]), cut(direct[i]))) < 1e-12
        assert abs(row["near_next"] - alike(cut(plain[i]), cut(plain[following]))) < 1e-12


def test_empty_table_single_row_null_ids_and_repeats(spark, docs_of):
    assert against_next(docs_of([])).count() == 0
    one = against_next(docs_of([(5, "some text of one row only, long enough for windows")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    rows = against_next(docs_of([(None, "a"), (None, None), (1, "same"), (1, "same"), (2, "")])).collect()
    assert len(rows) == 5 and {r["near_next"] for r in rows} <= {0.0, 1.0}


def test_main_path_is_native(docs_of):
    plan = against_next(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_marks_every_run_of_23_code_points(spark, docs_of, tmp_path):
    draw = random.Random(9)
    made = lambda n: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(0, 120, 2):
        run = made(23)
        rows += [(i, made(60) + run + made(60)), (i + 1, made(70) + run + made(50))]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["fingerprint"].split() for r in QUERIES["op7_fingerprints"](spark, str(tmp_path)).collect()}
    assert all(set(found[i]) & set(found[i + 1]) for i in range(0, 120, 2))
    for (i, _), h in zip(rows, gram_hashes([t for _, t in rows], 8)):
        assert found[i] == [str(h[at]) for at in brute(h, 16)], i


def test_long_texts_followed_by_empty_ones(spark, docs_of):
    draw = random.Random(4)
    rows = [(i, "" if i % 2 else "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(77, 160)))) for i in range(1200)]
    rows = [(i + 1 if i % 2 == 0 else i - 1, t) for i, t in rows]  # every text before an empty one in the order of falling ids
    for window in (16, 32):
        got = {r["doc_id"]: r["edited_fingerprint"] for r in against_next(docs_of(rows), window=window).collect()}
        kept = [(i, t[:len(t) - len(t) // 2]) for i, t in rows]
        direct = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs_of([r for r in kept if r[1]]), window=window).collect()}
        assert len(direct) == 600 and {i: got[i] for i in direct} == direct
