import numpy as np
import pytest

from trialmesh.operators import vector_index as vi


def table(spark, rows, name):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], float(i % 3)) for i, v in rows], f"{name} long, vec array<double>, payload double").repartition(3)


def brute(rows, queries, k):
    found = {}
    for qid, q in queries:
        if q is not None:
            far = sorted((round(float(np.sqrt(((np.asarray(v) - q) ** 2).sum())), 9), i) for i, v in rows if v is not None)
            found[qid] = far[:k]
    return found


def listed(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["distance"], r["key"]))
        assert r["payload"] == r["key"] % 3 and r["rank"] == len(got[r["qid"]])
    return got


@pytest.fixture(scope="module")
def groups():
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 8)) * 20
    rows = [(i, centres[0 if i % 3 == 0 else i % 12] + draw.normal(size=8)) for i in range(900)]  # one group holds a third
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, np.zeros(8)), (2001, None)]
    return rows


def test_exact_search_equals_brute_force(spark, groups, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vi, "QUERY_ROWS", 7)
    queries = [(i, v) for i, v in groups if i % 20 == 0] + [(5000, np.full(8, 1e3)), (5001, None)]
    index = vi.build_index(table(spark, groups, "key"))
    assert index.sizes.sum() == 941
    assert listed(vi.search(index, table(spark, queries, "qid"), 10)) == brute(groups, queries, 10)


def test_share_reads_a_fifth_and_finds_nine_tenths(spark, groups):
    queries = [(i, v) for i, v in groups if i % 20 == 0 and v is not None]
    index = vi.build_index(table(spark, groups, "key"))
    got, want = listed(vi.search(index, table(spark, queries, "qid"), 10, share=0.2)), brute(groups, queries, 10)
    recall = {q: np.mean([any(abs(d - x) < 1e-9 for x, _ in got[q]) for d, _ in want[q]]) for q in want}
    assert min(recall.values()) >= 0.9


def test_few_rows_and_none(spark, groups):
    one = vi.build_index(table(spark, groups[:3], "key"))
    assert listed(vi.search(one, table(spark, groups[:1], "qid"), 10)) == brute(groups[:3], groups[:1], 10)
    assert vi.build_index(table(spark, [], "key")) is None
    assert vi.search(None, table(spark, groups[:1], "qid"), 3).collect() == []
    assert vi.search(one, table(spark, [], "qid"), 3).collect() == []


def test_search_by_regions_equals_brute_force(spark, groups, monkeypatch):
    for name, size in (("REGION_ROWS", 40), ("REGION_QUERIES", 7), ("SMALL_BLOCK", 9), ("SMALL_GROUP", 5)):
        monkeypatch.setattr(vi, name, size)
    queries = [(i, v) for i, v in groups if i % 20 == 0] + [(5000, np.full(8, 1e3)), (5001, None)]
    index = vi.build_regions(table(spark, groups, "key"), 10)
    assert len(index.sizes) > 10 and index.sizes.sum() == 941 - 31  # of 41 equal vectors ten can be among the nearest
    assert listed(vi.search_regions(index, table(spark, queries, "qid"), 10)) == brute(groups, queries, 10)


def test_regions_of_few_rows_and_none(spark, groups):
    one = vi.build_regions(table(spark, groups[:3], "key"), 10)
    assert listed(vi.search_regions(one, table(spark, groups[:1], "qid"), 10)) == brute(groups[:3], groups[:1], 10)
    assert vi.build_regions(table(spark, [], "key"), 3) is None
    assert vi.search_regions(None, table(spark, groups[:1], "qid"), 3).collect() == []
    assert vi.search_regions(one, table(spark, [], "qid"), 3).collect() == []


def test_near_queries_read_few_blocks(monkeypatch):
    """The work of a region must not grow with queries times rows."""
    import pandas as pd
    draw, pairs, far = np.random.default_rng(5), [0], vi._far
    monkeypatch.setattr(vi, "_far", lambda q, v: pairs.__setitem__(0, pairs[0] + len(q) * len(v)) or far(q, v))
    v, q = draw.random((20_000, 3)), draw.random((2_000, 3))
    right = pd.DataFrame({"key": np.arange(len(v)), "vec": list(v), "payload": 0.0})
    got = vi._nearest_by_boxes(pd.DataFrame({"qid": np.arange(len(q)), "vec": list(q)}), right, 5)
    assert len(got) == 10_000 and pairs[0] < 0.25 * len(q) * len(v)


def test_second_round_stays_within_the_bound(monkeypatch):
    """A query that knows its k-th distance compares and returns nothing beyond it."""
    import pandas as pd
    draw, pairs, far = np.random.default_rng(6), [0], vi._far
    monkeypatch.setattr(vi, "_far", lambda q, v: pairs.__setitem__(0, pairs[0] + len(q) * len(v)) or far(q, v))
    v, q = draw.random((5_000, 3)), draw.random((300, 3)) + [1.0, 0, 0]
    right = pd.DataFrame({"key": np.arange(len(v)), "vec": list(v), "payload": 0.0})
    got = vi._nearest_by_boxes(pd.DataFrame({"qid": np.arange(len(q)), "vec": list(q), "bound": 0.1}), right, 5)
    want = [sum(sorted(round(float(d), 9) for d in np.sqrt(((v - x) ** 2).sum(axis=1)))[i] <= 0.1 for i in range(5)) for x in q]
    assert got.groupby("qid").size().reindex(range(len(q)), fill_value=0).tolist() == want and (got["distance"] <= 0.1 + 1e-5).all()
    assert 0 < sum(want) < len(q) and pairs[0] < 0.05 * len(q) * len(v)


def test_dimensions_alike_in_all_rows_are_not_stored(spark):
    draw = np.random.default_rng(7)
    rows = [(i, np.array([3.0, draw.random(), 0.0, draw.random(), -1.0])) for i in range(200)]
    queries = [(i, draw.random(5) * 4) for i in range(20)]
    index = vi.build_regions(table(spark, rows, "key"), 4)
    assert {len(r["vec"]) for r in index.table.collect()} == {8 * 3}
    assert listed(vi.search_regions(index, table(spark, queries, "qid"), 4)) == brute(rows, queries, 4)


def test_scattered_queries_read_few_blocks(monkeypatch):
    """Queries that lie apart do not read the blocks of each other."""
    import pandas as pd
    draw, pairs, far = np.random.default_rng(9), [0], vi._far
    monkeypatch.setattr(vi, "_far", lambda q, v: pairs.__setitem__(0, pairs[0] + len(q) * len(v)) or far(q, v))
    v, q = draw.random((20_000, 5)), draw.random((1_000, 5))
    right = pd.DataFrame({"key": np.arange(len(v)), "vec": list(v), "payload": 0.0})
    got = vi._nearest_by_boxes(pd.DataFrame({"qid": np.arange(len(q)), "vec": list(q)}), right, 5)
    assert pairs[0] < 0.15 * len(q) * len(v)
    for i in range(0, len(q), 50):
        want = sorted((round(float(d), 9), j) for j, d in enumerate(np.sqrt(((v - q[i]) ** 2).sum(axis=1))))[:5]
        assert list(zip(got["distance"][got["qid"] == i], got["key"][got["qid"] == i], strict=True)) == want


def test_ties_and_many_pairs_are_cut_to_the_first_rows(monkeypatch):
    """Pairs held at once are bounded; of many rows equally far those of the smallest keys stay."""
    import pandas as pd
    for name, size in (("MOST_PAIRS", 50), ("PAIR_ROWS", 13), ("SMALL_GROUP", 7), ("SMALL_BLOCK", 32)):
        monkeypatch.setattr(vi, name, size)
    draw = np.random.default_rng(10)
    v, q = np.unique(draw.integers(0, 2, (4_000, 7)), axis=0).repeat(3, axis=0).astype(float), draw.integers(0, 2, (60, 7)).astype(float)
    keys = draw.permutation(len(v))
    got = vi._nearest_by_boxes(pd.DataFrame({"qid": np.arange(len(q)), "vec": list(q)}), pd.DataFrame({"key": keys, "vec": list(v), "payload": 0.0}), 5)
    for i in range(len(q)):
        want = sorted((round(float(d), 9), int(j)) for j, d in zip(keys, np.sqrt(((v - q[i]) ** 2).sum(axis=1)), strict=True))[:5]
        assert list(zip(got["distance"][got["qid"] == i], got["key"][got["qid"] == i], strict=True)) == want
