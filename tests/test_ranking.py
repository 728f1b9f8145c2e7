from pyspark.sql import functions as F

from trialmesh.operators import ranking as rk, tabular as tb

RUNS = "run_id string, round int, seq bigint, status string, score double, pipeline string"


def mock_runs(spark, rounds=3, per_round=3):
    """Mock mode: score = 0.65 + 0.03 · round + 0.01 · last digit of the experiment id."""
    rows = [("r", n, n * 10 + i, "completed", round(0.65 + 0.03 * n + 0.01 * i, 4), f"p{i}") for n in range(1, rounds + 1) for i in range(1, per_round + 1)]
    return spark.createDataFrame(rows, RUNS)


def test_mock_scores(spark):
    runs = mock_runs(spark)
    winners = {r["round"]: (r["seq"], r["score"]) for r in rk.round_winners(runs, ["seq"]).collect()}
    assert winners == {1: (13, 0.71), 2: (23, 0.74), 3: (33, 0.77)}
    board = rk.leaderboard(runs, ["seq"]).orderBy("rank").collect()
    assert [b["seq"] for b in board][:4] == [33, 32, 31, 23] and board[0]["is_best"] and not board[1]["is_best"]
    assert {b["seq"] for b in board if b["hypothesis_result"] == "supported"} == {13, 23, 33}


def test_ties_nulls_and_failures(spark):
    runs = spark.createDataFrame([
        ("r", 1, 1, "failed", 0.9, "a"), ("r", 1, 2, "completed", 0.5, "b"), ("r", 1, 3, "completed", 0.5, "c"),
        ("r", 2, 4, "completed", None, "d"), ("r", 3, 5, "completed", 0.0, "e")], RUNS)
    winners = {r["round"]: r["seq"] for r in rk.round_winners(runs, ["seq"]).collect()}
    assert winners == {1: 2, 3: 5}
    order = [r["seq"] for r in rk.leaderboard(runs, ["seq"]).orderBy("rank").collect()]
    assert order == [1, 2, 3, 5, 4]
    cells = [r["seq"] for r in rk.leaderboard(runs, ["seq"], cells=4).orderBy("rank").collect()]
    assert cells == order


def test_lower_is_better(spark):
    runs = mock_runs(spark)
    assert tb.select_winner(runs, "mean_absolute_error", ["seq"]).first()["seq"] == 11
    assert tb.select_winner(runs, "roc_auc", ["seq"]).first()["seq"] == 33


def test_best_so_far_sees_only_earlier_rounds(spark):
    runs = spark.createDataFrame([("r", 1, 1, "completed", 0.8, "a"), ("r", 2, 2, "completed", 0.9, "b"), ("r", 3, 3, "completed", 0.7, "c"),
                                  ("r", 10, 4, "completed", 0.1, "d")], RUNS)
    best = {r["round"]: (r["best_score"], r["survivor"]) for r in rk.best_so_far(runs, ["seq"]).collect()}
    assert best == {1: (None, None), 2: (0.8, "a"), 3: (0.9, "b"), 10: (0.9, "b")}


def test_transcript_pages(spark):
    said = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (1, 2, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    pages = {r["page"]: r["transcript"] for r in rk.transcript(said, 2).collect()}
    assert pages == {0: "USER: a\nUSER: b", 1: "ASSISTANT: "}


def test_sample_n_repeats_and_caps(spark):
    df = spark.range(10).select(F.col("id").alias("k"))
    a, b = ([r["k"] for r in rk.sample_n(df, "k", n).collect()] for n in (4, 100))
    assert len(a) == 4 and a == b[:4] and sorted(b) == list(range(10))
