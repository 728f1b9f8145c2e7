"""Winners, leaderboards, latest rows, transcripts and small ordered samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trialmesh.scale import rank_rows, top_rows

# Metrics where a smaller score is better.
LOWER_IS_BETTER = ("root_mean_squared_error", "mean_absolute_error")


def better_first(score: str | Column, metric: str | None = None) -> Column:
    """A key that sorts the better score first under ``metric``'s direction."""
    value = F.col(score) if isinstance(score, str) else score
    return value if metric in LOWER_IS_BETTER else -value


def first_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Earliest row per key."""
    return top_rows(df, [key] if isinstance(key, str) else key, order)


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key; ``order`` names the age columns, most significant first."""
    return top_rows(df, [key] if isinstance(key, str) else key, [F.col(c).desc() for c in order])


def round_winners(runs: DataFrame, seq: Sequence[str], metric: str | None = None) -> DataFrame:
    """Best completed, scored run of each round; ties go to the one submitted first."""
    scored = runs.where((F.col("status") == "completed") & F.col("score").isNotNull())
    return top_rows(scored, ["run_id", "round"], [better_first("score", metric), *map(F.col, seq)])


def leaderboard(runs: DataFrame, seq: Sequence[str], metric: str | None = None, cells: int | None = None, **scale) -> DataFrame:
    """Ranked experiments of every run, missing scores last, with the best one and each round's winner marked.

    ``seq`` is the submission order (first column numeric) and breaks all ties.
    """
    ranked = rank_rows(runs, ["run_id"], better_first("score", metric), list(seq), "rank", cells, **scale)
    keys = ["run_id", "round", *seq]
    winners = round_winners(runs, seq, metric).select(*keys, F.lit("supported").alias("hypothesis_result"))
    return ranked.join(winners, keys, "left").withColumn("is_best", F.col("rank") == 1).withColumn(
        "hypothesis_result", F.coalesce("hypothesis_result", F.lit("inconclusive")))


def best_so_far(runs: DataFrame, seq: Sequence[str], metric: str | None = None) -> DataFrame:
    """Per round: best score of all earlier rounds and the pipeline that made it (``survivor``).

    Rounds are reduced to their best run first, so the window sees one row per round.
    """
    best = top_rows(runs.where(F.col("score").isNotNull()), ["run_id", "round"],
                    [better_first("score", metric), *map(F.col, seq)])
    rounds = runs.select("run_id", "round").distinct().join(
        best.select("run_id", "round", "score", "pipeline"), ["run_id", "round"], "left")
    order = F.struct(better_first("score", metric).alias("s"), F.col("round").alias("r"))
    earlier = W.partitionBy("run_id").orderBy("round").rangeBetween(W.unboundedPreceding, -1)
    pick = F.min_by(F.struct("score", "pipeline"), F.when(F.col("score").isNotNull(), order)).over(earlier)
    return rounds.withColumn("_best", pick).select(
        "run_id", "round", F.col("_best.score").alias("best_score"), F.col("_best.pipeline").alias("survivor"))


def last_n_per_key(df: DataFrame, key: str, order: Sequence[str], n: int, where: Column | None = None) -> DataFrame:
    """Newest ``n`` matching rows per key."""
    rows = df if where is None else df.where(where)
    return top_rows(rows, [key], [F.col(c).desc() for c in order], n)


def transcript(messages: DataFrame, lines_per_page: int = 1000) -> DataFrame:
    """Ordered ``ROLE: content`` lines per conversation, in pages of ``lines_per_page`` turns.

    A conversation up to that length is one page; a longer one continues on the next
    page, so no conversation is gathered whole into one cell.
    """
    line = F.concat(F.upper(F.coalesce("role", F.lit("user"))), F.lit(": "), F.coalesce("text", F.lit("")))
    page = F.floor(F.col("turn") / lines_per_page).cast("bigint")
    turns = messages.select("conv_id", page.alias("page"), F.struct("turn", line.alias("line")).alias("t"))
    rows = turns.groupBy("conv_id", "page").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", "page", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"))


def retain_last(log: DataFrame, n: int, order: str = "id") -> DataFrame:
    """Newest ``n`` entries of a log (top-k: each task keeps ``n`` rows)."""
    return log.orderBy(F.col(order).desc()).limit(n)


def sample_rows(df: DataFrame, n: int, drop: str | None = None, order: Sequence[str] = (), non_null: str | None = None) -> DataFrame:
    """First ``n`` rows without the target column; ``non_null`` skips rows missing that column."""
    rows = df if non_null is None else df.where(F.col(non_null).isNotNull())
    rows = rows.orderBy(*order).limit(n)
    return rows.drop(drop) if drop else rows


def pick_by_priority(df: DataFrame, conditions: Sequence[Column], where: Column, order: Sequence[str]) -> DataFrame:
    """One row: the first that meets the earliest condition, else the first that passes ``where``."""
    rank = F.lit(len(conditions))
    for i in reversed(range(len(conditions))):
        rank = F.when(conditions[i], i).otherwise(rank)
    return df.where(where).orderBy(rank, *order).limit(1)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` repeatable random rows (all, when there are fewer)."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
