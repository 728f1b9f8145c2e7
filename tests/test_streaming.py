"""Streams that stop, start again and see late rows give what a batch over all rows gives."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trialmesh.session import new_path
from trialmesh.sources import files as src
from trialmesh.streaming import events as ev, state as st


def rows_of(spark, rows, folder, kind):
    spark.createDataFrame(rows, kind).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).parquet(folder)


def test_state_survives_restarts_with_and_without_new_data(spark):
    kind, inbox, state = "k long, o long, a string, b double", new_path(spark, "in"), new_path(spark, "state")
    batches = [[(i % 9, i, f"a{i}" if i % 2 else None, None) for i in range(40)], [(3, 100, None, 0.1), (77, 5, "x", 1e300)], [(3, 50, "late", 2.0), (8, 200, "z", None), (None, 1, "", None)]]
    every = []
    for rows in batches:
        every += rows
        for attempt in range(2):  # the second time nothing is new
            stream = rows_of(spark, rows, inbox, kind) if attempt == 0 else spark.readStream.schema(kind).parquet(inbox)
            got = st.stream_state(stream, "k", "o", ["a", "b"], state)
            want = ev.merge_state(spark.createDataFrame(every, kind), "k", "o", ["a", "b"])
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)


def test_keys_expire_by_timers_and_start_again(spark):
    kind, inbox, state, expired = "k string, at timestamp_ntz, n long", new_path(spark, "in"), new_path(spark, "state"), new_path(spark, "expired")
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    steps = [([("a", day(0), 1), ("b", day(0), 2), ("b", day(0), 3), ("c", None, 4)], {("a", 1, True), ("b", 3, True)}),
             ([("a", day(6), 5), ("d", day(7), 6)], {("a", 5, True), ("b", 3, True), ("d", 6, True)}),  # the watermark is an hour short
             ([("e", day(7.1), 7)], {("a", 5, True), ("b", 3, False), ("d", 6, True), ("e", 7, True)}),
             ([("b", day(12), 8), ("a", day(6), 9)], {("a", 5, True), ("b", 8, True), ("d", 6, True), ("e", 7, True)}),  # a's row is late
             ([("f", day(13.5), 10)], {("a", 5, False), ("b", 8, True), ("d", 6, True), ("e", 7, True), ("f", 10, True)})]
    for rows, want in steps:
        stream = rows_of(spark, rows, inbox, kind)
        got = st.stream_expire_keys(stream, "k", "at", "n", state, expired)
        assert {(r["k"], r["n"], r["alive"]) for r in got.collect()} == want and got.count() == len(want)
    assert got.where("k = 'e'").first()["at"] == day(7.1)


def test_completions_wait_for_outputs_of_later_batches(spark):
    left, right, out, offsets = (new_path(spark, n) for n in ("completions", "outputs", "joined", "offsets"))
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    steps = [([("a", 1, at(0)), ("b", 2, at(0)), ("c", 3, at(1))], [("a", "x", at(2)), ("b", "early", at(-1))], {("a", 1, "x")}),
             ([("d", 4, at(3))], [("a", "late", at(3.5)), ("c", "y", at(3))], {("a", 1, "x"), ("c", 3, "y")}),  # too late for a
             ([("z", 9, at(9))], [("z", "w", at(9))], {("a", 1, "x"), ("c", 3, "y"), ("z", 9, "w"), ("b", 2, None), ("d", 4, None)})]
    for completed, stored, want in steps:
        c = rows_of(spark, completed, left, "k string, id long, done timestamp")
        o = rows_of(spark, stored, right, "k string, what string, stored timestamp")
        got = ev.stream_join_completed(c, o, "k", "done", "stored", "3 HOURS", "1 hour", out, offsets)
        assert {(r["k"], r["id"], r["what"]) for r in got.collect()} == want and got.count() == len(want)


def test_lists_keep_their_order_over_batches(spark):
    kind, inbox, log, offsets = "k long, o long, item string, s string", new_path(spark, "in"), new_path(spark, "log"), new_path(spark, "offsets")
    every = []
    for rows in ([(1, 5, "e", "s5"), (1, 3, "c", None)], [(1, 4, "d", None), (2, 1, "x", "q")], [(1, 1, "a", "late")]):
        every += rows
        for attempt in range(2):
            stream = rows_of(spark, rows, inbox, kind) if attempt == 0 else spark.readStream.schema(kind).parquet(inbox)
            got = ev.stream_append_state(stream, "k", "o", "item", ["s"], log, offsets, page_size=4)
            want = ev.append_state(spark.createDataFrame(every, kind), "k", "o", "item", ["s"], page_size=4)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    assert {r["page"]: r["items"] for r in got.where("k = 1").collect()} == {0: ["a", "c"], 1: ["d", "e"]}


def test_first_copy_of_an_event_stays(spark):
    df = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, "only"), (1, None, "unknown")], "id long, ts long, what string")
    assert {(r["id"], r["what"]) for r in ev.dedupe_events(df, "id").collect()} == {(1, "first"), (2, "only")}


def test_leaderboard_files_come_back_as_they_were(spark):
    texts = ['say "hi", ok', "two\nlines", ' "" ', "a,b;c", "back\\slash \\\" end", None, "é世🙂"]
    runs = spark.createDataFrame([(i, f"e{i}", {"r2": 0.5, 'x "y"': 1.0}, t) for i, t in enumerate(texts)], "round int, experiment_id string, secondary_metrics map<string,double>, error_summary string")
    path = src.write_leaderboard(runs, new_path(spark, "leaderboard"))
    back = src.read_csv_table(spark, path, ", ".join(f"{c} {'int' if c == 'round' else 'string'}" for c in src.LEADERBOARD_COLUMNS)).orderBy("round")
    assert [(r["error_summary"], r["m"]) for r in back.withColumn("m", F.from_json("secondary_metrics", "map<string,double>")).collect()] == [(t, {"r2": 0.5, 'x "y"': 1.0}) for t in texts]


def test_upsert_counts_a_repeated_key_once(spark):
    target = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "k long, v string, n int")
    source = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (3, "c", 1), (3, "c", 1)], "k long, v string, n int")
    assert sorted(map(tuple, src.upsert(target, source, ["k"], order="n").collect())) == [(1, "b", 2), (2, "old", 0), (3, "c", 1)]
    assert sorted(r["k"] for r in src.upsert(target, source, ["k"], insert_only=True).collect()) == [1, 2, 3]
