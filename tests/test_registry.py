from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trialmesh.functions import config as cf, text as tx
from trialmesh.operators import profile as pf, registry as rg, sets
from trialmesh.sources import files as src
from trialmesh.streaming import events as ev, state as st


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    cases = [
        (tx.slugify(F.lit("  A b__C! ")), "a_b_c"), (tx.slugify(F.lit("!!"), "-", "dataset"), "dataset"), (tx.slugify(F.lit(None).cast("string")), "architecture"),
        (tx.mask_secret(F.lit("12345678")), "••••"), (tx.mask_secret(F.lit("123456789")), "1234••••6789"), (tx.mask_secret(F.lit("")), None),
        (tx.data_format(F.lit("S3://X/a.CSV?x=.pdf")), "csv"), (tx.data_format(F.lit("a.txt")), None),
        (tx.url_domain(F.lit("https://www.a.www.b.com/p")), "a.b.com"), (tx.url_domain(F.lit("no url")), ""),
        (tx.display_value(F.lit(123.456)), "123.46"), (tx.display_value(F.lit(0.5)), "0.5"), (tx.display_value(F.lit(2.0)), "2"), (tx.display_value(F.lit(None).cast("double")), "N/A"),
        (tx.metric_label(F.lit("top5acc_x")), "Top5Acc X"), (tx.metric_label(F.lit("mcc")), "MCC"),
        (tx.improvement_pct(F.lit(0.0), F.lit(5.0)), 0), (tx.improvement_pct(F.lit(200.0), F.lit(50.0)), 50),
        (tx.roi_signal(F.lit("cut 12 % or 2.5–4 h")), "12%"), (tx.roi_signal(F.lit("2.5–4 h")), "2.5–4h"), (tx.roi_signal(F.lit(None).cast("string")), "—"), (tx.roi_signal(F.lit("soon")), "Estimated"),
        (cf.answers_to_text(F.lit('{"answers": {"9": "x", "10": true}}')), "x\nTrue"), (cf.answers_to_text(F.lit('{"answers": ["a", 2]}')), "a\n2"),
        (cf.answers_to_text(F.lit('{"approved": false}')), "Not approved."), (cf.answers_to_text(F.lit("{}")), ""),
        (cf.decode_payload(F.lit("{bad"), F.struct(F.lit(1).alias("a"))), '{"raw":"{bad"}'), (cf.decode_payload(F.lit(""), F.struct(F.lit(1).alias("a"))), '{"a":1}'),
        (cf.coerce_value(F.lit("5d"))["kind"], "text"), (cf.coerce_value(F.lit("1e3"))["as_double"], 1000.0), (cf.coerce_value(F.lit(" 7 "))["as_int"], 7),
        (cf.period_start(F.lit("2024-02-29 23:59:59").cast("timestamp_ntz")), datetime(2024, 2, 1)),
    ]
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (_, want) in enumerate(cases):
        assert row[f"c{i}"] == want, (i, row[f"c{i}"], want)


def test_resolve_columns(spark):
    header = spark.createDataFrame([("d", ["Churn", "churn", "Monthly Charges", "id"])], "dataset string, header array<string>")
    asked = spark.createDataFrame([("d", "churn"), ("d", "CHURN"), ("d", "monthly_charges"), ("d", "nothing"), ("none", "x")], "dataset string, requested string")
    got = {r["requested"]: (r["resolved"], r["tier"]) for r in rg.resolve_columns(asked, header).collect()}
    assert got == {"churn": ("churn", "exact"), "CHURN": ("churn", "casefold"), "monthly_charges": ("Monthly Charges", "alphanumeric"),
                   "nothing": (None, "unresolved"), "x": (None, "unresolved")}
    seen = {r["requested"]: (r["resolved"], r["mismatch"]) for r in rg.resolve_columns(asked, header, "suggest").collect()}
    assert seen["CHURN"] == ("Churn", False) and seen["nothing"] == ("Churn", True) and seen["x"] == ("x", False)


def test_profile(spark):
    df = spark.createDataFrame([("a", 1, None, True), ("a", 2, None, False), (None, 3, None, None), ("b", 4, "z", True), ("b", 4, None, True)],
                               "t string, n int, s string, f boolean")
    shape = pf.profile_shape(df).first()
    assert (shape["rows"], shape["columns"], shape["missing_cells_ratio"]) == (5, 4, 6 / 20)
    target = pf.profile_target(df, "t").collect()
    assert {(r["class"], r["n"]) for r in target} == {("a", 2), ("b", 2)} and target[0]["missing_ratio"] == 0.2 and target[0]["imbalance_ratio"] == 1.0
    flags = {r["name"]: r for r in pf.profile_features(df, "t").collect()}
    assert flags["s"]["constant"] and flags["s"]["mostly_missing"] and flags["n"]["high_cardinality"] and flags["f"]["kind"] == "categorical"
    empty = df.where("n > 99")
    assert pf.profile_shape(empty).first()["missing_cells_ratio"] == 0 and pf.profile_target(empty, "t").count() == 0


def test_round_summaries_order_rounds_as_numbers(spark):
    rows = spark.createDataFrame([("r", "10", "e1", "completed"), ("r", "2", "e2", "failed")], "run_id string, round string, experiment_id string, status string")
    scores = spark.createDataFrame([("r", "10", "e1", 0.5)], "run_id string, round string, experiment_id string, primary_metric_value double")
    assert [(r["round"], r["primary_metric_value"]) for r in pf.round_summaries(rows, scores).collect()] == [(2, None), (10, 0.5)]


def test_merge_messages(spark):
    s = "conv_id int, turn int, role string, agent string, content string, card_type string, card_data string"
    old = spark.createDataFrame([(1, 0, "user", "x", "Hi  there", None, None), (1, 1, "agent", "p", "Plan", None, None)], s)
    new = spark.createDataFrame([(1, 5, "user", "y", " hi there ", None, None), (1, 6, "agent", "p", "plan", "card", None), (1, 7, "agent", "q", "plan", None, None),
                                 (1, 8, "agent", "p", "PLAN", "card", "{}"), (1, 9, "agent", "p", "plan", "other", "{}")], s)
    rows = sorted((r["first_turn"], r["agent"], r["content"], r["card_data"]) for r in sets.merge_messages(old, new, ["turn"]).collect())
    assert rows == [(0, "x", "Hi  there", None), (1, "p", "PLAN", "{}"), (7, "q", "plan", None)]


def test_merge_messages_equals_the_fold(spark):
    import random
    rng = random.Random(11)
    rows = [(k, turn, "agent", "p", "same", rng.choice(["", "", "card"]), rng.choice(["", "{}"]) if k % 2 else "") for k in range(30) for turn in range(rng.randrange(1, 9))]
    rows += [(99, i, "agent", "p", "same", *(("card", "") if i % 2 else ("", "{}"))) for i in range(7)]
    s = "conv_id int, turn int, role string, agent string, content string, card_type string, card_data string"
    df = spark.createDataFrame(rows, s)
    got = {r["conv_id"]: (r["card_type"], r["card_data"]) for r in sets.merge_messages(df, df.where("false"), ["turn"]).collect()}
    want = {}
    for k, _, _, _, _, t, d in sorted(rows, key=lambda r: (r[0], r[1])):
        kept = want.get(k)
        if kept is None or (t and not kept[0]) or (d and not kept[1]):
            want[k] = (t, d)
    assert got == want


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("﻿ id , name\n1,a\n2,\n".encode())
    df = src.read_csv_table(spark, str(tmp_path / "t.csv"), required=["id", "name"])
    assert df.columns == ["id", "name"] and df.count() == 2
    with pytest.raises(ValueError):
        src.read_csv_table(spark, str(tmp_path / "t.csv"), required=["label"])
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        src.read_csv_table(spark, str(tmp_path / "empty.csv"))
    for name, doc in (("r1", '{"status": "running"}'), ("r2", "{oops"), ("r3", '{"run_id": "x", "status": "failed", "error": "e"}')):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "status.json").write_text(doc)
    runs = {r["run_id"]: r["is_active"] for r in src.scan_status_documents(spark, str(tmp_path / "runs" / "*")).collect()}
    assert runs == {"r1": True, "x": False}
    files = {r["name"]: r["extension"] for r in src.scan_files(spark, str(tmp_path / "runs"), True).collect()}
    assert files == {"status.json": "json"}
    (tmp_path / "nothing").mkdir()
    with pytest.raises(FileNotFoundError):
        src.scan_files(spark, str(tmp_path / "nothing"))


def test_streams_equal_batch(spark, tmp_path):
    from trialmesh.session import new_path
    rows = [(i, datetime(2024, 1, 1 + i % 3), f"u{i % 4}", None if i % 2 else f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user string, step string")
    log = str(tmp_path / "log")
    for part in range(3):
        df.where(f"event_id % 3 = {part}").coalesce(1).write.mode("append").parquet(log)
    df.where("event_id < 10").coalesce(1).write.mode("append").parquet(log)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(log)
    out = str(tmp_path / "out")
    ev.dedupe_events(stream(), "event_id").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 40
    state = st.stream_state(stream(), "user", "event_id", ["step"], str(tmp_path / "state"))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, ev.merge_state(df, "user", "event_id", ["step"]).collect()))
    assert new_path(spark, "x") != new_path(spark, "x")


def test_usage_and_poll(spark):
    usage = spark.createDataFrame([(1, 3, 0, 2, 50)], "organization_id int, use_cases int, exa_datasets int, rag_trials int, training_runs int")
    plans = spark.createDataFrame([(1, " PRO ")], "organization_id int, plan string")
    got = {r["item"]: (r["limit"], r["percent"]) for r in pf.usage_vs_limits(usage, plans).collect()}
    assert got == {"useCases": (3, 100), "exaDatasets": (10, 0), "ragTrials": (5, 40), "trainingRuns": (10, 100)}
    log = spark.createDataFrame([(i, "a" if i < 5 else "b", "{}") for i in range(1, 9)], "id bigint, session_id string, payload string")
    page = ev.poll_events(log, 1, 3, "b").collect()
    assert [(r["kind"], r["id"]) for r in page] == [("cursor", 4)]
    assert ev.poll_events(log, 8, 3, "b").first()["id"] == 8


def test_metrics_are_rounded_from_their_binary_value(spark):
    import random
    from decimal import ROUND_HALF_UP, Decimal

    from trialmesh.functions import text as tx
    draw = random.Random(9)
    values = [0.00015, 0.00025, 0.03125, 0.09375, -0.03125, 2.00005, 1e-5, -1e-5, 0.0, 12345678.00005, 0.99995, 99.99995, 1.00345, 5e-5, -0.00015]
    values += [draw.randrange(10 ** 6) / 20000 * draw.choice([1, -1]) for _ in range(2000)] + [draw.random() for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", tx.format_metric("v").alias("f"), tx.display_value("v").alias("d")).collect()
    for r in rows:
        assert r["f"] == f"{r['v']:.4f}", r["v"]
        digits = 2 if abs(r["v"]) >= 100 else 4
        want = f"{Decimal(abs(r['v'])).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP):f}"
        want = want if digits == 2 else want.rstrip("0").rstrip(".")
        assert r["d"].lstrip("-") == want, r["v"]


def test_status_documents_are_listed_from_their_root(spark, tmp_path):
    """Many run folders are one path to list in tasks, not a path each on the driver; files beside and below them count as before."""
    for name, doc in (("r1/status.json", '{"status": "running"}'), ("r2/deep/status.json", '{"status": "failed"}'), ("top.json", '{"run_id": "t", "status": "queued"}'), ("_r3/status.json", '{"status": "running"}')):
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text(doc)
    for pattern in ("*", "*/"):
        found = src.scan_status_documents(spark, str(tmp_path / "runs") + "/" + pattern)
        assert {(r["run_id"], r["status"]) for r in found.collect()} == {("r1", "running"), ("deep", "failed"), ("t", "queued")}
        assert found._jdf.queryExecution().toString().count("InMemoryFileIndex(1 paths)") > 0
