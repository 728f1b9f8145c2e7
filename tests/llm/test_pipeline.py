import hashlib
import importlib.util
import os

import numpy as np
import pytest

import corpus_pipeline
from test_minhash import brute
from test_text_stages import brute_lines, edit_distance
from trialmesh.llm import decontaminate as dc, quality, queries


@pytest.fixture
def small(spark, tmp_path, prose):
    """A folder of small tables: texts with copies, shared lines, a leak and junk."""
    item = "which of these seven answers was never given to anybody who asked for it at the old station"
    rows = [(i, t) for i, t in prose if t is None or len(t) < 800] + [(2000, f"first words {item} last words"), (2001, f"a b {item.upper()}")]
    rows += [(3000 + i, "zq$$$ xv### " * 40 + f"!!! {i}") for i in range(40)]
    good = [i for i, _ in rows if i < 3000]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good] + [(3000 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows, item


def test_stages_equal_a_plain_version(spark, small):
    folder, rows, item = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.score_quality(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    want = [(i, t) for i, t in rows if scored[i]]
    assert {i for i, _ in want}.isdisjoint(range(3000, 3040)) and len(want) > 0.9 * (len(rows) - 40)
    lines = brute_lines(want)
    want = [(i, lines[i][2]) for i, _ in want]
    groups = {i: c for i, _, c in brute(want, 5, 80)}
    want = [(i, t) for i, t in want if groups[i] == i]
    want = [(i, t) for i, t in want if not t or edit_distance(item, dc.normalized(t)) > dc.budget(len(item), 0.05)]
    steps = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = stage(spark, steps, folder)
        assert steps.columns == docs.columns, name
    assert sorted((r["doc_id"], r["text"], r["extra"]) for r in steps.collect()) == sorted((i, t, 5) for i, t in want)
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, t) for i, t in want)
    for r in got:
        assert r["n_tokens"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


def test_pipeline_of_odd_rows_and_of_none(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _some boolean"
    same = "one line that is shared by all of them here\nand words of its own "
    rows = [(None, None, None, None, None, None), (None, same + "x", "en", "s", 1, True), (1, "", "en", "s", 0, None), (1, same + "one", "en", "s", 0, False),
            (1, same + "one", "en", "s", 0, False), (2, same + "two", None, None, None, None), (3, same + "three", "en", "s", 9, None), (3, None, "en", "s", 9, None)]
    labels, benchmark = "doc_id long, quality int, toxic int", "item_id long, text string"
    for at, some in (("odd", rows), ("none", [])):
        for name, table, columns in (("documents", some, kinds), ("labels", [], labels), ("benchmark", [], benchmark)):
            spark.createDataFrame(table, columns).write.parquet(f"{tmp_path}/{at}/{name}.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    line, rest = same.split("\n")
    want = [(None, ""), (None, same + "x"), (1, ""), (1, rest + "one"), (1, rest + "one"), (2, rest + "two"), (3, same + "three"), (3, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_every_operator_has_its_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in queries.QUERIES)] == []
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_subpackage():
    top = os.path.dirname(importlib.util.find_spec("corpus_pipeline").origin)
    for folder, _, files in os.walk(f"{top}/trialmesh"):
        for name in files:
            if name.endswith(".py") and "/llm" not in folder:
                assert "trialmesh.llm" not in open(f"{folder}/{name}", encoding="utf-8").read(), name
