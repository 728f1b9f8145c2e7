import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trialmesh.llm import fill_middle as fm


def brute(doc_id, text, unit="line", rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["\n", "\n\n\n", "a\nb", "é\n世界\n🙂🙂\nx", "no <P> here", "<M>", "half < P> <S", "x<\n>S>\n<\nP\n>", "\r\n\x0b \n\x85é", "🙂", "a\x00b\n\x00", "\n".join(["line é"] * 3000)]


def test_forms_and_round_trip(spark, docs_of, prose):
    rows = prose + [(500 + i, t) for i, t in enumerate(ODD)] + [(None, "a\nb\nc"), (None, None), (500, "twice\nthe same id"), (500, "twice\nthe same id")]
    for options in ({}, {"unit": "character"}, {"rate": 40, "spm": 90}):
        out = fm.fill_in_middle(docs_of(rows), **options)
        out = out.withColumn("back", fm.restored(F.col("form"), F.col("output"))).collect()
        assert Counter((r["doc_id"], *r[1:6], r["back"]) for r in out) == Counter((i, *brute(i, t, **options), t or "") for i, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark, docs_of):
    assert fm.fill_in_middle(docs_of([(1, "a")]).limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_index_converts_both_ways(text):
    index = fm.Exceptions(np.frombuffer(text.encode(), np.uint8))
    for i in range(len(text) + 1):
        at = len(text[:i].encode())
        assert index.to_chars(at) == i and index.to_bytes(i) == at
    assert len(index.at) == sum(ord(c) > 127 for c in text)
