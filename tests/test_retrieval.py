import html
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialmesh.functions import python_text as pt
from trialmesh.functions.text import terms
from trialmesh.operators import chunking as ch, rag_rounds, retrieval as rt, udfs

WORDS = "running runs runner cat cats happy happily relational data model the of and to a in for search engine".split()


def corpus(spark, n=60, seed=1):
    rng = random.Random(seed)
    docs = [(i, ". ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 12))).capitalize() for _ in range(rng.randrange(1, 6))) + ".") for i in range(n)]
    return docs, spark.createDataFrame(docs, "doc_id bigint, contents string")


def toks(text, stem=False):
    out = [w for w in re.split(r"[^\w]+", text.lower()) if w]
    return [pt.porter_stem(w) for w in out] if stem else out


@pytest.mark.parametrize("stem", [False, True])
def test_bm25_brute_force(spark, stem):
    docs, df = corpus(spark)
    queries = [(1, "running cats cats"), (2, "happily searching the data"), (3, "zebra")]
    got = {}
    for r in rt.bm25_topk(spark.createDataFrame(queries, "qid int, query string"), df, 5, stem=stem).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["doc_id"], r["score"])
    bags = {i: Counter(toks(t, stem)) for i, t in docs}
    avg = sum(sum(b.values()) for b in bags.values()) / len(bags)
    for qid, q in queries:
        scores = []
        for i, bag in bags.items():
            s, dl = 0.0, sum(bag.values())
            for w in toks(q, stem):
                n = sum(w in b for b in bags.values())
                if bag[w]:
                    s += math.log(1 + (len(bags) - n + 0.5) / (n + 0.5)) * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * dl / avg))
            if s:
                scores.append((-round(s, 9), i))
        want = [i for _, i in sorted(scores)[:5]]
        assert [got.get(qid, {})[k][0] for k in sorted(got.get(qid, {}))] == want


def test_stemmer():
    # Examples printed in the published algorithm.
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "failing": "fail", "filing": "file", "happy": "happi",
             "sky": "sky", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope",
             "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: pt.porter_stem(w) for w in pairs} == pairs


def vectors(spark, n=300, dims=16, seed=2):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dims))
    return m, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "doc_id bigint, embedding array<double>")


def test_vector_paths_agree(spark):
    m, df = vectors(spark)
    q = df.where("doc_id < 9").withColumnRenamed("doc_id", "qid")
    small = {(r["qid"], r["rank"]): r["doc_id"] for r in rt.vector_topk(q, df, 7).collect()}
    blocks = {(r["qid"], r["rank"]): r["doc_id"] for r in rt.vector_topk(q, df, 7, max_queries=4, block_rows=50).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(i, k + 1): int(j) for i in range(9) for k, j in enumerate(np.argsort(-np.round(unit @ unit[i], 9), kind="stable")[:7])}
    assert small == want and blocks == want
    near = rt.vector_topk(q, df, 1, method="lsh", block_rows=20).collect()
    assert {r["qid"]: r["doc_id"] for r in near} == {i: i for i in range(9)}
    with pytest.raises(ValueError):
        rt.vector_topk(q, df, 1, method="guess")


def test_chunks_cover_the_text(spark):
    rng = random.Random(4)
    texts = ["", "one", "\n\n".join(" ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))) for _ in range(12)), "".join(str(i) for i in range(200))]
    for text in texts:
        pieces = pt.recursive_pieces(text, 80)
        assert "".join(pieces) == text and all(len(p) <= 80 for p in pieces)
        chunks = pt.chunk_recursive_text(text, 80, 20)
        assert all(len(c) <= 80 for c in chunks)
        at = 0
        for c in chunks:
            at = text.index(c, max(0, at - 20))
            at += len(c)
        assert at == len(text) or not text.strip()
    many = " ".join(f"Sentence number {i} ends here." for i in range(50))
    packed = pt.chunk_sentence_text(many, 20, 5)
    assert all(len(c.split()) <= 20 and c.endswith(".") for c in packed)
    assert all(packed[i].split(". ")[-1].rstrip(".") in packed[i + 1] for i in range(len(packed) - 1))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    assert ch.chunk_recursive(df, 80, 20).where("doc_id = 0").count() == 0
    same = [sorted(map(tuple, f.select("doc_id", "chunk_index", "contents").collect())) for f in (
        ch.chunk_token(df, 10, 3), udfs.chunk_udtf(df, "doc_id", "token", 10, 3))]
    assert same[0] == same[1]
    same = [sorted(map(tuple, f.select("doc_id", "chunk_index", "contents").collect())) for f in (
        ch.chunk_character(df, 50, 10), udfs.chunk_udtf(df, "doc_id", "character", 50, 10))]
    assert same[0] == same[1]
    with pytest.raises(ValueError):
        ch.chunk_token(df, 10, 10)


def test_parsers(spark):
    raw = {"html": "<html><style>p{}</style><p>A &amp; B</p><script>var t='</p>';</script><p>C<b>D</b></p>", "xml": "<a><!-- x --><b>1 &lt; 2</b><![CDATA[<c>]]></a>",
           "md": "# Head\n- **bold** [link](http://x)", "csv": "a,b\n1,2\n3,4\n", "json": '[{"a": 1}, {"a": 2}]', "txt": "as is"}
    want = {"html": ["A & B\nCD"], "xml": ["1 < 2\n<c>"], "md": ["Head\nbold link"], "csv": ["a: 1\nb: 2", "a: 3\nb: 4"], "json": ['{"a": 1}', '{"a": 2}'], "txt": ["as is"]}
    for fmt, text in raw.items():
        df = spark.createDataFrame([("p", text)], "path string, content string")
        rows = ch.parse_documents(df, fmt).orderBy("part").collect()
        assert [r["text"] for r in rows] == want[fmt], fmt
    assert html.unescape("&amp;") == "&"
    with pytest.raises(ValueError):
        ch.parse_documents(df, "pdf")


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge(spark):
    rng = random.Random(9)
    pairs = [(i, " ".join(rng.choices(WORDS[:8], k=rng.randrange(0, 15))), " ".join(rng.choices(WORDS[:8], k=rng.randrange(0, 15)))) for i in range(40)]
    df = spark.createDataFrame(pairs + [(0, pairs[0][1], pairs[0][1] or "x")], "id int, candidate string, reference string")
    got = {r["id"]: r for r in rt.rouge(df, ["id"]).collect()}
    for i, c, r in pairs[1:]:
        a, b = c.split(), r.split()
        for n in (1, 2):
            grams = [Counter(tuple(x[k:k + n]) for k in range(len(x) - n + 1)) for x in (a, b)]
            total = sum(grams[0].values()) + sum(grams[1].values())
            assert got[i][f"rouge{n}"] == pytest.approx(2 * sum((grams[0] & grams[1]).values()) / total if total else 0)
        assert got[i]["rougeL"] == pytest.approx(2 * lcs(a, b) / (len(a) + len(b)) if a or b else 0)


def test_term_counts(spark):
    df = spark.createDataFrame([("b a b, a b",), ("",), (None,)], "t string")
    rows = [r["c"] for r in df.select(rt.term_counts(terms("t")).alias("c")).collect()]
    assert [(x["term"], x["tf"]) for x in rows[0]] == [("a", 2), ("b", 3)] and not rows[1] and not rows[2]


def test_containment(spark):
    docs = [(1, "x aa bb cc dd ee ff gg hh ii y"), (2, "aa bb cc dd ee ff gg hh"), (3, "zaa bb cc dd ee ff gg hh iiz"), (4, "one two three")]
    items = [(1, "aa bb cc dd ee ff gg hh ii"), (2, "ne two th")]
    got = rt.qrels_by_containment(spark.createDataFrame(items, "qid int, query string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, s in items for d, t in docs if s in t)


def test_metrics_and_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "a"), (1, "z"), (2, "d"), (3, "e")], "qid int, doc_id string")
    m = rt.retrieval_metrics(hits, qrels).first()
    assert m["retrieval_recall"] == pytest.approx(0.5 / 3) and m["retrieval_precision"] == pytest.approx(0.5 / 3)
    other = spark.createDataFrame([(1, "b", 1)], "qid int, doc_id string, rank int")
    fused = rt.rrf_fuse([hits, other], 10, 2).where("qid = 1").orderBy("rank").collect()
    assert [f["doc_id"] for f in fused] == ["b", "a"]


def test_questions_and_answers(spark):
    docs, df = corpus(spark)
    qa = rt.synthesize_qa(df, 10)
    rows = qa.collect()
    assert len(rows) == 10 and rows == rt.synthesize_qa(df, 10).collect()
    text = dict(docs)
    assert all(r["generation_gt"] in text[r["retrieval_gt"][0]] for r in rows)
    hits = spark.createDataFrame([(1, "cats search", 1, "No match. Cats search data."), (2, "zebra", 1, "Nothing.")], "qid int, query string, rank int, contents string")
    assert {r["qid"]: r["answer"] for r in rt.extract_answers(hits).collect()} == {1: "Cats search data.", 2: rt.NO_ANSWER}


@pytest.mark.parametrize("stem", [False, True])
def test_document_index_gives_the_counts_and_lists_of_postings(spark, stem, monkeypatch):
    _, df = corpus(spark, 150)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "  .. "), (903, "Cat cat CATS")], "doc_id bigint, contents string")
    df = df.unionByName(odd).repartition(3)
    plain, index = rt.postings(df), rt.document_index(df)
    plain, index = (rt.stemmed(plain), rt.stem_documents(index)) if stem else (plain, index)
    assert sorted(map(tuple, index.select("doc_id", "dl", F.inline(F.arrays_zip("term", "tf"))).collect())) == sorted(map(tuple, plain.select("doc_id", "dl", "term", "tf").collect()))
    assert {tuple(r) for r in rt.corpus_size(index).collect()} == {tuple(r) for r in rt.corpus_size(plain, df).collect()}
    asked = spark.createDataFrame([("a", "running cats the the"), ("b", "data model"), ("c", "zebra"), ("d", "of a cat of happy runners")], "qid string, query string")
    search = {"stem": stem, "size": rt.corpus_size(index)}
    wanted = rt.bm25_topk(asked, df, 7, **search).collect()
    assert sorted(wanted) == sorted(rt.bm25_topk(asked, None, 7, index=index, index_stemmed=stem, **search).collect()) and wanted
    for name, few in (("SCORE_CELLS", 8), ("PRODUCTS", 5), ("INDEX_ROWS", 4)):  # small slices, the same lists
        monkeypatch.setattr(rt, name, few)
    assert sorted(wanted) == sorted(rt.bm25_topk(asked, None, 7, index=index, index_stemmed=stem, **search).collect())
    monkeypatch.setattr(rt, "MAX_QUERY_TERMS", 2)  # too many terms to hand out
    assert sorted(wanted) == sorted(rt.bm25_topk(asked, None, 7, index=index, index_stemmed=stem, **search).collect())


def test_document_index_serves_questions_vectors_and_expansions(spark):
    _, df = corpus(spark, 80)
    index, asked = rt.document_index(df), spark.createDataFrame([(1, "running cats. search engine"), (2, "happily")], "qid int, query string")
    assert sorted(rt.synthesize_qa(df, 10).collect()) == sorted(rt.synthesize_qa(df, 10, index=index).collect())
    assert sorted(rt.hash_vectors(df)[0].collect()) == sorted(rt.hash_vectors(df, index=index)[0].collect())
    found = rt.expansion_documents(asked, df, index=index, size=rt.corpus_size(index))
    for method in ("none", "multi_query_expansion", "hyde", "query_decompose"):
        own = rt.expand_queries(asked, df, method, index=index, size=rt.corpus_size(index), found=found)
        assert sorted(own.collect()) == sorted(rt.expand_queries(asked, df, method).collect())


def test_rag_rounds_search_once_whatever_the_setups(spark, monkeypatch):
    """Each setup used to search the whole collection again."""
    calls = {}
    for name in ("bm25_topk", "vector_topk"):
        def counted(*args, _name=name, _own=getattr(rt, name), **more):
            calls[_name] = calls.get(_name, 0) + 1
            return _own(*args, **more)
        monkeypatch.setattr(rt, name, counted)
    _, df = corpus(spark, 40)
    log = rag_rounds.run_rag_rounds(df.withColumnRenamed("contents", "text"), "Less noise", 2, 3, n_questions=6).collect()
    assert len(log) == 6 and all(r["status"] == "completed" for r in log)
    assert calls == {"bm25_topk": 2, "vector_topk": 1}


def test_rag_rounds(spark):
    _, df = corpus(spark, 40)
    log = rag_rounds.run_rag_rounds(df.withColumnRenamed("contents", "text"), "Less noise", 2, 2, n_questions=6).collect()
    assert [(r["round"], r["status"]) for r in log] == [(1, "completed"), (1, "completed"), (2, "completed"), (2, "completed")], log
    assert {r["primary_metric"] for r in log} == {"retrieval_precision"}


def test_lsh_finds_nine_of_ten_neighbours_of_every_query(spark):
    m, df = vectors(spark, n=600, dims=64, seed=5)
    q = df.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "qid")
    lists = [{}, {}]
    for found, method in zip(lists, ("exact", "lsh")):
        for r in rt.vector_topk(q, df, 10, method=method).collect():
            found.setdefault(r["qid"], {})[r["doc_id"]] = r["score"]
    exact, near = lists
    assert set(exact) == set(near) == set(range(0, 600, 20))
    assert all(len(exact[i].keys() & near[i].keys()) >= 9 for i in exact)
    assert all(near[i][d] == pytest.approx(exact[i][d], abs=1e-9) for i in exact for d in exact[i].keys() & near[i].keys())


def test_vector_queries_take_every_twentieth_row_and_give_recall(spark):
    from trialmesh.plans import all_plans
    found = all_plans().QUERIES["vector_topk_lsh_rows"](spark, "/root/testdata/sf0.001").collect()
    exact = all_plans().QUERIES["vector_topk_rows"](spark, "/root/testdata/sf0.001").collect()
    assert {r["qid"] for r in found} == {r["qid"] for r in exact} == set(range(0, 500, 20))
    right = {(r["qid"], r["doc_id"]) for r in exact}
    for i in range(0, 500, 20):
        mine = [r for r in found if r["qid"] == i]
        recall = sum((i, r["doc_id"]) in right for r in mine) / 10
        assert recall >= 0.9 and all(r["recall"] == pytest.approx(recall) for r in mine)


def test_table_function_keeps_columns_and_checks_arguments(spark):
    df = spark.createDataFrame([(1.5, "a b c d e", 7), (2.5, None, 8), (3.5, "", 9), (None, "x", None)], "score double, body string, id long")
    got = udfs.chunk_table(df, "token", 2, 0, "body")
    assert got.columns == ["score", "body", "id", "chunk_index", "contents"]
    want = {(7, i, c) for i, c in enumerate(pt.CHUNKERS["token"]("a b c d e", 2, 0))} | {(None, 0, "x")}
    assert {(r["id"], r["chunk_index"], r["contents"]) for r in got.collect()} == want and len(want) > 2
    df.createOrReplaceTempView("chunk_bodies")
    parted = spark.sql("SELECT id, contents FROM chunk_table(TABLE(chunk_bodies) PARTITION BY (id), 'simple', 0, 0, 'body')")
    assert {tuple(r) for r in parted.collect()} == {(7, "a b c d e"), (None, "x")}
    for bad in (("nothing", "body"), ("token", "id"), ("token", "missing")):
        with pytest.raises(Exception, match="unknown chunker|no text column"):
            udfs.chunk_table(df, bad[0], 2, 0, bad[1]).collect()


@pytest.mark.parametrize("repeats", [False, True])
def test_stemmed_search_reads_texts_once(spark, monkeypatch, repeats):
    """Ids that repeat or are missing, null and empty texts, more documents than a slice: as by postings, from one pass over the texts."""
    draw = random.Random(8)
    words = ["run", "running", "runs", "fly", "flies", "cat", "cats", "jump", "jumped", "stone", "Zürich", "42"]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(1, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "unrelated text")]
    if repeats:
        rows += [(i, " ".join(draw.choice(words) for _ in range(4))) for i in (3, 3, 3, 7)] + [(None, "cats run"), (None, "cat runs far"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, contents string").repartition(3)
    queries = spark.createDataFrame([(1, "running cats"), (2, "flies jumped jumped"), (3, "nothing here"), (4, "")], "qid int, query string")
    stored = rt.postings(docs)
    want = rt.bm25_topk(queries, None, 7, stem=True, index=stored, size=rt.corpus_size(stored, docs)).collect()
    asked, written, cut, write = [], [], rt.terms, rt.materialize
    monkeypatch.setattr(rt, "INDEX_ROWS", 11)
    monkeypatch.setattr(rt, "terms", lambda c: asked.append(c) or cut(c))
    monkeypatch.setattr(rt, "materialize", lambda df, name: written.append(name) or write(df, name))
    got = rt.bm25_topk(queries, docs, 7, stem=True).collect()
    assert asked.count("contents") == 1 and ("hits" in written) == repeats
    key = lambda r: (r["qid"], r["rank"])
    assert len(want) == 14 and [(r["qid"], r["rank"], r["doc_id"], pytest.approx(r["score"], abs=1e-8)) for r in sorted(want, key=key)] == [
        (r["qid"], r["rank"], r["doc_id"], r["score"]) for r in sorted(got, key=key)]
