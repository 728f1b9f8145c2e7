import random
import zlib

import numpy as np
from trialmesh.llm import language, quality

held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2


def test_grams_are_those_of_padded_words():
    pack = lambda s: sum(ord(c) << 21 * i for i, c in enumerate(s))
    assert sorted(language.grams("Ab, c!")) == sorted(map(pack, ["a", "b", "c", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "]))
    assert len(language.grams("12 - !")) == 0 and len(language.grams("")) == 0


def brute_distance(text, profiles, size):
    keys, counts = language.frequencies(text)
    top = sorted(zip(-counts, keys))[:size]
    cost = {lang: sum(abs(places.get(k, None) - at) if k in places else size for at, (_, k) in enumerate(top)) for lang, places in profiles.items()}
    best = min(sorted(cost), key=cost.get)
    return best, 1 - cost[best] / (size * len(top))


def test_languages_by_out_of_place_distance(spark):
    draw = random.Random(2)
    alphabets = {"aa": "abcdefg ", "bb": "efghijk ", "cc": "世界人大小 "}
    make = lambda lang: "".join(draw.choice(alphabets[lang]) for _ in range(draw.randint(40, 200)))
    rows = [(i, make(lang), lang) for i in range(240) for lang in [sorted(alphabets)[i % 3]]]
    extra = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "abc", None), (None, "efghij", "bb"), (5, "abc", "aa")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score", "1 AS gram")
    got = language.identify(docs).collect()
    assert len(got) == len(rows + extra)
    tested = [(r, dict((i, lang) for i, _, lang in rows)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] < 240]
    assert len(tested) > 20 and sum(r["lang_pred"] == lang for r, lang in tested) / len(tested) > 0.95
    profiles = {}
    for r in language.profiles(docs).collect():
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["place"] - 1
    texts = {i: t for i, t, _ in rows}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] != 5:
            assert (r["lang_pred"], round(r["score"], 9)) == (lambda b: (b[0], round(b[1], 9)))(brute_distance(texts[r["doc_id"]], profiles, 300))
        if r["doc_id"] in (900, 901, 902):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 1)).where("false")
    assert language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_isotonic_equals_the_best_monotone_fit():
    draw = np.random.default_rng(1)
    for _ in range(20):
        weights, means = draw.integers(1, 9, 12).astype(float), draw.random(12)
        fitted = quality.isotonic(weights, means)
        upper = np.array([max(min(np.average(means[i:j + 1], weights=weights[i:j + 1]) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])
        assert np.allclose(fitted, upper) and (np.diff(fitted) >= -1e-12).all()


def test_quality_is_learned_and_calibrated(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    rows = []
    for i in range(500):
        good = draw.random() < 0.8
        rows.append((i, " ".join(word() + ("" if good else draw.choice(["$$$", "!!!", "###"])) for _ in range(draw.randint(30, 90))) + ".", int(good)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 or held(i)] + [(900, None), (None, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, ""), (None, "x"), (3, rows[3][1])], "doc_id long, text string").selectExpr("*", "1 AS x", "2 AS y", "3 AS score")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 504 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    want = {i: y for i, _, y in rows}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(tested) > 80 and np.mean([r["predicted"] == want[r["doc_id"]] for r in tested]) > 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}
    none = quality.score_quality(docs, labels.where("false"))
    assert {r["score"] for r in none.collect()} == {1.0} and quality.accepted(docs, labels.where("false")).count() == 504
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert {round(r["score"], 6) for r in quality.score_quality(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_statistics_are_finite():
    for text in ("", " ", "a", "\n", "é世", "!" * 50, "A B\nA B\n", "x" * 100000):
        found = quality.statistics(text)
        assert len(found) == 18 and np.isfinite(found).all()
