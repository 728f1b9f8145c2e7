import hashlib
import re
import string

from trialmesh.llm import decontaminate as dc
from trialmesh.llm.line_dedup import dedup_lines

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_lines(rows):
    keys = lambda t: [line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (t or "").split("\n")]
    holders = {}
    for i, text in rows:
        for k in keys(text):
            holders.setdefault(k, set()).add(i)
    gone = lambda k, i: len(k) >= 20 and len(holders[k]) >= 3 and max(holders[k]) != i
    found = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [line for line, k in zip(lines, keys(text)) if not gone(k, i)]
        found[i] = (len(lines), len(lines) - len(left), "\n".join(left))
    return found


def test_lines_equal_brute_force(docs_of, prose):
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(docs_of(prose)).collect()}
    assert got == brute_lines(prose) and sum(v[1] for v in got.values()) > 5


def test_lines_ties_nulls_clashes(docs_of):
    line = "x" * 20
    rows = [(1, f"{line}\n{line}"), (2, f" {line}\t"), (3, f"{line}\nend\n{line}"), (4, "x" * 19), (5, None), (None, line), (None, line), (2, "other")]
    docs = docs_of(rows).selectExpr("*", "1 AS n_lines", "2 AS _text")
    got = sorted((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_dropped"], r["_text"], r["key"]) for r in dedup_lines(docs).collect())
    assert got == [(-1, line, 1, 0, 2, "x"), (-1, line, 1, 0, 2, "x"), (1, "", 2, 2, 2, "x"), (2, "", 1, 1, 2, "x"), (2, "other", 1, 0, 2, "x"),
                   (3, f"{line}\nend\n{line}", 3, 0, 2, "x"), (4, "x" * 19, 1, 0, 2, "x"), (5, "", 1, 0, 2, "x")]
    assert dedup_lines(docs_of([])).count() == 0
    assert "Python" not in dedup_lines(docs_of(rows))._jdf.queryExecution().executedPlan().toString()


def edit_distance(item, text):
    """Smallest edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        old, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return min(row)


def test_edit_distance_of_words_and_parts():
    for item, text in (("kitten", "sitting on a mitten"), ("abc", ""), ("aaaa", "aa"), ("hello world", "xx helo wurld yy"), ("é🙂x", "a é🙂 x")):
        assert min(dc.distances(item, text), default=len(item)) == (edit_distance(item, text) if text else len(item))
    assert dc.occurrence("hello world", "xx helo wurld yy", 3) == (2, 3, 13)
    assert dc.occurrence("hello world", "nothing of the kind", 3) is None
    assert dc.normalized("  A b\n\nC ") == "a b c" and dc.places("  A b\n\nC ") == [2, 3, 4, 5, 7]


def test_leaks_equal_comparing_everything(spark, docs_of):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly boil another pot of soup."
    other = "Completely different words make up this second question, which nobody has ever leaked anywhere."
    broken = item.replace("quick", "quikc").replace("seven", "sevn")
    far = re.sub("[aeo]", "u", item)
    rows = [(1, f"before {item} after"), (2, f"x {broken.upper()}\ny"), (3, f"{far} {other[:40]}"), (4, None), (5, ""), (6, item[:60]), (7, item.replace(" ", "\n\n ")),
            (8, f"{item} and {item}"), (None, item)]
    bench = spark.createDataFrame([(10, item), (11, other), (12, None), (13, "short"), (14, item)], "item_id long, text string")
    plain = dc.normalized(item)
    allowed = dc.budget(len(plain), 0.05)
    want = {(i, n) for i, t in rows for n in (10, 14) if edit_distance(plain, dc.normalized(t or "")) <= allowed}
    for block in (1_000_000, 100):
        got = dc.leaks(docs_of(rows), bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and (2, 10) in want and (3, 10) not in want
        texts = dict(rows)
        for r in got:
            assert edit_distance(plain, dc.normalized(texts[r["doc_id"]][r["start"]:r["end"]])) == r["distance"]
    docs = docs_of(rows).selectExpr("*", "9 AS _matches", "8 AS m")
    for block in (1_000_000, 100):
        kept = dc.decontaminated(docs, bench, block_chars=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
        assert {(r["_matches"], r["m"]) for r in kept.collect()} == {(9, 8)}
    assert dc.leaks(docs_of([]), bench).count() == 0 and dc.leaks(docs_of(rows), bench.limit(0)).count() == 0


def test_short_items_are_found_exactly_between_words(spark, docs_of):
    rows = [(1, "is it the Red \n fox?"), (2, "the red foxes"), (3, "red fxo"), (4, "ired fox, then red fox"), (5, "x (b) y"), (6, None), (7, "forty two")]
    bench = spark.createDataFrame([(20, "red fox"), (21, "(b)"), (22, "forty     " + " " * 20 + " two"), (23, "  "), (24, None)], "item_id long, text string")
    got = dc.leaks(docs_of(rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["start"], r["end"], r["distance"], r["allowed"]) for r in got) == [
        (1, 20, 10, 19, 0, 0), (4, 20, 15, 22, 0, 0), (5, 21, 2, 5, 0, 0), (7, 22, 0, 9, 0, 0)]
    assert sorted(r["doc_id"] for r in dc.decontaminated(docs_of(rows), bench).collect()) == [2, 3, 6]


def test_budget_is_one_edit_in_twenty_from_the_shortest_item_on(spark, docs_of):
    assert [dc.budget(n, 0.05) for n in (19, 20, 23, 39, 40, 100)] == [0, 1, 1, 1, 2, 5]
    item = "which word was missing"  # 22 characters
    changed = [item[:i] + "#" + item[i + 1:] for i in range(len(item))] + [item[:i] + item[i + 1:] for i in range(len(item))]
    rows = [(i, f"so {t} then") for i, t in enumerate(changed)] + [(100, "so wh#ch word was m#ssing then")]
    got = dc.leaks(docs_of(rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(len(changed)))
