import hashlib
import json
import random
import time

import pytest

from trialmesh.llm import main_text, warc
from trialmesh.session import new_path

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad > --><div class="ad">Buy</div><div class="cookie-notice">We use cookies.</div>
<div class="wrap-7"><div class="post post-12"><h1>Title &amp; more</h1><p><b>First   paragraph
is long enough, with commas, to count as text.<br><p>Second &lt;one&gt;&nbsp;is long, too, and has some more words in it.</p>
<ul><li>item one<li>item two</ul><form><input name="q"><button>Go</button></form></div>
<div class="comments"><p>A reader says something quite long here, with commas, and so on, and on.</p></div></div>
<aside class="sidebar"><p>Elsewhere there are longer texts, many, many, many, many, many, many, commas.</p></aside>
<footer>&copy; Site</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph is long enough, with commas, to count as text.\nSecond <one> is long, too, and has some more words in it.\nitem one\nitem two"


def test_page_without_its_surroundings():
    text, path = main_text.extract(PAGE)
    assert text == TEXT and path == "html>body>div.wrap-#>div.post.post-#"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<<<>>", "a<b", "<p", "<!--", "<script>", "<div class='x", "</p></div>", "<html><head><title>x", "&#0;&#x110000;&bogus;", "<p>" * 3000])
def test_broken_pages_do_not_fail(page):
    main_text.extract(page)


def test_unclosed_parts_and_articles():
    page = "<html><head><meta charset=utf-8><body><nav>menu<article><h1>Head</h1><p>One line of text that is long enough.<p>Two lines.</article><footer>foot <p>x"
    assert main_text.extract(page.replace("<nav>menu", "<nav>menu</nav>"))[0] == "Head\nOne line of text that is long enough.\nTwo lines."
    assert main_text.extract("plain text only, without any markup at all")[0] == "plain text only, without any markup at all"
    nested = "<article><p>An article with a comment below it, long enough.</p><article class='comment'><p>The comment, also long enough to count.</p></article></article>"
    assert main_text.extract(nested)[0] == "An article with a comment below it, long enough."


def test_host_votes_decide(spark):
    odd = PAGE.replace("A reader says", "A reader says much more, " + "and more, " * 200).replace('class="comments"', 'class="talk"')
    rows = [(i, f"http://WWW.site.org:80/{i}", PAGE.replace("post-12", f"post-{i}")) for i in range(8)] + [(8, "https://u@www.site.org/x", odd)]
    rows += [(9, None, PAGE), (10, "not an address", PAGE), (11, "http://other.org", None), (None, "http://www.site.org", ""), (3, "http://www.site.org/3", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "'y' AS path", "1 AS text")
    got = main_text.main_text(pages).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == TEXT and r["n_chars"] == len(TEXT) for r in got if r["page_id"] is not None and r["page_id"] != 11)
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (11, None))
    assert main_text.extract(odd)[0] != TEXT and main_text.main_text(pages.where("false")).count() == 0


def rows_of(count):
    same = "a payload that repeats " * 10
    rows = [(i, f"http://h{i % 3}.example.org/p{i % 7}?q={i}", same if i % 4 == 0 else f"page {i} " * (i % 20)) for i in range(count)]
    return rows + [(900, None, None), (None, "http://x.org/", same), (901, "http://h0.example.org/ä b\r\nc", same), (902, "bad", "short"), (903, "bad", "short"), (0, rows[0][1], same)]


def want(rows):
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and i is not None:
            first[data] = min(first.get(data, i), i)
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        to = first.get(data) if len(data) >= 100 and first.get(data) != i else None
        found.append((-1 if i is None else i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", -1 if to is None else to))
    return sorted(found)


def test_archives_come_back_whole(spark):
    rows = rows_of(300)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first").repartition(4)
    got = warc.archive_round_trip(spark, pages).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], none(r["refers_to"])) for r in got) == want(rows)
    assert warc.archive_round_trip(spark, pages.where("false")).count() == 0


def test_lookup_reads_blocks_by_key(spark):
    rows = rows_of(300) + [(2000 + i, "http://hot.example.org/", f"capture {i}") for i in range(90)]
    folder = new_path(spark, "archive")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    parts = warc.build_index(warc.write_archive(pages, folder), folder, per_block=7)
    assert parts.agg({"captures": "sum"}).first()[0] == len(rows)
    asked = ["http://hot.example.org/", "https://H1.example.org:8080/p1?q=1#x", "http://nowhere.org/", "bad", None]
    found = warc.lookup(parts, spark.createDataFrame([(a,) for a in asked], "url string"))
    got = sorted(r["page_id"] for r in warc.read_records(found).collect())
    assert got == sorted([1, 902, 903, *range(2000, 2090)])
    record = warc.read_records(found.where("page_id = 1")).first()
    assert record["payload"].decode() == rows[1][2] and record["url"] == rows[1][1]
    assert warc.capture_key("http://A.Example.org/x?y#z") == "org,example,a)/x?y" and warc.capture_key(None) == ")/"


def test_lookup_of_every_address_finds_every_capture(spark):
    rows = rows_of(300) + [(3000 + i, None, f"no address {i}") for i in range(40)] + [(4000 + i, "http://hot.example.org/", f"capture {i}") for i in range(90)]
    folder = new_path(spark, "archive")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures = warc.write_archive(pages, folder)
    parts = warc.build_index(captures, folder, per_block=7)
    asked = pages.selectExpr("coalesce(url, '') AS url")
    found = lambda: sorted((r["file"], r["at"]) for r in warc.lookup(parts, asked).collect())
    assert found() == sorted((r["file"], r["at"]) for r in captures.collect())
    files, path = warc.file_system(max(parts.collect(), key=lambda r: r["captures"])["directory"])
    with files.open_input_file(path) as stream:
        sparse = json.loads(stream.read())
    with files.open_output_stream(path, compression=None) as stream:  # every block one place too late: what it names is not found
        stream.write(json.dumps([[key, at, size] for (key, _, _), (_, at, size) in zip(sparse, sparse[1:] + sparse[:1], strict=True)]).encode())
    assert len(found()) < len(rows)


def generated(draw):
    """A page and the text of its article: nested wrappers, unclosed tags, svg, surroundings of every kind."""
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9)))
    words = lambda n: " ".join(word() + draw.choice(["", "", ","]) for _ in range(n))
    blocks, parts = [], []
    for _ in range(draw.randint(1, 8)):
        text, kind = words(draw.randint(4, 60)), draw.choice(["p", "open", "h2", "list", "inline", "svg", "quote"])
        blocks.append(text)
        first, _, rest = text.partition(" ")
        parts.append({"p": f"<p>{text}</p>", "open": f"<p>{text}", "h2": f"<h2 class='entry-header'>{text}</h2>", "list": f"<ul><li>{text}</ul>",
                      "inline": f"<p><b>{first}</b>\n <a href='/x'>{rest[:5]}</a>{rest[5:]}<br>", "svg": f"<p>{first} <svg viewBox='0'/> {rest}</p>",
                      "quote": f"<blockquote>{text}<!-- no > --></blockquote>"}[kind])
        if draw.random() < 0.3:
            parts.append(draw.choice([f"<div class='ad-box ad'>{words(3)}</div>", f"<aside>{words(30)}</aside>", f"<form><input name=q>{words(4)}</form>",
                                      f"<script>var a = '<p>{words(4)}</p>'</script>", f"<svg><text>{word()}</text></svg>", f"<div hidden>{words(9)}</div>"]))
    kind = draw.choice(["article", "main", "div class='post-body'"])
    body = f"<{kind}>" + "".join(parts) + f"</{kind.split()[0]}>"
    if not kind.startswith("div"):
        for _ in range(draw.randint(0, 4)):
            wrap = draw.choice(["div class='layout has-sidebar'", "div id=no-sidebar", "form id='aspnetForm'", "div class='comments-open'", "section class='content widget-area-off'", "div class='sidebar'"])
            body = f"<{wrap}>{body}</{wrap.split()[0]}>"
    head = f"<nav><ul><li><a href='/'>{word()}</a></ul></nav><header class='site-header'>{words(3)}</header>"
    tail = f"<div class='post-comments'><p>{words(40)}</p></div><footer>{words(5)}</footer>" if draw.random() < 0.5 else f"<footer>{words(5)}"
    return f"<!DOCTYPE html><html><head><title>{word()}</title><body>{head}{body}{tail}", "\n".join(blocks)


def test_generated_pages_give_their_article():
    draw = random.Random(9)
    for _ in range(400):
        page, text = generated(draw)
        assert main_text.extract(page)[0] == text, page


@pytest.mark.parametrize("page, text", [
    ("<div class='layout has-sidebar'><article><p>One.</article></div>", "One."), ("<div class='no-sidebar'><article>One.</article></div>", "One."),
    ("<article class='post comments-open'><p>One.</article>", "One."), ("<form id='aspnetForm'><div><p>One text alone.</p></div></form>", "One text alone."),
    ("<article>a <svg/> b <svg><text>no</text></svg> c</article>", "a b c"), ("<article><div class='entry-header'><h1>T</h1></div><p>x</article>", "T\nx"),
    ("<div class='sidebar'><p>nothing else here</div>", "nothing else here"), ("<article>a<!-- never closed <p>b</article>", "ab")])
def test_names_and_wrappers_do_not_empty_a_page(page, text):
    assert main_text.extract(page)[0] == text


@pytest.mark.parametrize("page", ["<div><span>" * 100_000, "<!--" * 100_000, "<a \"'" * 50_000 + ">", "<td><table>" + "<i><td></td>" * 50_000, "<iframe>" * 100_000,
                                  "<b>" * 100_000 + "</i>" * 100_000, "<p>x" * 100_000, "<div>word, " * 50_000, "<" * 300_000])
def test_long_and_deep_pages_take_time_in_proportion(page):
    quarter, start = page[:len(page) // 4], time.process_time()
    main_text.extract(quarter)
    short, start = time.process_time() - start, time.process_time()
    main_text.extract(page)
    assert time.process_time() - start < 8 * short + 0.5


def test_very_deep_paths_vote_for_what_is_above():
    path = main_text.extract("<div>" * 1000 + "<p>one text that is long enough to be read, and more</p>")[1]
    assert len(path.split(">")) == main_text.DEEPEST
    assert main_text.extract("<div>" * 1000 + "<p>another text</p>", path)[0] == "another text"
