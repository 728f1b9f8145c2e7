"""Main text of web pages by consensus host paths.

Each page scores its containers and votes for the generalised path (tags and classes, digits folded) of the best one;
votes are counted per host in Spark, and every page is read again below its host's winning path.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from trialmesh.llm.common import map_slices, store

# Element names of HTML and words that sites use for what surrounds an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
AROUND = frozenset("nav footer aside form button dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
SURROUNDING = frozenset("""ad ads advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs combx comment comments commentlist consent cookie
cookies disqus discussion footer gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup
promo promoted promotion recommended related replies reply respond responses share sharing sidebar signup skip social sponsor sponsored subscribe
toolbar topbar widget widgets""".split())
STATES = frozenset("has no with without is not tag category js".split())  # first parts of names that say something about an element
SWITCHES = frozenset("open closed enabled disabled on off allowed".split())  # last parts of such names
OWN_HEADS = frozenset("entry post article content page story".split())  # whose header belongs to the article
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = frozenset("table ul ol dl article section main div body".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_LEAVES = frozenset("p pre blockquote li ul ol dl dt dd td th tr tbody thead table figure figcaption h1 h2 h3 h4 h5 h6".split())
MOST, DEEPEST, NEAR = 0.9, 256, 64


def names_surroundings(name: str) -> bool:
    """Whether a class or id is that of a part around the article: the whole name, its first or its last part is a word for it.

    Not so where the first or last part makes it a remark about an element that holds something else.
    """
    parts = [p for p in re.split(r"[-_\d]+", name.lower()) if p]
    if not parts or parts[0] in STATES or parts[-1] in SWITCHES:
        return False
    if parts[-1] == "header" and parts[0] in OWN_HEADS:
        return False
    return parts[0] in SURROUNDING or parts[-1] in SURROUNDING


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


class Page:
    """The elements of a page, numbered as they open (0 is the root), and its text.

    ``blocks`` are lists of pieces (element, text, whether a link), each list with the block element that holds it.  Time and
    memory are in proportion to the page: open elements are counted by name, and what is found missing once is not
    searched again.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.step = ["html"], [-1], ["html"]
        self.firm, self.doubt = [False], [False]  # around the article by element or attribute; by its names
        self.blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.stack, self.owners, self.open = [0], [0], Counter()
        self.pieces: list[tuple[int, str, bool]] = []
        self.owner, self.known = 0, {}
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.pieces:
            self.blocks.append((self.owner, self.pieces))
        self.pieces = []

    def write(self, raw: str) -> None:
        if raw:
            linked = any(self.tag[e] == "a" for e in self.stack[-3:])
            self.pieces.append((self.stack[-1], entities.unescape(raw) if "&" in raw else raw, linked))

    def close(self, depth: int) -> None:
        """Close all open elements from a depth of the stack on."""
        for e in self.stack[depth:]:
            self.open[self.tag[e]] -= 1
        del self.stack[depth:], self.owners[depth:]

    def close_through(self, tag: str) -> None:
        depth = len(self.stack) - 1
        while self.tag[self.stack[depth]] != tag:
            depth -= 1
        self.close(depth)

    def start(self, tag: str, source: str) -> None:
        attributes = _attributes(source)
        classes = attributes.get("class", "").split()
        above, number = self.stack[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(above)
        self.step.append(".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()).replace(">", "") for c in classes})]) if classes else tag)
        self.firm.append(bool(
            tag in AROUND or (tag == "header" and not self.open["article"]) or attributes and (
                attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
                or "display:none" in attributes.get("style", "").replace(" ", "").lower())))
        names = [*classes, *attributes.get("id", "").split()] if attributes and tag not in ("html", "body", "main") else []
        for name in names:
            if name not in self.known:
                self.known[name] = names_surroundings(name)
        self.doubt.append(any(map(self.known.__getitem__, names)))
        self.stack.append(number)
        self.owners.append(number if tag in BLOCKS else self.owners[-1])
        self.open[tag] += 1

    def read(self, page: str) -> None:
        at, last, comments, missing, scanned, pattern = 0, page.rfind(">"), True, set(), 0, _TAG
        written = 0
        while True:
            at = page.find("<", at)
            if at < 0 or at > last:
                break
            if page.startswith(("<!", "<?"), at):
                end = page.find("-->", at + 4) if comments and page.startswith("<!--", at) else -1
                if end >= 0:
                    end += 3
                else:
                    comments = comments and not page.startswith("<!--", at)
                    end = page.find(">", at) + 1
                self.write(page[written:at])
                written = at = end
                continue
            found = pattern.match(page, at)
            if not found:
                scanned += len(page) - at if page[at + 1:at + 2].isalpha() or page[at + 1:at + 2] == "/" else 0
                if scanned > 20 * len(page):  # many quotes that never close: they count as plain characters from here on
                    pattern = _PLAIN_TAG
                at += 1
                continue
            self.write(page[written:at])
            written = at = found.end()
            tag = found[2].lower()
            if found[1]:
                self.end(tag)
            elif tag in RAW:
                if found[3].endswith("/") or tag in missing:
                    continue
                ending = _ending(tag).search(page, at)
                if ending:
                    written = at = ending.end()
                elif tag in ("script", "style"):
                    written = at = len(page)
                else:
                    missing.add(tag)
            else:
                self.begin(tag, found[3])
        self.write(page[written:])

    def end(self, tag: str) -> None:
        if self.open[tag] <= 0:
            return
        if tag in BLOCKS:
            self.flush()
        self.close_through(tag)
        if tag in BLOCKS:
            self.owner = self.owners[-1]

    def begin(self, tag: str, source: str) -> None:
        if tag == "br":
            self.pieces.append((self.stack[-1], " ", False))
            return
        if tag in VOID and tag != "hr":
            return
        if tag in BLOCKS:
            self.flush()
            if tag == "body" or len(self.stack) > 1 and self.tag[self.stack[1]] == "head":  # a head that was never closed
                self.close(1)
            while self.open["p"] > 0:  # a block ends an open paragraph
                self.close_through("p")
            ends = CLOSED_BY.get(tag, ())
            if any(self.open[e] > 0 for e in ends):
                for depth in range(len(self.stack) - 1, max(0, len(self.stack) - 1 - NEAR), -1):
                    name = self.tag[self.stack[depth]]
                    if name in ends:
                        self.close(depth)
                    if name in ends or name in FENCES:
                        break
        if tag == "html":
            return
        if tag != "hr":
            self.start(tag, source)
        if tag in BLOCKS:
            self.owner = self.owners[-1]

    def around(self, by_names: bool) -> list[bool]:
        """Per element whether it or one above it lies around the article.

        An element that holds an article or main element, or nearly all text, is never around by its names, nor is a form.
        """
        count = len(self.tag)
        size, holds = [0] * count, [False] * count
        for _, pieces in self.blocks:
            for e, text, _ in pieces:
                size[e] += len(text)
        for e in range(count - 1, 0, -1):
            above = self.parent[e]
            size[above] += size[e]
            if holds[e] or (self.tag[e] in ("article", "main") and not self.doubt[e]):
                holds[above] = True
        found = [False] * count
        for e in range(1, count):
            spared = holds[e] or size[e] > MOST * size[0]
            found[e] = found[self.parent[e]] or (self.firm[e] and not (spared and self.tag[e] == "form")) or (by_names and self.doubt[e] and not spared)
        return found

    def texts(self, around: list[bool]) -> list[tuple[int, str, int]]:
        """Blocks in order that have text outside of what is around: element, text, length of its links."""
        found = []
        for owner, pieces in self.blocks:
            if not around[owner]:
                own = [(text, linked) for e, text, linked in pieces if not around[e]]
                text = " ".join("".join(t for t, _ in own).split())
                if text:
                    found.append((owner, text, sum(len(t) for t, linked in own if linked)))
        return found

    def outermost(self, e: int, tag: str) -> int:
        found = -1
        while e > 0:
            found = e if self.tag[e] == tag else found
            e = self.parent[e]
        return found

    def best(self, blocks: list[tuple[int, str, int]]) -> int:
        """The element whose blocks score most; inside an article or main element that element. -1 without any text."""
        score: dict[int, float] = {}
        for owner, text, linked in blocks:
            plain = len(text) - linked
            if plain <= 0:
                continue
            points = 1 + text.count(",") + min(plain / 100, 5) if plain >= 25 else 0.2
            holder = owner
            for _ in range(NEAR):  # lists, tables and paragraphs count for what holds them
                if self.tag[holder] not in _LEAVES or not holder:
                    break
                holder = self.parent[holder]
            for weight in (1.0, 0.5, 0.25):
                if holder < 0:
                    break
                score[holder] = score.get(holder, 0.0) + points * weight
                holder = self.parent[holder]
        if not score:
            return -1
        top = max(score, key=lambda e: (score[e], -e))
        return next((e for e in (self.outermost(top, "article"), self.outermost(top, "main")) if e >= 0), top)

    def path(self, e: int) -> str:
        """Tags and classes from the root to an element; for one nested very deep, to the element above it at ``DEEPEST``."""
        steps = []
        while e >= 0:
            steps.append(self.step[e])
            e = self.parent[e]
        return ">".join(steps[::-1][:DEEPEST])

    def below(self, path: str) -> list[bool]:
        """Per element whether it is one of the path or below it."""
        steps, matched = path.split(">"), [0] * len(self.tag)  # the number of steps that agree, as long as all do
        for e in range(len(self.tag)):
            above = matched[self.parent[e]] if e else 0
            matched[e] = above if above == len(steps) else above + 1 if above >= 0 and steps[above] == self.step[e] else -1
        return [m == len(steps) for m in matched]


_ENDINGS: dict[str, re.Pattern] = {}


def _ending(tag: str) -> re.Pattern:
    if tag not in _ENDINGS:
        _ENDINGS[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I)
    return _ENDINGS[tag]


def extract(page: str | None, path: str | None = None) -> tuple[str, str | None]:
    """The main text below ``path`` (or below the page's own best container, if nothing is there) and the best path.

    Names of classes and ids decide only as long as they leave any text.
    """
    if not page:
        return "", None
    read = Page(page)
    for by_names in (True, False):
        blocks = read.texts(read.around(by_names))
        top = read.best(blocks)
        best = read.path(top) if top >= 0 else None
        for way in (path, best):
            inside = read.below(way) if way else None
            own = [text for owner, text, _ in blocks if inside and inside[owner]]
            if own:
                return "\n".join(own), best
    return "", None


def host_of(url: str = "url") -> Column:
    """Host of an address in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of the host's pages, the first in order of equals.

    Votes are counted inside the tasks before they move, so a host that holds a third of all pages costs a few rows a task.
    """
    def voted(batch: pa.RecordBatch) -> pa.RecordBatch:
        paths = [extract(page)[1] for page in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])
    rows = pages.select(host_of().alias("host"), "html").where("host <> ''")
    votes = map_slices(rows, ["host", "html"], voted, "host string, path string").where("path IS NOT NULL")
    counts = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    first = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return counts.withColumn("_place", first).where("_place = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row: the article's blocks, one a line.

    Null or empty html: empty text.  Very long or deeply nested pages take time and memory in proportion to their length.  A page whose host is unknown, or whose host's path holds no text, is read below
    its own best container.  Repeated rows vote and are read each time; other columns are not used.
    Eager: the winning path of each host is written to the shared folder; the planner broadcasts it while it is small.
    """
    winners, _ = store(host_paths(pages), "host_paths")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(page, path)[0] for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
    rows = pages.select("page_id", "url", "html", host_of().alias("host")).join(winners, "host", "left")
    found = map_slices(rows, ["page_id", "url", "html", "path"], read, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
