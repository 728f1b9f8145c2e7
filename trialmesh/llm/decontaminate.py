"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most ``k`` edits leaves at least one of its ``k + 1`` pieces untouched.  All
pieces of all items are searched at once (Aho-Corasick); around every exact hit the whole item is compared with Myers'
bit-parallel edit distance, so what is reported is within the budget and nothing within it is missed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import remove, slices, small_batches, store, trim, whole_text

MATCHES = "array<struct<item_id: long, start: long, end: long, distance: int, allowed: int>>"


def normalized(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of ``normalized(text)`` its position in ``text``."""
    found: list[int] = []
    gap = None
    for at, char in enumerate(text):
        if char.isspace():
            gap = at if gap is None else gap
            continue
        if gap is not None and found:
            found.append(gap)
        gap = None
        found.extend([at] * len(char.lower()))
    return found


def budget(size: int, rate: float) -> int:
    """Edits allowed for an item of ``size`` characters; with one more piece than edits, each has a character at least."""
    return max(0, min(int(size * rate), size - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` consecutive pieces of about equal length, with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distances(item: str, text: str, anywhere: bool = True):
    """Myers: for every end in ``text``, the smallest edit distance of ``item`` to a part of ``text`` that ends there.

    With ``anywhere`` false the part has to start at the start of ``text``.
    """
    size, masks = len(item), defaultdict(int)
    for i, char in enumerate(item):
        masks[char] |= 1 << i
    every, top = (1 << size) - 1, 1 << size - 1
    plus, minus, score = every, 0, size
    for char in text:
        same = masks.get(char, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | ~(across | plus) & every, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | (not anywhere)) & every
        down = down << 1 & every
        plus, minus = down | ~(vertical | up) & every, up & vertical
        yield score


def occurrence(item: str, text: str, edits: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best part of ``text``, the first of equals; None beyond the budget."""
    best, end = min(((d, i + 1) for i, d in enumerate(distances(item, text))), default=(edits + 1, 0))
    if best > edits:
        return None
    back = text[max(0, end - len(item) - edits):end][::-1]
    length = min((d, i + 1) for i, d in enumerate(distances(item[::-1], back, anywhere=False)))[1]
    return best, end - length, end


def between_words(text: str, start: int, end: int) -> bool:
    """Whether the part cuts no word of ``text`` at its ends."""
    joined = lambda at: 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()
    return not joined(start) and not joined(end)


class Matcher:
    """All pieces of a bounded block of items as one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = 20):
        import ahocorasick
        self.items = [(number, item, budget(len(item), rate) if len(item) >= min_chars else 0) for number, item in items]
        self.short = {at for at, (_, item, _) in enumerate(self.items) if len(item) < min_chars}
        owners = defaultdict(list)
        for at, (_, item, edits) in enumerate(self.items):
            for offset, piece in pieces(item, edits):
                owners[piece].append((at, offset))
        self.search = ahocorasick.Automaton()
        for piece, owner in owners.items():
            self.search.add_word(piece, (len(piece), owner))
        if owners:
            self.search.make_automaton()
        self.empty = not owners

    def __call__(self, text: str | None) -> list[dict]:
        """The best occurrence of every item that occurs in a text; start and end count characters of the text."""
        plain = normalized(text or "")
        if self.empty or not plain:
            return []
        starts = defaultdict(set)
        for end, (size, owners) in self.search.iter(plain):
            for at, offset in owners:
                if at in self.short and (at in starts or not between_words(plain, end - size + 1, end + 1)):
                    continue
                starts[at].add(end - size + 1 - offset)
        found, origin = [], None
        for at, begun in sorted(starts.items()):
            number, item, edits = self.items[at]
            best, windows = None, []
            for start in sorted(begun):
                low, high = max(0, start - edits), min(len(plain), start + len(item) + edits)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], high)
                else:
                    windows.append([low, high])
            for low, high in windows:
                hit = occurrence(item, plain[low:high], edits)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], hit[1] + low, hit[2] + low
            if best:
                origin = origin or places(text)
                found.append({"item_id": number, "start": origin[best[1]], "end": origin[best[2] - 1] + 1, "distance": best[0], "allowed": edits})
        return found


def _matched(known: list[tuple[int, str]], rate: float, min_chars: int):
    """The search of one block of items over an Arrow array; the automaton is built once a task."""
    made: list[Matcher] = []
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32()), ("allowed", pa.int32())]))

    def matched(texts):
        if not made:
            made.append(Matcher(known, rate, min_chars))
        found = [made[0](t) for part in slices(pa.record_batch([texts], ["text"])) for t in part.column(0).to_pylist()]
        trim()
        return pa.array(found, kind)
    matched.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return matched


def _searches(benchmark: DataFrame, rate: float, min_chars: int, block_chars: int) -> Iterator[Column]:
    """The matches of column ``text`` with each block of items, one block read after the other; one at least."""
    small_batches(benchmark.sparkSession)
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("item_id").collect()  # about block_chars
        known = [(r["item_id"], item) for r in own if (item := normalized(r["text"]))]
        yield F.arrow_udf(_matched(known, rate, min_chars), MATCHES)(whole_text())


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start, end, distance, allowed.

    start and end are code points of the text; of several occurrences the best is given, the first of equals.
    Items and texts are compared in lower case with white space as one space; an item of n characters is found with up
    to floor(n * ``rate``) edits.  Items of fewer than ``min_chars`` characters are searched without edits, and only
    where they cut no word.

    The item set is the query: it is read in blocks of about ``block_chars`` characters.  Where there are several, each
    block is a pass over the documents that is written before the next one is read, so a task holds one automaton
    and the driver one block.
    Null or empty text and null items: no match.  Repeated items are reported each under its id, repeated rows each
    time; other columns are not used.
    """
    found, rows = None, docs.select("doc_id", "text")
    searches = _searches(benchmark, rate, min_chars, block_chars)
    search, following = next(searches), next(searches, None)
    while True:
        own = rows.withColumn("_found", search).select("doc_id", F.explode("_found").alias("m")).select("doc_id", "m.*")
        if found is None and following is None:
            return own
        own, _ = store(own, "leaks")
        found = own if found is None else found.unionByName(own)
        if following is None:
            return found
        search, following = following, next(searches, None)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, min_chars: int = 20, block_chars: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs, columns as they are; no join and no shuffle.

    Found as by ``leaks``; of several blocks of items each reads what the one before it has left and written.
    """
    kept, before = docs, None
    for search in _searches(benchmark, rate, min_chars, block_chars):
        if kept is not docs:
            kept, path = store(kept, "clean")
            if before:
                remove(docs.sparkSession, before)
            before = path
        kept = kept.where(F.size(search) == 0)
    return kept
