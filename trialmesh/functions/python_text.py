"""Small per-value Python helpers used inside Arrow batches.

The module is pickled by value, so executors do not need the package installed.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re
import sys
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])


# --- chunking -----------------------------------------------------------------

def pack(pieces: list[str], sizes: list[int], limit: int, overlap: int) -> list[str]:
    """Join pieces in order into chunks of at most ``limit``; each chunk starts with the
    last pieces of the one before, up to ``overlap``."""
    chunks, start, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            chunks.append("".join(pieces[start:i]))
            back, kept = i, 0
            while back - 1 > start and kept + sizes[back - 1] <= overlap and kept + sizes[back - 1] + size <= limit:
                back -= 1
                kept += sizes[back]
            start, total = back, kept
        total += size
    if start < len(pieces):
        chunks.append("".join(pieces[start:]))
    return chunks


def recursive_pieces(text: str, limit: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Cut at the coarsest separator that helps; pieces keep their separator, so they add up to the text."""
    if len(text) <= limit:
        return [text] if text else []
    sep = next((s for s in separators if s == "" or s in text), "")
    if sep == "":
        return [text[i:i + limit] for i in range(0, len(text), limit)]
    finer = separators[separators.index(sep) + 1:]
    parts = text.split(sep)
    whole = [p + sep for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])
    return [piece for part in whole for piece in recursive_pieces(part, limit, finer)]


def chunk_recursive_text(text: str, size: int, overlap: int) -> list[str]:
    pieces = recursive_pieces(text, size)
    return [c for c in pack(pieces, [len(p) for p in pieces], size, overlap) if c.strip()]


def chunk_sentence_text(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed up to ``size`` words."""
    sentences = [s for s in re.sub(r"([.!?])(\s+)", "\\1\\2\x01", text).split("\x01") if s.strip()]
    return [c.strip() for c in pack(sentences, [len(s.split()) for s in sentences], size, overlap)]


def chunk_token_text(text: str, size: int, overlap: int) -> list[str]:
    words, step = text.split(), size - overlap
    count = 0 if not words else 1 if len(words) <= size else -(-(len(words) - size) // step) + 1
    return [" ".join(words[i * step:i * step + size]) for i in range(count)]


def chunk_character_text(text: str, size: int, overlap: int) -> list[str]:
    step = size - overlap
    count = 0 if not text else 1 if len(text) <= size else -(-(len(text) - size) // step) + 1
    return [text[i * step:i * step + size] for i in range(count)]


CHUNKERS: dict[str, Callable[[str, int, int], list[str]]] = {
    "token": chunk_token_text, "character": chunk_character_text, "recursive": chunk_recursive_text,
    "sentence": chunk_sentence_text, "simple": lambda text, size, overlap: [text],
}


# --- parsing ------------------------------------------------------------------

class _TextOnly(HTMLParser):
    """Collects visible text; block elements break lines."""

    hidden = {"script", "style", "noscript", "template"}
    blocks = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "article",
              "section", "header", "footer", "nav", "title", "body", "head", "html", "pre", "blockquote"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.hidden
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.depth = max(0, self.depth - 1)
        if tag in self.blocks:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _lines(text: str) -> str:
    return "\n".join(line for line in (" ".join(part.split()) for part in text.split("\n")) if line)


def parse_html(text: str) -> list[str]:
    reader = _TextOnly()
    reader.feed(text)
    reader.close()
    return [_lines("".join(reader.parts))]


def parse_xml(text: str) -> list[str]:
    bare = re.sub(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", " ", text, flags=re.S)
    bare = re.sub(r"<!\[CDATA\[(.*?)\]\]>", lambda m: html.escape(m.group(1)), bare, flags=re.S)
    return [_lines(html.unescape(re.sub(r"<[^>]+>", "\n", bare)))]


def parse_md(text: str) -> list[str]:
    plain = re.sub(r"^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "", text, flags=re.M)
    plain = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", plain)
    return [_lines(re.sub(r"(\*\*|__|`+|~~)", "", plain))]


def parse_text(text: str) -> list[str]:
    return [text]


def parse_csv(text: str) -> list[str]:
    """One document per record, as ``column: value`` lines."""
    return ["\n".join(f"{k}: {v}" for k, v in row.items()) for row in csv.DictReader(io.StringIO(text))]


def parse_json(text: str) -> list[str]:
    value = json.loads(text)
    return [json.dumps(v, ensure_ascii=False) for v in (value if isinstance(value, list) else [value])]


PARSERS: dict[str, Callable[[str], list[str]]] = {
    "html": parse_html, "xml": parse_xml, "md": parse_md, "txt": parse_text, "csv": parse_csv, "json": parse_json}


# --- matching -----------------------------------------------------------------

def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyrö, 2004): one integer holds a
    row of the table, so long texts cost words² / 64 steps."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# --- stemming (M. F. Porter, "An algorithm for suffix stripping", 1980) -----------

# Suffix tables of the published algorithm.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize")


def _shape(word: str) -> str:
    """The word as c (consonant) and v (vowel) letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return len(word) >= 3 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) >= 2 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter_stem(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[:len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((s for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[:-len(s)])), None)
        if cut:
            word = word[:-len(cut)]
            if word.endswith(("at", "bl", "iz")) or (_measure(word) == 1 and _cvc(word)):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        pairs = dict(table)
        suffix = _longest(word, pairs)
        if suffix and _measure(word[:-len(suffix)]) > 0:
            word = word[:-len(suffix)] + pairs[suffix]
    suffix = _longest(word, STEP4)
    if suffix:
        stem = word[:-len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _cvc(word[:-1])):
            word = word[:-1]
    if _measure(word) > 1 and word.endswith("ll"):
        word = word[:-1]
    return word
