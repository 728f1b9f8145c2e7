"""Fill-in-middle: texts cut in three and put in another order, so that a model learns to write what lies between.

Cuts are found in whole units (lines or characters) over the UTF-8 bytes of a text.  An index of exceptions holds the
positions of multibyte characters only, with the bytes they have beyond one; a binary search in it turns a cut in
bytes into one in code points and back, and what is ASCII is plain arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import map_slices, whole_text

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Exceptions:
    """Sparse index of the characters of a UTF-8 text that take more than one byte.

    ``at`` are the byte positions of their first bytes, ``extra`` the bytes beyond one of all exceptions up to each.
    Plain ASCII has an empty index, and both conversions return what they are given.
    """

    def __init__(self, data: np.ndarray):
        self.at = np.flatnonzero(data >= 0xC0)
        first = data[self.at]
        self.extra = np.cumsum(1 + (first >= 0xE0).astype(np.int64) + (first >= 0xF0))
        before = np.append(0, self.extra[:-1]) if len(self.at) else self.extra
        self.chars = self.at - before

    def to_chars(self, position: int) -> int:
        """Code points before a byte position that does not split a character."""
        n = int(np.searchsorted(self.at, position))
        return position - (int(self.extra[n - 1]) if n else 0)

    def to_bytes(self, position: int) -> int:
        """Bytes before a code point position."""
        n = int(np.searchsorted(self.chars, position))
        return position + (int(self.extra[n - 1]) if n else 0)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The four numbers that decide over a document; they depend on its id and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def cut(data: np.ndarray, index: Exceptions, lines: bool, first: int, second: int) -> tuple[int, int, int]:
    """Number of units, and the bytes before the two cuts, the smaller first."""
    if lines:
        ends = np.flatnonzero(data == 10) + 1
        if len(data) and (not len(ends) or ends[-1] != len(data)):
            ends = np.append(ends, len(data))
        n = len(ends)
        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, int(ends[low - 1]) if low else 0, int(ends[high - 1]) if high else 0
    n = index.to_chars(len(data))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, index.to_bytes(low), index.to_bytes(high)


def fill_in_middle(docs: DataFrame, seed: int = 7, unit: str = "line", rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    The hash of seed and doc_id draws two cuts between units (a line with its line feed, or a character), whether the
    text is transformed at all (``rate`` of 100) and which form it gets: ``spm`` of 100 put the suffix first, the
    others are psm.  A text that is empty or holds a mark itself is always plain.  ``restored`` undoes it.

    Null text counts as empty; a null doc_id draws like an empty id.  Repeated rows are handled one by one, equal ids
    draw equally; other columns are not used.  No shuffle; what a task holds at a time is a slice of texts bounded in
    bytes (one text where that alone is longer).
    """
    if unit not in ("line", "character"):
        raise ValueError("unit is line or character")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, form, before, middle, output = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            data = np.frombuffer(text, np.uint8)
            h1, h2, h3, h4 = draws(doc_id, seed)
            index = Exceptions(data)
            units, low, high = cut(data, index, unit == "line", h1, h2)
            n.append(units)
            if not text or any(m in text for m in marks) or h3 % 100 >= rate:
                form.append("plain")
                before.append(None)
                middle.append(None)
                output.append(text)
                continue
            prefix, mid, suffix = text[:low], text[low:high], text[high:]
            form.append("spm" if h4 % 100 < spm else "psm")
            before.append(index.to_chars(low))
            middle.append(index.to_chars(high) - before[-1])
            parts = [marks[1], suffix, marks[0], prefix] if form[-1] == "spm" else [marks[0], prefix, marks[1], suffix]
            output.append(b"".join([*parts, marks[2], mid]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()),
             pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return map_slices(docs.select("doc_id", whole_text().alias("text")), ["doc_id", "text"], transformed, SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text an output was made from: the marks occur in it once each, so it is cut at them and put in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
