"""Token counts of a byte-level BPE vocabulary: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from trialmesh.llm.common import map_batches, whole_text
from trialmesh.llm.pretokens import Pieces

#: Fixed value: how byte-level pre-tokenizers of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> tuple[str, list[str]]:
    """The tokenizer file's text and its added tokens; refuses kinds whose splitting is not the one above."""
    with open(path, encoding="utf-8") as file:
        source = file.read()
    parts = json.loads(source)
    split, added = parts.get("pre_tokenizer") or {}, parts.get("added_tokens") or []
    if parts.get("normalizer") or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space"):
        raise ValueError(f"{path}: not a plain byte-level vocabulary")
    if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that take their surroundings are not supported")
    return source, [a["content"] for a in added]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    Each text is split into pre-tokens.  A task gives every distinct pre-token to the library once, and joins the
    resulting number of pieces to the pre-token frequencies of each document; no list of ids of a text is built.
    Strings of added tokens inside a text are one token each, as the library handles them by default.
    Null or empty text: 0 bytes, 0 tokens.  Repeated rows are counted one by one; other columns are not used.
    The vocabulary file is read on the driver and travels with the tasks (a few MB whatever the input's size).
    """
    source, added = read_vocabulary(path)
    apart = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None
    made = []

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            from tokenizers import Tokenizer
            library = Tokenizer.from_str(source)
            library.encode_special_tokens = True
            made.append(Pieces(SPLIT, lambda new: [e.ids for e in library.encode_batch_fast(new, add_special_tokens=False)]))
        pieces = made[0]
        pieces.trim()
        rows, special = [], []
        for text in batch.column(1).to_pylist():
            whole = apart is None or apart.search(text) is None
            parts = [text] if whole else apart.split(text)
            special.append(len(parts) - 1)
            often = Counter(pieces.find(parts[0]))
            for part in parts[1:]:
                often.update(pieces.find(part))
            rows.append((pieces.numbers(often), np.fromiter(often.values(), np.int64, len(often))))
        pieces.settle()
        totals = [int(pieces.sizes[which] @ often) + n for (which, often), n in zip(rows, special, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    found = map_batches(rows, ["doc_id", "text", "n_bytes"], counted, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
