"""Byte-level BPE: encoding with the tokenizers library over Arrow batches, and decoding by the reversed byte table."""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialmesh.llm.common import map_slices, whole_text
from trialmesh.llm.pretokens import Pieces

PIECES = 2000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merging by rank leaves of a token just before its own merge."""
    parts = [token[i:i + 1] for i in range(len(token))]
    top = ranks[token]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], top))
        if ranks.get(parts[best] + parts[best + 1], top) >= top:
            return None
        parts[best:best + 2] = [parts[best] + parts[best + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=4)
def library_source(path: str) -> tuple[str, tuple[bytes, ...]]:
    """A rank file as the library's own format (text), and the bytes of every id.

    The merges follow from the ranks: merging inside a token by rank ends in the pair that makes the token.
    """
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to n - 1")
    letters = byte_characters()
    shown = {token: "".join(letters[b] for b in token) for token in ranks}
    tokens = sorted(ranks, key=ranks.__getitem__)
    merges = [(shown[pair[0]], shown[pair[1]]) for token in tokens if len(token) > 1 and (pair := _halves(token, ranks))]
    model = {"type": "BPE", "vocab": {shown[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "added_tokens": [], "model": model}), tuple(tokens)


class Codec:
    """One task's encoder and decoder."""

    def __init__(self, source: str, tokens: tuple[bytes, ...], pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        from tokenizers import Tokenizer
        library, letters = Tokenizer.from_str(source), dict(enumerate(byte_characters()))
        self.tokens = tokens
        self.pieces = Pieces(pattern, lambda new: [e.ids for at in range(0, len(new), PIECES) for e in library.encode_batch_fast(
            [p.encode().decode("latin-1").translate(letters) for p in new[at:at + PIECES]], add_special_tokens=False)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; each match of the pattern is encoded separately, and each distinct one once."""
        self.pieces.trim()
        rows = [self.pieces.numbers(self.pieces.find(text)) for text in texts]
        self.pieces.settle()
        return [self.pieces.ids(row) for row in rows]

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of every token; tokens that share a split character all cover it."""
        data = np.frombuffer(self.decode(ids), np.uint8)
        ends = np.cumsum(np.fromiter((len(self.tokens[i]) for i in ids), np.int64, len(ids)))
        number = np.cumsum((data & 0xC0) != 0x80)  # 1 for the bytes of the first character, and so on
        starts = np.append(0, ends[:-1]) if len(ids) else ends
        return number[starts] - 1, number[ends - 1]


def decode_parts(codec: Codec, parts):
    """Texts of consecutive id lists; bytes of a character that two lists share appear with the later one."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        yield reader.decode(codec.decode(ids))
    yield reader.decode(b"", True)


def _codec(path: str, pattern: str):
    source, tokens = library_source(path)
    made: list[Codec] = []

    def get() -> Codec:
        if not made:
            made.append(Codec(source, tokens, pattern))
        return made[0]
    return get, made.clear


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).astype(kind)) if rows else pa.array([], pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, spans: bool = False) -> DataFrame:
    """doc_id and ``ids`` of every row, on request with the character span (``starts``, ``ends``) of each token.

    Null or empty text: no ids.  Repeated rows are encoded one by one; other columns are not used.
    """
    codec, done = _codec(path, pattern)

    def encoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec().encode(batch.column(1).to_pylist())
        columns = [batch.column(0), _lists(found, np.int32)]
        if spans:
            both = [codec().spans(ids) for ids in found]
            columns += [_lists([b[i] for b in both], np.int32) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", *(["starts", "ends"] if spans else [])])
    schema = "doc_id long, ids array<int>" + (", starts array<int>, ends array<int>" if spans else "")
    return map_slices(docs.select("doc_id", whole_text().alias("text")), ["doc_id", "text"], encoded, schema, done=done)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ``data`` (bytes) and ``text`` of the ids of every row; bytes that end inside a character become U+FFFD.

    Null ids give null bytes and text.
    """
    codec, done = _codec(path, pattern)

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [None if ids is None else codec().decode(ids) for ids in batch.column(1).to_pylist()]
        text = [None if d is None else d.decode("utf-8", "replace") for d in data]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(text, pa.string())], ["doc_id", "data", "text"])
    return map_slices(encoded, ["doc_id", "ids"], decoded, "doc_id long, data binary, text string", done=done)


def round_trip(docs: DataFrame, path: str, pattern: str, contents: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded again and digested in one pass.

    With ``contents`` also the ``ids`` and the decoded ``text``.  The ids are digested as little-endian unsigned
    32-bit integers.  Null or empty text: no ids, empty text, digests of nothing.  Repeated rows are handled one by
    one; other columns are not used.
    """
    codec, done = _codec(path, pattern)

    def both(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = codec().encode(batch.column(1).to_pylist())
        data = [codec().decode(ids) for ids in found]
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(i) for i in found], pa.int64()),
                   "ids_sha256": pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in found]),
                   "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in data])}
        if contents:
            columns |= {"ids": _lists(found, np.int32), "text": pa.array([d.decode("utf-8", "replace") for d in data])}
        return pa.RecordBatch.from_pydict(columns)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, text string" if contents else "")
    return map_slices(docs.select("doc_id", whole_text().alias("text")), ["doc_id", "text"], both, schema, done=done)
