import base64
import hashlib

import numpy as np
import pytest

from trialmesh.llm import byte_bpe, token_counts

P = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
ODD = ["  a", "a  ", " \n \t x  y", "don't 'S 'll''ve", "x" * 300, "aaaaaaaabbbbbbbb" * 30, "🙂" * 9, "é ü ß 世界 ​", "١٢٣ ½ Ⅷ", "\x00\x07", "!!!???...", "<|endoftext|>",
       "a <|endoftext|>  b<|endoftext|><|endoftext|>", " ", "\n", "The\r\n\r\nEnd", "ſt 'ſ", "\U000e0001"]


@pytest.fixture(scope="module")
def rows(prose):
    return prose + list(enumerate(ODD, 1000)) + [(None, "null id"), (10, "repeated id")]


def test_counts_equal_the_library(docs_of, rows):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs_of(rows), P.path("byte_bpe_50k.json"), 100).collect())
    want = [(i or -1, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows]
    assert got == sorted(want)
    assert token_counts.token_counts(docs_of([]), P.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(P.path("word_bpe_49k.json"))


def test_ids_equal_the_library_and_decode(docs_of, rows):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((i or -1, library.encode_ordinary(t or "")) for i, t in rows)
    encoded = byte_bpe.encode(docs_of(rows), P.path(RANKS), P.PATTERN)
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in encoded.collect()) == want
    decoded = byte_bpe.decode(encoded, P.path(RANKS), P.PATTERN).collect()
    texts = sorted((i or -1, t or "") for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in decoded) == texts
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(docs_of(rows), P.path(RANKS), P.PATTERN).collect())
    assert got == sorted((i or -1, len(x), digest(np.array(x, "<u4").tobytes()), digest((t or "").encode())) for (i, t) in rows for x in [library.encode_ordinary(t or "")])
    assert byte_bpe.round_trip(docs_of([]), P.path(RANKS), P.PATTERN).count() == 0


def test_every_token_decodes_and_the_other_vocabulary_works():
    for name in (RANKS, "byte_bpe_multi_50k.tiktoken"):
        source, tokens = byte_bpe.library_source(P.path(name))
        codec = byte_bpe.Codec(source, tokens, P.PATTERN)
        assert codec.decode(range(len(tokens))) == b"".join(tokens)
        ids = codec.encode(ODD)
        assert [codec.decode(i).decode() for i in ids] == ODD


def test_spans_and_split_characters(docs_of):
    text = "a 🙂🙂 世界 e"
    row = byte_bpe.encode(docs_of([(1, text), (2, "")]), P.path(RANKS), P.PATTERN, spans=True).where("doc_id = 1").first()
    codec = byte_bpe.Codec(*byte_bpe.library_source(P.path(RANKS)), P.PATTERN)
    covered = set()
    for token, start, end in zip(row["ids"], row["starts"], row["ends"]):
        assert text[start:end].encode().find(codec.decode([token])) >= 0
        covered |= set(range(start, end))
    assert covered == set(range(len(text)))
    cut = len(row["ids"]) // 2
    for cut in range(len(row["ids"])):
        assert "".join(byte_bpe.decode_parts(codec, [row["ids"][:cut], row["ids"][cut:]])) == text
