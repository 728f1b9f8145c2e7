"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from trialmesh.llm.common import in_fold, map_batches, store

PROFILE = 300
SPACE = 32


_TABLES: dict[str, np.ndarray] = {}  # not lru_cache, which would be looked up by name where the package is not installed


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _TABLES:
        _TABLES["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _TABLES["letters"]


def grams(text: str) -> np.ndarray:
    """The n-grams (1 to 3) of the words of a text, packed with 21 bits a code point; words are padded with a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, SPACE)
    points = np.concatenate(([SPACE], points, [SPACE]))
    gap = points == SPACE
    points = points[~(gap & np.append(gap[1:], False))]  # runs of gaps become one
    gap = points == SPACE
    if len(points) < 3:
        return np.empty(0, np.int64)
    one = points[~gap]
    two = points[:-1] | points[1:] << 21
    three = (points[:-2] | points[1:-1] << 21 | points[2:] << 42)[~gap[1:-1]]
    return np.concatenate((one, two, three))


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, and how often each occurs."""
    return np.unique(grams(text), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties in ascending order."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


def profiles(docs: DataFrame, size: int = PROFILE, per_language: int = 10_000) -> DataFrame:
    """(lang, gram, place): the ``size`` most frequent n-grams of each language of documents outside the held-out fold.

    At most about ``per_language`` documents of a language are read for it, chosen by the hash of their ids: the
    stated bound of the training sample.  The shares (a row per language) are written first, so the planner knows
    their size and no text moves by language.  Counts are added up per group of documents, then over groups.
    """
    train = docs.where(~in_fold() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share, _ = store(train.groupBy("lang").agg((F.lit(per_language) / F.count(F.lit(1))).alias("share")), "shares")
    chosen = train.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {}

        def merge(lang: str) -> None:
            keys, counts = (np.concatenate(x) for x in zip(*rows[lang], strict=True))
            distinct, at = np.unique(keys, return_inverse=True)
            rows[lang] = [(distinct, np.bincount(at, counts, len(distinct)).astype(np.int64))]
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.setdefault(lang, []).append(frequencies(text))
            if len(rows[lang]) > 200:
                merge(lang)
        for lang in rows:
            merge(lang)
        found = [(lang, *x[0]) for lang, x in rows.items()]
        return pa.RecordBatch.from_arrays([pa.array([lang for lang, keys, _ in found for _ in keys], pa.string()),
                                           pa.array(np.concatenate([k for _, k, _ in found])), pa.array(np.concatenate([c for _, _, c in found]))],
                                          ["lang", "gram", "n"])
    counts = map_batches(chosen, ["lang", "text"], counted, "lang string, gram long, n long", rows=2000).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place")


def predict(docs: DataFrame, learned: list[tuple[str, int, int]], size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score of every row by the smallest out-of-place distance to the learned profiles."""
    names = sorted({lang for lang, _, _ in learned})
    keys = np.array(sorted({gram for _, gram, _ in learned}), np.int64)
    places = np.full((len(keys) + 1, len(names)), size, np.int64)
    missing = np.ones_like(places, dtype=bool)
    for lang, gram, place in learned:
        at = int(np.searchsorted(keys, gram)), names.index(lang)
        places[at], missing[at] = place - 1, False

    def guess(text: str | None) -> tuple[str, float]:
        found = ranked(*frequencies(text), size) if text and names else ()
        if not len(found):
            return "und", 0.0
        at = np.searchsorted(keys, found)
        at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != found)] = len(keys)
        apart = np.where(missing[at], size, np.abs(places[at] - np.arange(len(found))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return names[best], float(1 - apart[best] / (size * len(found)))

    def guessed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [guess(text) for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                                          ["doc_id", "lang_pred", "score"])
    return map_batches(docs, ["doc_id", "text"], guessed, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, size: int = PROFILE, per_language: int = 10_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Profiles are learned from rows with text and lang whose id is outside the held-out fold; a prediction reads the
    whole text and nothing else.  score is 1 minus the share of the largest possible distance, so 0 to 1.
    ``und`` and score 0: null text, text without letters, or nothing to learn from.  Equal distances: the language
    name that sorts first.  A null id is not held out.  Repeated rows are predicted one by one.
    Eager: the profiles (``size`` rows a language) are read to the driver, as they travel with every task.
    """
    learned = [(r["lang"], r["gram"], r["place"]) for r in profiles(docs, size, per_language).collect()]
    found = predict(docs, learned, size)
    return found.select("doc_id", in_fold().alias("held_out"), "lang_pred", "score")
