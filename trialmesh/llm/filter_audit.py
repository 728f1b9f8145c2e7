"""Filter interaction audit: what each of five filters removes, in every order in which they can be applied.

Whether a document fails a filter does not depend on the order, so counts per set of failed filters (a mask) are all
that has to be gathered; every figure of every order is a sum of some of them.  Four filters look at a text alone.
The fifth drops repeated texts: a counting Bloom filter over text hashes clears the texts that certainly occur once,
and only possible repeats are shuffled and compared as whole texts.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import map_slices, remove, store, whole_text

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
MAX_WORDS = 1 << 20
_UPPER = bytes(range(65, 91))


def failures(text: bytes, min_words: int = 200, distinct_percent: int = 50, upper_percent: int = 3, marks: bytes = b"#$%&*|") -> int:
    """The filters A to D that a text (UTF-8) fails, as bits.

    A: fewer than ``min_words`` words; B: distinct words below ``distinct_percent`` of all; C: capitals A-Z above
    ``upper_percent`` of the code points; D: one of ``marks``.  Words are runs without 0x20 and 0x09-0x0D.
    An empty text fails A only.
    """
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    chars = len(text) if text.isascii() else len(text.decode())
    return (len(words) < min_words) | (100 * len(set(words)) < distinct_percent * len(words)) << 1 \
        | (100 * upper > upper_percent * chars) << 2 | (len(text.translate(None, marks)) < len(text)) << 3


def _flags(docs: DataFrame) -> DataFrame:
    """doc_id, part, hash of the text, and the mask of filters A to D."""
    def flagged(batch: pa.RecordBatch) -> pa.RecordBatch:
        masks = [failures(t) for t in batch.column(3).cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(masks, pa.int32())], ["doc_id", "part", "hash", "mask"])
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64("text").alias("hash"), "text")
    return map_slices(rows, ["doc_id", "part", "hash", "text"], flagged, "doc_id long, part string, hash long, mask int")


def _places(hashed: Column, words: int) -> tuple[Column, list[Column]]:
    """The word of a hash in the sketch, and its three counters among the 64 of that word."""
    return F.pmod(hashed, F.lit(words)), [F.shiftright(hashed, s).bitwiseAND(F.lit(63)).cast("int") for s in (40, 46, 52)]


def crowded(hashes: DataFrame, words: int) -> DataFrame:
    """The merged sketch: (word, bits), a bit for every counter of the word that counted two or more rows.

    Each row adds one to three counters of one word.  Counters are summed inside the tasks and then over them, so at
    most 64 * ``words`` of them move a task, whatever a hash's share of the rows.
    """
    word, places = _places(F.col("hash"), words)
    counters = hashes.select(word.alias("word"), F.explode(F.array_distinct(F.array(*places))).alias("at"))
    often = counters.groupBy("word", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return often.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("bits"))


def possible_repeats(rows: DataFrame, sketch: DataFrame, words: int) -> DataFrame:
    """``rows`` (with a column hash) and ``possible``: whether all counters of the hash counted two or more.

    False is certain.  The sketch has at most ``words`` rows of two longs; it is broadcast because ``words`` is
    bounded by ``MAX_WORDS``.
    """
    word, places = _places(F.col("hash"), words)
    own = F.lit(0).cast("long")
    for place in places:
        own = own.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    held = rows.withColumn("_w", word).join(F.broadcast(sketch.withColumnRenamed("word", "_w")), "_w", "left")
    return held.withColumn("possible", F.coalesce(F.col("bits").bitwiseAND(own) == own, F.lit(False))).drop("_w", "bits")


def first_copies(docs: DataFrame, sketch: DataFrame, words: int) -> DataFrame:
    """(doc_id, hash) of the smallest doc_id of every text among the possible repeats; whole texts are compared.

    The smallest ids of a task's copies are taken before anything moves, so a text that every third row repeats moves
    once a task.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("hash"))
    some = possible_repeats(rows, sketch, words).where("possible")
    return some.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("hash").alias("hash")).select("doc_id", "hash")


def failed_filters(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """doc_id, part, mask of every row, with all five filters; and the paths of the work tables.

    Filter E fails where a smaller doc_id has an identical text.  Null text counts as empty, null lang as ''.
    A null doc_id is no smaller than any other: such rows neither fail E nor make others fail.  Rows that repeat a
    doc_id are no copies of each other.
    """
    docs = docs.select("doc_id", "lang", whole_text().alias("text"))
    flags, path = store(_flags(docs), "flags")
    used = [path]
    words = min(MAX_WORDS, max(16, 1 << (flags.count() // 4).bit_length()))  # 16 to 32 counters a row
    sketch, path = store(crowded(flags.where("doc_id IS NOT NULL"), words), "sketch")
    used.append(path)
    firsts, path = store(first_copies(docs, sketch, words).withColumn("first", F.lit(True)), "firsts")
    used.append(path)
    tested = possible_repeats(flags, sketch, words).withColumn("possible", F.col("possible") & F.col("doc_id").isNotNull())
    unique = tested.where("NOT possible").select("doc_id", "part", "mask")
    others = tested.where("possible").join(firsts, ["doc_id", "hash"], "left")
    others = others.select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(F.lit(REPEATED))).alias("mask"))
    return unique.unionByName(others), used


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of every set of failed filters; at most 32 rows a part.

    good and toxic count rows whose doc_id is labelled so (by any of its labels); only labelled ids are joined.
    """
    marked = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    every = flags.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).withColumns({"good": F.lit(0).cast("long"), "toxic": F.lit(0).cast("long")})
    some = flags.join(marked, "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(some.withColumn("n", F.lit(0).cast("long"))).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame) -> DataFrame:
    """A row per part, order and step from the counts per mask; sums over a few rows a part."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = [(o, s, 1 << FILTERS.index(o[s]), sum(1 << FILTERS.index(f) for f in o[:s])) for o in orders for s in range(len(FILTERS))]
    listed = [F.expr(f"array({', '.join(repr(x[i]) for x in steps)})").alias(n) for i, n in enumerate(("filter_order", "step", "own", "before"))]
    rows = counts.select("*", F.inline(F.arrays_zip(*listed)))
    own, before = (F.col("mask").bitwiseAND(F.col(c)) != 0 for c in ("own", "before"))
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")
    return rows.groupBy("part", "filter_order", (F.col("step") + 1).cast("int").alias("step")).agg(
        total(~own & ~before).alias("kept"), total(own & ~before).alias("removed"), total(own & before).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(own & ~before, "good").alias("good_lost"),
        total(own & ~before, "toxic").alias("toxic_lost"),
        # of all orders, a document is removed by each filter it fails equally often
        F.sum(F.when(own, F.expr(f"n * ({len(orders)} div bit_count(mask))")).otherwise(0)).cast("long").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part (lang), order of the filters A to E and step: documents left after the step, removed in it,
    failing its filter but removed earlier, failing its filter alone, labelled good or toxic among the removed, and
    the filter's removals over all orders.  See ``failed_filters`` for nulls and repeats; labels of unknown or null
    ids count nothing.  An empty table has no parts and no rows.  Other columns are not used.
    Eager: flags, sketch and first copies are written to the shared folder and removed with the result written.
    """
    flags, used = failed_filters(docs)
    counts, _ = store(mask_counts(flags, labels), "mask_counts")
    remove(docs.sparkSession, *used)
    return interactions(counts)
