"""Document fingerprints by winnowing. DataFrame functions only.

Every ``gram`` code points have a rolling hash: a polynomial of their symbols, in which a run takes over the values of
the shorter runs that it is made of; of every ``window`` neighbouring hashes the smallest is kept, the rightmost of
equal ones, with its position.  Two texts that share ``gram + window - 1`` code points in a row share a mark.

A mark is one long: 32 bits of hash, shifted by 32 places, minus the position, so the smallest long of a window is the
smallest hash at its rightmost place.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window as W

GRAM, WINDOW = 8, 32
_LOW = (1 << 32) - 1
CELL_BYTES = 64 << 20
PRIME, BASE = (1 << 31) - 1, 1_403_580_307


def _mark(hashed: Column, at: Column) -> Column:
    return F.shiftleft(hashed, 32) - at


def _hash_of(mark: Column) -> Column:
    return F.shiftright(mark + _LOW, 32)


def _place_of(mark: Column) -> Column:
    return F.negative(mark).bitwiseAND(_LOW)


def mark_hashes(marks: Column) -> Column:
    return F.transform(marks, _hash_of)


def positions(marks: Column) -> Column:
    return F.transform(marks, _place_of)


def _held(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside the lambda it is a variable, not read from the row again."""
    return F.transform(F.array(value), use)[0]


def _rolled(gram: int, symbols: Column) -> Column:
    """Polynomial values of all runs of ``gram`` symbols, by the places they start at; null where a run is not whole.

    The value of a run is rolled from those of its parts: twice as many symbols with every pass, each place adding the
    value that lies as far behind it.  Factors are below 2 ** 31, so no step leaves the range of a long.
    """
    def rest(parts: Column, length: int, done: Column | None, taken: int) -> Column:
        if gram & length:
            joined = parts if done is None else F.zip_with(done, F.slice(parts, taken + 1, F.size(parts)), _joined(length))
            done, taken = joined, taken + length
        if taken == gram:
            return done
        if gram & length:  # read again below: hold both
            both = F.struct(parts.alias("parts"), done.alias("done"))
            return _held(both, lambda h: rest(F.zip_with(h["parts"], F.slice(h["parts"], length + 1, F.size(h["parts"])), _joined(length)), 2 * length, h["done"], taken))
        return _held(parts, lambda h: rest(F.zip_with(h, F.slice(h, length + 1, F.size(h)), _joined(length)), 2 * length, done, taken))
    return rest(symbols, 1, None, 0)


def _joined(length: int):
    factor = F.lit(pow(BASE, length, PRIME))
    return lambda left, right: (left * factor + right) % PRIME


def _hashed(gram: int):
    """Marks of all grams of a text given as four bytes a code point; of the whole text where it is shorter."""
    def of(code: Column) -> Column:
        n = (F.octet_length(code) / 4).cast("int")
        symbols = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.substring(code, i * 4 + 1, F.lit(4))).bitwiseAND(PRIME - 1))
        grams = F.slice(_rolled(gram, symbols), 1, n - (gram - 1))
        return F.when(n >= gram, F.transform(grams, _mark)).when(n > 0, F.array(_mark(F.xxhash64(code), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    return of


def _smallest(step: int):
    """Minima over two places that lie ``step`` apart; at the end, where there is one only, that one."""
    return lambda marks: F.zip_with(marks, F.slice(marks, step + 1, F.size(marks)), lambda x, y: F.least(x, y))


def add_marks(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add the marks of column ``text`` (not null) in the order of their positions.

    A text shorter than ``gram`` is hashed as a whole; one too short for a window keeps its smallest hash; an empty
    text has no mark.  ``window`` is a power of two: minima over 2, 4, 8 ... neighbours take one pass each.
    """
    if window & (window - 1) or window < 2:
        raise ValueError("window must be a power of two")
    marks, step = _held(F.encode(F.col(text), "UTF-32"), _hashed(gram)), 1
    while step < window:
        marks, step = _held(marks, _smallest(step)), step * 2
    whole = _held(marks, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (window - 1), F.lit(1))))  # windows that are whole
    return df.withColumn(out, F.array_distinct(whole))


def _until(marks: Column, last: Column, window: int) -> Column:
    """The marks that some window starting at ``last`` or earlier chooses.

    A mark is first chosen either when it enters a window as the new minimum, or when the one before it has left.
    """
    def first(m: Column, i: Column) -> Column:
        before = marks[i - 1]
        return F.when(i == 0, F.lit(0)).when(m < before, F.greatest(_place_of(m) - (window - 1), F.lit(0))).otherwise(_place_of(before) + 1)
    return F.filter(marks, lambda m, i: first(m, i) <= last)


def likeness(left: Column, right: Column) -> Column:
    """Shared over all hashes of two lists of distinct hashes; two empty ones are alike."""
    def of(both: Column) -> Column:
        either = F.size(left) + F.size(right) - both
        return F.when(either == 0, F.lit(1.0)).otherwise(both / either)
    return _held(F.size(F.array_intersect(left, right)), of)


def as_string(marks: Column) -> Column:
    """The hashes as decimal numbers, in the order of the text."""
    return F.array_join(mark_hashes(marks).cast("array<string>"), " ")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``marks`` and ``fingerprint``; null text counts as empty. Columns of those names are replaced."""
    kept = docs.drop("marks", "fingerprint").withColumn("_text", F.coalesce("text", F.lit("")))
    return add_marks(kept, "_text", "marks", gram, window).drop("_text").withColumn("fingerprint", as_string(F.col("marks")))


def _in_cells(docs: DataFrame, tasks: int) -> tuple[DataFrame, int]:
    """doc_id, text, _hash and _cell: ranges in the order of ``against_next`` of about equal numbers of rows.

    There are as many ranges as the texts need at 64 MB each, at least two a task and at most 50,000.  An id that fills
    several of them, and missing ids, are cut further by the hash of the text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("named")).first()
    cells = min(max(2 * tasks, size["bytes"] // CELL_BYTES + 1), 50_000)
    edges = rows.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], cells * 20).alias("e")).first()["e"] or [0]
    hot = {e: n for e, n in Counter(edges).items() if n > 1 and abs(e) < 1 << 53}  # larger ones are not exact as doubles
    splits = [float("-inf"), *sorted({float(e) for e in edges}), float("inf")]
    parts = {float(e): n for e, n in hot.items()}
    starts, total = [0] * (len(splits) - 1), 0
    for b in reversed(range(len(starts))):  # the largest ids first; of a range, the ids above its hot one
        starts[b], total = total, total + 1 + parts.get(splits[b], 0)
    unnamed = -(-(size["rows"] - size["named"]) * cells // max(size["rows"], 1))
    share = lambda n: F.least((F.col("_hash") / 2.0 ** 64 + 0.5) * n, F.lit(n - 1)).cast("int")
    inside = F.lit(0)
    if hot:
        known = F.try_element_at(F.create_map(*[F.lit(x) for e, n in hot.items() for x in (e, n)]), F.col("doc_id"))
        inside = F.coalesce(1 + share(known).cast("int"), F.lit(0))
    rows = Bucketizer(splits=splits, inputCol="_id", outputCol="_b", handleInvalid="keep").transform(rows.withColumn("_id", F.col("doc_id").cast("double")))
    start = F.get(F.lit(starts), F.col("_b").cast("int"))
    cell = F.when(F.col("doc_id").isNull(), total + share(F.lit(max(unnamed, 1)))).otherwise(start + inside)
    return rows.select("doc_id", "text", "_hash", cell.cast("int").alias("_cell")), total + unnamed


def against_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Every document against the next one and against its own edited text.

    The next document is that of the next smaller doc_id, after the smallest the largest.  The edited text is the text
    with its last floor(n / 2) code points replaced by the first as many (or all) of the next text.  Result: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_marks.

    Null text counts as empty; an empty text has an empty fingerprint.  Null ids come last; rows of equal ids are
    ordered by the hash of their texts, so results do not depend on the order of storage.  Other columns are not used.

    Documents are dealt out once, by ranges of doc_id; into every range goes a copy of the first row of the following
    one.  Marks are computed once per text: those of an edited text are the ones that windows inside its two parts
    choose, and those of the few windows across the seam; without a right part there is no seam.
    """
    spark, span = docs.sparkSession, gram + window - 1
    rows, cells = _in_cells(docs, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = rows.groupBy("_cell").agg(F.min(F.struct(F.bitwise_not("doc_id").alias("place"), "_hash")).alias("first"))
    firsts = sorted((r["_cell"], None if r["first"]["place"] is None else ~r["first"]["place"], r["first"]["_hash"]) for r in order.collect())  # a row per range
    if not firsts:
        heads = rows.limit(0)
    else:
        following = [(cell, *firsts[(i + 1) % len(firsts)]) for i, (cell, _, _) in enumerate(firsts)]
        small = spark.createDataFrame(following, "_to int, _cell int, doc_id long, _hash long")
        heads = rows.join(F.broadcast(small), rows["doc_id"].eqNullSafe(small["doc_id"]) & (rows["_cell"] == small["_cell"]) & (rows["_hash"] == small["_hash"]))
        heads = heads.select(rows["doc_id"], "text", rows["_hash"], F.col("_to").alias("_cell"))
    every = rows.withColumn("_head", F.lit(False)).unionByName(heads.withColumn("_head", F.lit(True)))
    every = every.repartitionById(max(cells, 1), "_cell")
    every = add_marks(every, "text", "marks", gram, window).withColumn("_hashes", F.array_distinct(mark_hashes(F.col("marks"))))
    following = W.partitionBy("_cell").orderBy("_head", F.col("doc_id").desc_nulls_last(), "_hash", "text")
    every = every.withColumn("_next", F.lead(F.struct("text", "marks", "_hashes")).over(following)).where("NOT _head")
    n = F.length("text")
    every = every.withColumn("n_chars", n.cast("long")).withColumn("_cut", F.floor(n / 2).cast("int"))
    every = every.withColumn("_left", F.expr("left(text, n_chars - _cut)")).withColumn("_right", F.expr("left(_next.text, _cut)"))
    every = every.withColumn("_n_left", F.length("_left")).withColumn("_n_right", F.length("_right"))  # not once per mark
    left, right = F.col("_n_left"), F.col("_n_right")
    short = left + right < span
    every = every.withColumn("_seam", F.when(short, F.concat("_left", "_right")).otherwise(
        F.concat(F.expr(f"right(_left, {span - 1})"), F.expr(f"left(_right, {span - 1})"))))
    every = add_marks(every, "_seam", "_across", gram, window)
    moved = lambda marks, by: F.transform(marks, lambda m: m - by)  # noqa: E731  a mark falls as its place grows
    across = F.when(~short & (right > 0), moved(F.col("_across"), F.greatest(left - (span - 1), F.lit(0)))).otherwise(F.array().cast("array<long>"))
    joined = F.array_distinct(F.concat(_until(F.col("marks"), left - span, window), across,
                                       moved(_until(F.col("_next.marks"), right - span, window), left)))
    every = every.withColumn("_edited", F.when(short, F.col("_across")).otherwise(joined))
    every = every.withColumn("_edited_hashes", F.array_distinct(mark_hashes(F.col("_edited"))))
    return every.select(
        "doc_id", "n_chars", F.sha2(F.concat("_left", "_right"), 256).alias("edited_sha256"), as_string(F.col("marks")).alias("fingerprint"),
        as_string(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_hashes"), F.col("_edited_hashes")).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next._hashes")).alias("near_next"), F.size("marks").cast("long").alias("n_marks"))
