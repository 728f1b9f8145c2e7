"""MinHash near-duplicates: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

One hash per shingle: its high bits name a bin, the bin keeps its smallest hash.  An empty bin borrows from a full one
that is found by a random walk of its own (optimal densification), so small sets keep the collision rate of MinHash.
Bands of bins are bucket keys.  Inside a bucket only a centre is paired with the others; pairs are confirmed on the
full sets.  A bucket whose star was not confirmed throughout gets more centres, round by round, until no two of its
components have members that have not met, so stars lose no link that the buckets hold.  In these rounds a wide
sketch of one bit a bin drops pairs that are clearly below the similarity before they become candidates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trialmesh.llm.common import dealt_anew, likely, map_slices, remove, store, whole_text
from trialmesh.llm.components import components
from trialmesh.llm.shingles import WordHashes, mixed, set_key, shingle_set

BINS, ROWS = 128, 4
WIDE = 4096


_ORDERS: dict[int, np.ndarray] = {}  # not lru_cache, which would be looked up by name where the package is not installed


def _donors(bins: int) -> np.ndarray:
    """For each bin, all bins in an order of its own."""
    if bins not in _ORDERS:
        rng = np.random.default_rng(17)
        _ORDERS[bins] = np.stack([rng.permutation(bins).astype(np.int16) for _ in range(bins)])
    return _ORDERS[bins]


def sketch(shingles: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash per bin of a sorted, non-empty set; empty bins take that of the first full bin in their order."""
    shift = np.uint64(64 - bins.bit_length() + 1)
    starts = np.searchsorted(shingles, np.arange(bins, dtype=np.uint64) << shift)
    full = np.diff(np.append(starts, len(shingles))) > 0
    values = shingles[np.minimum(starts, len(shingles) - 1)]
    donors, empty = _donors(bins), np.flatnonzero(~full)
    step = max(1, 2 * bins // max(1, int(full.sum())))
    for at in range(0, bins, step):
        if not len(empty):
            break
        order = donors[empty, at:at + step]
        hits = full[order]
        which = hits.argmax(axis=1)
        rows = np.arange(len(empty))
        found = hits[rows, which]
        values[empty[found]] = values[order[rows, which][found]]
        empty = empty[~found]
    return values


def bit_sketch(shingles: np.ndarray, bins: int = WIDE) -> np.ndarray:
    """One bit a bin, packed into longs; bits of bins whose smallest hashes differ are equal half of the time."""
    values = mixed(sketch(shingles, bins) + np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.packbits((values >> np.uint64(63)).astype(bool)).view(np.int64)


def most_bits(percent: int, bins: int = WIDE) -> int:
    """How many bits may differ at the similarity: the expected number and six standard deviations."""
    share = (100 - percent) / 200
    return int(bins * share + 6 * (bins * share * (1 - share)) ** 0.5)


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` bins; the band's number is part of the key."""
    banded = values.reshape(-1, rows)
    total = np.arange(len(banded), dtype=np.uint64)
    for i in range(rows):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + banded[:, i])
    return total.view(np.int64)


def signatures(docs: DataFrame, size: int, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and the band keys of every document."""
    words = WordHashes()

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        words.trim()
        sizes, keys, bands = [], [], []
        for text in batch.column(1).to_pylist():
            shingles = shingle_set(text, size, words)
            sizes.append(len(shingles))
            keys.append(set_key(shingles))
            bands.append(band_keys(sketch(shingles, bins), rows) if len(shingles) else np.empty(0, np.int64))
        ends = np.cumsum([0, *map(len, bands)], dtype=np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), bands],
                                          ["doc_id", "n_shingles", "set_key", "bands"])
    return map_slices(docs, ["doc_id", "text"], sketched, "doc_id long, n_shingles long, set_key binary, bands array<long>", done=words.clear)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id and the whole shingle set of every document."""
    words = WordHashes()

    def listed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words.trim()
        sets = [shingle_set(text, size, words) for text in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        values = pa.array(np.concatenate(sets).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "shingles"])
    return map_slices(docs, ["doc_id", "text"], listed, "id long, shingles array<long>", done=words.clear)


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Sets are built again from the texts of the documents that occur in a pair; only the sets move.
    """
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets, path = store(full_sets(likely(docs, ids), size), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b")
    both = both.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a")
    common = F.size(F.array_intersect("_a", "_b"))
    both = both.select("a", "b", common.alias("_i"), (F.size("_a") + F.size("_b")).alias("_n"))
    links, kept = store(both.where(100 * F.col("_i") >= percent * (F.col("_n") - F.col("_i"))).select("a", "b").distinct(), "links")
    remove(spark, path)
    return links, kept


def wide_sketches(docs: DataFrame, size: int) -> DataFrame:
    """id and the bit sketch of every document with shingles."""
    words = WordHashes()

    def sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
        words.trim()
        sets = [shingle_set(text, size, words) for text in batch.column(1).to_pylist()]
        bits = [bit_sketch(s) if len(s) else np.zeros(WIDE // 64, np.int64) for s in sets]
        ends = np.arange(0, WIDE // 64 * len(bits) + 1, WIDE // 64, dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bits)))], ["id", "bits"])
    return map_slices(docs, ["doc_id", "text"], sketched, "id long, bits array<long>", done=words.clear)


def _could_link(percent: int):
    """Whether the sizes allow the similarity at all."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _differing(left: str, right: str):
    """Number of bits in which two sketches differ."""
    words = [F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(WIDE // 64)]
    while len(words) > 1:
        words = [sum(words[i:i + 2][1:], words[i]) for i in range(0, len(words), 2)]
    return words[0]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of ``size``-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id reachable over links.  Equal sets are linked without a comparison.

    With 32 bands of 4 bins a pair at similarity 0.8 shares no bucket with probability 5e-8; it differs in more bits
    of the wide sketch than allowed with probability 1e-9.
    Null or empty text: no shingles, its own component, kept.  Null doc_id: in no component (component_id null), kept.
    Rows that repeat a doc_id count as one document, linked if any of its texts is.  Other columns are not used.
    Eager: work tables are written below the shared folder; all but the result's are removed.
    """
    spark, used = docs.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table, path = store(df, name)
        used.append(path)
        return table
    docs = docs.select("doc_id", whole_text().alias("text"))
    signed = keep(signatures(docs, size, bins, rows), "signatures")
    real = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = keep(real.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("id", "n", F.explode("bands").alias("key"))
    centres = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("c"), F.max("id").alias("_last"))
    centres = centres.where("c.id < _last").select("key", F.col("c.id").alias("a"), F.col("c.n").alias("n_a"))
    crowded = keep(entries.join(dealt_anew(centres, "a"), "key"), "buckets")

    star = crowded.where("id > a").select("a", "n_a", F.col("id").alias("b"), F.col("n").alias("n_b")).where(_could_link(percent))
    links = _confirm(keep(star.select("a", "b").distinct(), "pairs"), docs, size, percent, used)
    labels = _label(links, used)

    def labelled(table: DataFrame) -> DataFrame:
        named = labels.select("id", F.col("component_id").alias("_label"))
        return table.join(named, "id", "left").withColumn("label", F.coalesce("_label", "id")).drop("_label")

    # Buckets that still hold several components: more centres, until all members of different ones have met.
    # The first centre has met everyone, and what it is not linked to is all that matters of a bucket.
    rest, sketched, fan = crowded.where("id > a").select("key", "id", "n"), None, 16
    while True:
        now = labelled(rest)
        split = now.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
        rest = keep(now.join(split.where("_lo < _hi").select("key"), "key", "left_semi"), "open")
        if rest.isEmpty():
            break
        if sketched is None:
            some = likely(docs, rest.select(F.col("id").alias("doc_id")))
            sketched = keep(wide_sketches(some, size).groupBy("id").agg(F.min("bits").alias("bits")), "sketches")
        slot = F.pmod(F.xxhash64("label"), F.lit(fan))
        chosen = keep(rest.groupBy("key", slot.alias("_slot")).agg(F.min("id").alias("id")).select("id").distinct(), "centres")
        facts = rest.groupBy("id").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_set("key").alias("keys"))
        facts = facts.join(sketched, "id").join(chosen.select("id", F.lit(True).alias("_c")), "id", "left")
        facts = keep(facts.withColumn("centre", F.coalesce("_c", F.lit(False))).drop("_c"), "facts")
        members = facts.select(F.col("id").alias("m"), F.col("n").alias("n_b"), F.col("label").alias("m_label"), F.col("keys").alias("m_keys"),
                               F.col("bits").alias("m_bits"), F.col("centre").alias("m_centre"), F.explode("keys").alias("key"))
        tops = facts.where("centre").select(F.col("id").alias("c"), F.col("n").alias("n_a"), F.col("label").alias("c_label"), F.col("keys").alias("c_keys"),
                                            F.col("bits").alias("c_bits"), F.explode("keys").alias("key"))
        once = ~F.col("m_centre") | (F.col("c") < F.col("m"))  # two centres meet once, in the first bucket they share
        meet = (F.col("l.key") == F.col("r.key")) & (F.col("c_label") != F.col("m_label")) & once & _could_link(percent) \
            & (_differing("c_bits", "m_bits") <= most_bits(percent)) & (F.array_min(F.array_intersect("c_keys", "m_keys")) == F.col("l.key"))
        pairs = tops.alias("l").join(members.alias("r"), meet).select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b"))
        more = _confirm(keep(pairs, "pairs"), docs, size, percent, used)
        if not more.isEmpty():
            links = keep(links.unionByName(more), "links")
            labels = _label(links, used)
        rest, fan = rest.join(chosen, "id", "left_anti").select("key", "id", "n"), fan * 8
    named = labelled(classes.select("set_key", "id")).select("set_key", "label")
    found = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    result, _ = store(found.select("doc_id", "n_shingles", component.alias("component_id"),
                                   component.eqNullSafe(F.col("doc_id")).alias("kept")), "near_duplicates")
    remove(spark, *used)
    return result


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int, used: list[str]) -> DataFrame:
    """``confirmed``, its table noted for removal."""
    links, path = confirmed(pairs, docs, size, percent)
    used.append(path)
    return links


def _label(links: DataFrame, used: list[str]) -> DataFrame:
    """Components of the links, the table noted for removal."""
    labels, path = components(links)
    used.append(path)
    return labels
