"""Line dedup: lines that repeat over many documents go, apart from those of one document. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import bit_map, dealt_anew, marked, remove, store

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``.

    Texts are split at line feeds.  A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
    documents loses all its lines except those of the largest doc_id that holds it; the rest is joined in its order.
    Keys are compared by their 128-bit hash.

    Null or empty text: one empty line, and the text comes back as an empty string.  Rows that repeat a doc_id count
    as one document, and each keeps its own lines.  A row without doc_id is not counted and loses nothing.
    Columns ``n_lines`` and ``n_dropped`` of the input are replaced; all others are passed on.

    Texts are split once; what is written of them is the hash, document and place of every line that counts.  A key is
    counted per document before it is counted over documents, so a line of every third row costs one row a task; the
    joins are equi-joins that adaptive execution splits where one line is very common.  Only texts that lose a line
    move, found by a bit map of bounded size; the others are passed on where they lie.  Eager: the places of lines are
    written to the shared folder.
    """
    others = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("_row", "_text", F.col("_row.doc_id").alias("_id"), F.xxhash64("_text").alias("_version"))
    lines = rows.where("_id IS NOT NULL").select("_id", "_version", F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))
    lines = lines.select("_id", "_version", "_at", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars)
    lines, path = store(lines.select("_id", "_version", "_at", F.unhex(F.md5("_key")).alias("_key")), "lines")
    held = lines.select("_key", "_id").distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.max("_id").alias("_keeper"))
    repeated = dealt_anew(held.where(F.col("_docs") >= min_docs).select("_key", "_keeper"), "_keeper")
    gone = lines.join(repeated, "_key").where("_id <> _keeper")
    gone, _ = store(gone.groupBy("_id", "_version").agg(F.collect_set("_at").alias("_gone")), "gone")
    remove(docs.sparkSession, path)
    key = F.struct("_id", "_version")
    tested = marked(rows, bit_map(gone, key), key, "_some")
    others = tested.where("NOT _some").withColumn("_gone", F.lit(None).cast("array<int>"))
    found = others.unionByName(tested.where("_some").join(gone, ["_id", "_version"], "left"))
    breaks = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit("")))
    lost = F.size(F.coalesce("_gone", F.array().cast("array<int>")))
    found = found.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split("_text", "\n", -1)))
    found = found.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.transform("_left", lambda at: F.col("_lines")[at]), "\n"))
    values = {"text": kept, "n_lines": (breaks + 1).cast("long"), "n_dropped": lost.cast("long")}
    order = [*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns]]
    return found.select(*[values[c].alias(c) if c in values else F.col("_row")[c].alias(c) for c in order])
