"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions.  A decision is predicted from the bytes before it: for each number of them, from
none to ``DEPTH``, a Krichevsky-Trofimov estimate, all mixed with the weights that context-tree weighting gives them
after the training texts.  The weights come from the block probabilities of the tree's nodes, level by level from the
longest contexts down; that is a grouping in Spark per level.  The probability of a byte depends on the ``DEPTH`` bytes
before it alone, so the model ends as a table with one logarithm per byte gram that occurs anywhere.

A text is scored as its words in lower case, a space after each, and an end.  Beside it stands the score of a word model
without contexts.  Frequent grams and words, a bounded number of them, travel with the tasks; what is rare is joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from trialmesh.llm.common import release, remove, slices, store, whole_text

DEPTH = 5
START, END = 0xFE, 0xFF  # two bytes that UTF-8 never uses
KEEP_GRAMS, KEEP_WORDS = 1 << 20, 1 << 18
LONG = 64
PIECE, TEXT_BITS = 1 << 22, 12
_TEXTS, _TEXT_BYTES = (1 << TEXT_BITS) - 1, 1 << 22
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[9:14] = 32
_PLAIN[65:91] += 32


def held_out(key: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text, modulo ``folds``, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def spelled(texts: list[bytes], depth: int) -> np.ndarray:
    """The bytes of several texts in a row: each after ``depth`` start bytes, its words in lower case, a space after every word, its end byte."""
    head = bytes([START] * depth)
    data = _PLAIN[np.frombuffer(head + (bytes([32, END]) + head).join(texts) + bytes([32, END]), np.uint8)]
    word = (data != 32) & (data < START)
    keep = data != 32
    keep[1:] |= word[:-1]  # of the space after a word the first place
    return data[keep]


def words_of(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of spelled texts, each with its space (or as a digest, where it is long), and the number of words of each text."""
    per_text = np.diff(np.append(0, np.cumsum(data == 32)[data == END]))
    letters = data[data < START]
    ends = np.flatnonzero(letters == 32) + 1
    offsets = np.append(0, ends).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    if len(ends) and np.diff(offsets).max() > LONG:
        words = pa.array([w if len(w) <= LONG else b"\x00" + hashlib.blake2b(w, digest_size=32).digest() for w in words.to_pylist()], pa.binary())
    return words, per_text


def grams(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of the grams that end at each position from ``depth`` on, with the first position; those of start bytes are -1."""
    padded = np.concatenate((np.full(7 - depth, START, np.uint8), data))
    for at in range(depth, len(data), PIECE):
        end = min(at + PIECE, len(data))
        found = np.ndarray((end - at,), ">i8", padded, offset=at - depth, strides=(1,)).astype(np.int64)
        found &= (1 << 8 * (depth + 1)) - 1
        found[data[at:end] == START] = -1
        yield at, found


class Tally:
    """Counts of grams and words of one task, in training texts and in all; handed over when they grow too large."""

    SCHEMA = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("train", pa.int64())])

    def __init__(self, depth: int, most: int = 1 << 21):
        self.depth, self.most = depth, most
        self.held: dict[str, list[pa.Table]] = {"gram": [], "word": []}

    def note(self, kind: str, keys: pa.Array, n: np.ndarray, train: bool) -> None:
        self.held[kind].append(pa.table({kind: keys, "n": n, "train": n if train else np.zeros_like(n)}))

    def add(self, texts: list[bytes], train: bool) -> None:
        data = spelled(texts, self.depth)
        for _, found in grams(data, self.depth):
            keys, n = np.unique(found, return_counts=True)
            start = int(np.searchsorted(keys, 0))
            self.note("gram", pa.array(keys[start:]), n[start:], train)
        words, _ = words_of(data)
        counts = words.value_counts()
        self.note("word", counts.field("values"), counts.field("counts").to_numpy(), train)
        self.note("word", pa.array([b""], pa.binary()), np.array([len(texts)]), train)

    def handed(self, kind: str, least: int) -> Iterator[pa.RecordBatch]:
        """All counts of a kind, once there are more than ``least`` of them."""
        if sum(len(t) for t in self.held[kind]) <= least:
            return
        table = pa.concat_tables(self.held[kind]).group_by(kind, use_threads=False).aggregate([("n", "sum"), ("train", "sum")]).rename_columns([kind, "n", "train"])
        self.held[kind] = [table]
        if len(table) > least // 2:
            other = "word" if kind == "gram" else "gram"
            table = table.append_column(other, pa.nulls(len(table), self.SCHEMA.field(other).type)).select(self.SCHEMA.names)
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)
            self.held[kind] = []

    def full(self, least: int | None = None) -> Iterator[pa.RecordBatch]:
        for kind in self.held:
            yield from self.handed(kind, self.most if least is None else least)


def tallies(docs: DataFrame, depth: int) -> DataFrame:
    """gram or word, n, train: counts of the tasks over all texts, read once, and over those that train."""
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(depth)
        for batch in batches:
            for part in slices(batch, _TEXTS, _TEXT_BYTES):
                out = part.column(0).to_pylist()
                texts = part.column(1).cast(pa.binary()).to_pylist()
                for held in (False, True):
                    some = [t for t, o in zip(texts, out, strict=True) if o == held]
                    if some:
                        tally.add(some, not held)
                yield from tally.full()
        yield from tally.full(0)
        del tally
        release()
    return docs.select("held_out", "text").mapInArrow(counted, "gram long, word binary, n long, train long")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of values of at least 0.5: the asymptotic series, eight places up."""
    low = sum(np.log(x + k) for k in range(8))
    x = x + 8
    inverse = 1 / (x * x)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - low


def estimated(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Estimates of a level's grams, in order and with whole contexts: three values per gram and decision.

    A node is a context and the decisions made so far, so its grams are neighbours.  ``below`` holds the logarithms of
    the weighted probabilities of the next level, summed per gram.  Result: the estimate of the decision that the
    gram takes, the weight of stopping at this level, and the logarithm of the node's own weighted probability, at the
    first gram of the node (0 at the others, so that sums count a node once).
    """
    estimate, stop, up = np.empty((len(keys), 8)), np.ones((len(keys), 8)), np.zeros((len(keys), 8))
    for k in range(8):
        node = keys >> (8 - k)
        start = np.append(True, node[1:] != node[:-1])
        first, own = np.flatnonzero(start), np.cumsum(start) - 1
        bit = (keys >> (7 - k)) & 1
        total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
        zeros = total - ones
        block = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(total + 1.0)
        weighted = block
        if below is not None:
            weighted = np.log(0.5) + np.logaddexp(block, np.add.reduceat(below[:, k], first))
            stop[:, k] = np.exp(np.log(0.5) + block - weighted)[own]
        up[first, k] = weighted
        estimate[:, k] = (np.where(bit == 1, ones[own], zeros[own]) + 0.5) / (total[own] + 1.0)
    return estimate, stop, up


def _lists(values: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel().astype(kind)))


def level(rows: DataFrame, deepest: bool) -> DataFrame:
    """gram, n, every, estimate, stop, up of a level's rows (gram, n, every, and u0 to u7 but for the deepest level).

    Rows are dealt by context and sorted; a context has at most 256 of them, which is all a task holds beyond a batch.
    """
    names = ["gram", "n", "every", *([] if deepest else [f"u{i}" for i in range(8)])]

    def part(columns: list[np.ndarray]) -> pa.RecordBatch:
        keys, n, every, *below = columns
        estimate, stop, up = estimated(keys, n, np.column_stack(below) if below else None)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(every), _lists(estimate, np.float32), _lists(stop, np.float32), _lists(up, np.float64)],
                                          ["gram", "n", "every", "estimate", "stop", "up"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns
            if not len(columns[0]):
                continue
            whole = int(np.searchsorted(columns[0], columns[0][-1] >> 8 << 8))
            if whole:
                yield part([c[:whole] for c in columns])
            held = [c[whole:] for c in columns]
        if held and len(held[0]):
            yield part(held)
        release()
    placed = rows.select(*names).repartition(F.shiftright("gram", 8)).sortWithinPartitions("gram")
    return placed.mapInArrow(each, "gram long, n double, every long, estimate array<float>, stop array<float>, up array<double>")


def model(counts: DataFrame, depth: int) -> tuple[DataFrame, list[str]]:
    """(gram, n, lp) of every gram: its occurrences in all texts and the logarithm (base 10) of its last byte's probability.

    ``counts`` has gram, n, train.  Levels are written one after the other, the longest contexts first; then a gram's
    mixture is followed from the empty context to the longest: what is left of the weight goes on at every level.
    """
    used, levels, places = [], {}, range(8)
    rows = counts.select("gram", F.col("train").cast("double").alias("n"), F.col("n").alias("every"))
    for d in range(depth, -1, -1):
        levels[d], path = store(level(rows, d == depth), f"level{d}")
        used.append(path)
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1))
        rows = levels[d].groupBy(shorter.alias("gram")).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("every"),
                                                             *[F.sum(F.col("up")[i]).alias(f"u{i}") for i in places])
    estimate, stop = (lambda i: F.col("estimate")[i].cast("double")), (lambda i: F.col("stop")[i].cast("double"))
    mixed = levels[0].select("gram", "every", *[(stop(i) * estimate(i)).alias(f"p{i}") for i in places], *[(1 - stop(i)).alias(f"l{i}") for i in places])
    for d in range(1, depth + 1):
        above = mixed.drop("every").withColumnRenamed("gram", "_g")
        both = levels[d].join(above, F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("_g"))
        mixed = both.select("gram", "every", *[(F.col(f"p{i}") + F.col(f"l{i}") * stop(i) * estimate(i)).alias(f"p{i}") for i in places],
                            *[(F.col(f"l{i}") * (1 - stop(i))).alias(f"l{i}") for i in places])
    found, path = store(mixed.select("gram", F.col("every").alias("n"), sum((F.log10(f"p{i}") for i in places), F.lit(0.0)).alias("lp")), "model")
    remove(counts.sparkSession, *used)
    return found, [path]


def frequent(rows: DataFrame, most: int) -> pa.Table:
    """The rows of the largest ``n``, at most ``most`` of them: those from the smallest step of n on that leaves so few."""
    step = F.floor(F.log2("n") * 8).cast("int")
    found = rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()  # 8 rows a doubling
    least, total = None, 0
    for r in found:
        total += r["rows"]
        if total > most:
            break
        least = r["step"]
    return rows.where(step >= least if least is not None else F.lit(False)).toArrow()


_PARTS = ("row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, score double, "
          "word binary, gram long, times long")
_PARTS_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()),
                          ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("gram", pa.int64()), ("times", pa.int64())])


def _part(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _PARTS_ARROW], schema=_PARTS_ARROW)


class Scorer:
    """Scores of texts by the frequent grams and words; what is rare comes with its counts per text."""

    def __init__(self, depth: int, gram_table: pa.Table, word_table: pa.Table, tokens: int, kinds: int):
        order = np.argsort(gram_table["gram"].to_numpy())
        self.depth, self.keys, self.logs = depth, gram_table["gram"].to_numpy()[order], gram_table["lp"].to_numpy()[order]
        self.names, counts = word_table["word"].combine_chunks(), word_table["train"].to_numpy()
        self.worth = np.append(np.log10((counts + 0.1) / (tokens + 0.1 * (kinds + 1))), 0.0)  # the last place is that of rare words
        self.seen = np.append(counts > 0, False)

    def by_words(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words, base score, known words; and the rare words: text, word, times."""
        words, per_text = words_of(data)
        ends = np.arange(len(per_text))
        owner = np.append(np.repeat(ends, per_text), ends)
        words = pa.concat_arrays([words, pa.array([b""] * len(ends), pa.binary())])
        at = pc.fill_null(pc.index_in(words, value_set=self.names), len(self.names)).to_numpy()
        base = np.bincount(owner, self.worth[at], len(ends))
        known = np.bincount(owner, self.seen[at], len(ends)).astype(np.int64)
        rare = np.flatnonzero(at == len(self.names))
        table = pa.table({"text": owner[rare], "word": words.take(pa.array(rare))}).group_by(["text", "word"], use_threads=False).aggregate([([], "count_all")])
        return per_text + 1, base, known, table["text"].to_numpy(), table["word"].combine_chunks(), table["count_all"].to_numpy()

    def by_grams(self, data: np.ndarray, texts: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """Scores; and the rare grams: text, gram, times.  Grams are looked up in order, each once a piece."""
        total, rare = np.zeros(texts), []
        first = np.cumsum(data == END) - (data == END)  # the number of the text at each position
        for at, found in grams(data, self.depth):
            real = found >= 0
            both = np.sort(found[real] << TEXT_BITS | first[at:at + len(found)][real])
            gram, text = both >> TEXT_BITS, both & ((1 << TEXT_BITS) - 1)
            start = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            kinds = gram[start]
            near = np.searchsorted(self.keys, kinds)
            hit = np.zeros(len(kinds), bool)
            inside = near < len(self.keys)
            hit[inside] = self.keys[near[inside]] == kinds[inside]
            logs = np.zeros(len(kinds))
            logs[hit] = self.logs[near[hit]]
            sizes = np.diff(np.append(start, len(gram)))
            total += np.bincount(text, np.repeat(logs, sizes), texts)
            missing = both[np.repeat(~hit, sizes)]
            if len(missing):
                pair, times = np.unique(missing, return_counts=True)
                rare.append((pair & ((1 << TEXT_BITS) - 1), pair >> TEXT_BITS, times))
        return total, rare

    def __call__(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of rows (row, doc_id, held_out, text): one row each, and rows for what is rare."""
        number = rows.column(0).to_numpy()
        data = spelled(rows.column(3).cast(pa.binary()).to_pylist(), self.depth)
        tokens, base, known, text, word, times = self.by_words(data)
        score, rare = self.by_grams(data, len(number))
        sizes = np.diff(np.append(0, np.flatnonzero(data == END) + 1)) - self.depth
        yield _part(row=number, doc_id=rows.column(1), held_out=rows.column(2), n_tokens=tokens, n_bytes=sizes, known=known, base=base, score=score)
        if len(text):
            yield _part(row=number[text], word=word, times=times)
        for text, gram, times in rare:
            yield _part(row=number[text], gram=gram, times=times)


def scored_texts(docs: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """``Scorer`` over all rows; rows with an n_tokens are those of texts, the others hold what is rare."""
    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make()
        for batch in batches:
            for part in slices(batch, _TEXTS, _TEXT_BYTES):
                yield from scorer(part)
        del scorer
        release()
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(each, _PARTS)


def score_texts(docs: DataFrame, depth: int = DEPTH, folds: int = 10, keep_grams: int = KEEP_GRAMS, keep_words: int = KEEP_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every row.

    Learned from the rows whose crc32(doc_id as text) modulo ``folds`` is not 0, counted over all of them.  score is the
    logarithm (base 10) of the probability of the words in lower case, a space after each, and the end of the text;
    bits_per_byte is the same as code length.  base_score is the sum over words and the end, each of them a token, of
    log10((c + 0.1) / (N + 0.1 * (V + 1))) with c, N and V counted over training tokens; n_known counts tokens with c > 0.

    Null or empty text: the end alone.  A null doc_id trains.  Repeated rows train and are scored each time; other
    columns are not used.  Without training rows every decision has probability one half and c, N, V are 0.

    The ``keep_grams`` and ``keep_words`` most frequent grams and words travel with the tasks (at most about 25 MB); rare
    ones leave the task with their counts per row and are joined to the whole tables, so no table has to fit anywhere.
    A word that a third of the rows holds is frequent by rule and never joined.  Eager: tallies, levels and the scores
    of frequent parts are written to the shared folder; all but what the result reads are removed.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth is 1 to 5")
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out("doc_id", folds).alias("held_out"), whole_text().alias("text"))
    counted, path = store(tallies(docs, depth), "tallies")
    sums = [F.sum(c).alias(c) for c in ("n", "train")]
    gram_counts, grams_at = store(counted.where("gram IS NOT NULL").groupBy("gram").agg(*sums), "grams")
    word_counts, words_at = store(counted.where("word IS NOT NULL").groupBy("word").agg(*sums), "words")
    remove(spark, path)
    known = word_counts.where("train > 0").agg(F.sum("train"), F.count(F.lit(1))).first()
    tokens, kinds = int(known[0] or 0), int(known[1])
    table, used = model(gram_counts, depth)
    remove(spark, grams_at)
    often = frequent(table, keep_grams), frequent(word_counts, keep_words)
    parts, path = store(scored_texts(docs, lambda: Scorer(depth, *often, tokens, kinds)), "scores")
    used += [path, words_at]
    zero = F.lit(0).cast("long")
    rare = parts.where("word IS NOT NULL").select("row", "word", "times").join(word_counts, "word", "left")
    c = F.coalesce("train", zero)
    rare = rare.select("row", F.when(c > 0, F.col("times")).otherwise(zero).alias("known"),
                       (F.col("times") * F.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))).alias("base"), F.lit(0.0).alias("score"))
    deep = parts.where("gram IS NOT NULL").select("row", "gram", "times").join(table, "gram")
    deep = deep.select("row", zero.alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("lp")).alias("score"))
    more = rare.unionByName(deep).groupBy("row").agg(*[F.sum(x).alias(f"_{x}") for x in ("known", "base", "score")])
    whole = parts.where("n_tokens IS NOT NULL").select("row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "score").join(more, "row", "left")
    score = F.col("score") + F.coalesce("_score", F.lit(0.0))
    result, _ = store(whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", zero)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), score.alias("score"), "n_bytes",
        (-score / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte")), "lm_scores")
    remove(spark, *used)
    return result
