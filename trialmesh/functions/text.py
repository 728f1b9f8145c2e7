"""Column functions over names, urls, messages and metric values."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def slugify(col: str | Column, sep: str = "_", default: str = "architecture") -> Column:
    """Lower case, every run of other characters turned into ``sep``, ends trimmed."""
    joined = F.regexp_replace(F.lower(F.trim(_c(col))), "[^a-z0-9]+", sep)
    return F.coalesce(F.nullif(F.trim(joined, F.lit(sep)), F.lit("")), F.lit(default))


def normalize_name(col: str | Column) -> Column:
    """Case-folded letters and digits only."""
    return F.regexp_replace(F.lower(_c(col)), r"[^\p{L}\p{N}]", "")


def data_format(path: str | Column) -> Column:
    """``csv`` or ``pdf`` by suffix (query string ignored), else null."""
    bare = F.element_at(F.split(F.lower(_c(path)), "[?]"), 1)
    return F.when(bare.endswith(".csv"), "csv").when(bare.endswith(".pdf"), "pdf")


def data_category(fmt: str | Column) -> Column:
    return F.when(_c(fmt) == "csv", "structured").when(_c(fmt) == "pdf", "unstructured")


def mask_secret(col: str | Column) -> Column:
    """Null for empty, four bullets up to 8 characters, else first 4 + bullets + last 4."""
    value, dots = _c(col), F.lit("••••")
    return (F.when(value.isNull() | (value == ""), None).when(F.char_length(value) <= 8, dots)
            .otherwise(F.concat(F.substring(value, 1, 4), dots, F.right(value, F.lit(4)))))


# Fixed value: the shape of an accepted address.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def normalize_email(col: str | Column) -> Column:
    return F.lower(F.trim(_c(col)))


def is_email(col: str | Column) -> Column:
    return normalize_email(col).rlike(EMAIL_PATTERN)


def url_domain(url: str | Column) -> Column:
    """Authority part of a url with every ``www.`` removed; empty when there is none."""
    host = F.regexp_extract(_c(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.replace(host, F.lit("www."), F.lit(""))


def object_bucket(uri: str | Column) -> Column:
    u = _c(uri)
    plain = F.regexp_extract(u, r"^s3://([^/?#]*)", 1)
    hosted = F.regexp_extract(u, r"^https?://([^/?#]*?)\.s3\.", 1)
    return F.when(u.startswith("s3://"), plain).when(u.rlike(r"^https?://[^/?#]*\.s3\."), hosted)


def object_key(uri: str | Column) -> Column:
    u = _c(uri)
    path = F.regexp_replace(F.regexp_extract(u, r"^[a-z0-9]+://[^/?#]*([^?#]*)", 1), "^/+", "")
    return F.when(u.startswith("s3://") | u.rlike(r"^https?://[^/?#]*\.s3\."), path)


def normalize_hits(df: DataFrame, size: int = 500, title: str = "Untitled dataset") -> DataFrame:
    """Search hits: default title, first non-empty description cut to ``size``, domain; no url, no row."""
    text = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("text", "snippet", "summary")], F.lit(""))
    return df.where(F.col("url").isNotNull() & (F.col("url") != "")).select(
        F.coalesce("title", F.lit(title)).alias("title"), "url", F.substring(text, 1, size).alias("description"),
        url_domain("url").alias("domain"))


def _split_double(x: Column) -> tuple[Column, Column]:
    """A double as the exact sum of two halves whose products are exact."""
    wide = x * 134217729.0
    high = wide - (wide - x)
    return high, x - high


def _fixed(value: Column, digits: int, ties_up: bool = False) -> Column:
    """Fixed-point text of the exact binary value, ties to even or away from zero, all in generated code.

    The product with the power of ten is taken exactly, as a double and its error term, so a value just beside a
    midpoint is not mistaken for one.  What exceeds 15 digits or is not finite goes through the slower formatter.
    """
    power, size = float(10 ** digits), F.abs(value)
    high, low = _split_double(size)
    power_high, power_low = _split_double(F.lit(power))
    product = size * power
    error = ((high * power_high - product) + high * power_low + low * power_high) + low * power_low
    whole = F.floor(product).cast("double")
    over = (product - whole) - 0.5
    tie = F.lit(True) if ties_up else whole % 2 == 1
    up = (over > 0) | ((over == 0) & ((error > 0) | ((error == 0) & tie)))
    count = (whole + F.when(up, 1.0).otherwise(0.0)).try_cast("decimal(18,0)")
    text = (count * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})").cast("string")
    signed = F.concat(F.when(value < 0, "-").otherwise(""), text)
    return F.when(size * power < 1e15, signed).otherwise(F.format_string(f"%.{digits}f", value))


def format_metric(col: str | Column) -> Column:
    """Four decimals, or N/A."""
    return F.when(_c(col).isNull(), "N/A").otherwise(_fixed(_c(col).cast("double"), 4))


def display_value(col: str | Column) -> Column:
    """Two decimals from 100 on, else four with trailing zeros cut; N/A for null."""
    v = _c(col).cast("double")
    short = F.regexp_replace(_fixed(v, 4, ties_up=True), r"\.?0+$", "")
    return F.when(v.isNull(), "N/A").when(F.abs(v) >= 100, _fixed(v, 2, ties_up=True)).otherwise(short)


# Display names of the known metrics.
METRIC_LABELS = {
    "accuracy": "Accuracy", "balanced_accuracy": "Balanced Accuracy", "f1": "F1", "g_eval": "G-Eval", "mcc": "MCC",
    "precision": "Precision", "recall": "Recall", "retrieval_f1": "Retrieval F1",
    "retrieval_precision": "Retrieval Precision", "retrieval_recall": "Retrieval Recall", "roc_auc": "ROC AUC",
    "rouge": "ROUGE",
}


def title_case(col: str | Column) -> Column:
    """Every run of letters with a capital first letter, the others in lower case."""
    runs = F.split(F.regexp_replace(_c(col), r"(\p{L}+)", "\u0001$1"), "\u0001")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def metric_label(col: str | Column) -> Column:
    name = _c(col)
    known = F.create_map(*[F.lit(v) for pair in METRIC_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(known, name), title_case(F.replace(name, F.lit("_"), F.lit(" "))))


def split_sentences(col: str | Column, min_len: int = 15) -> Column:
    """Sentences longer than ``min_len``, trimmed, each with one closing period."""
    space = " \t\r\n"
    parts = F.split(_c(col), r"\.\s+")
    trimmed = F.transform(parts, lambda s: F.trim(s, F.lit(space)))
    kept = F.filter(trimmed, lambda s: F.char_length(s) > min_len)
    return F.transform(kept, lambda s: F.concat(F.regexp_replace(s, r"\.$", ""), F.lit(".")))


def text_tokens(df: DataFrame, col: str) -> DataFrame:
    """One row per word, each but the last with the space that follows it."""
    words = F.split(F.col(col), " ")
    spaced = F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.concat(w, F.lit(" "))).otherwise(w))
    return df.select(*[c for c in df.columns if c != col], F.posexplode(spaced).alias("position", "token"))


def roi_signal(col: str | Column) -> Column:
    """First percentage, else first hour range, else Estimated; a dash for no text."""
    text = _c(col)
    pct = F.regexp_extract(text, r"([0-9]+)\s*%", 1)
    hours = F.regexp_extract(text, r"([0-9.]+\s*[–-]\s*[0-9.]+)\s*h", 1)
    return (F.when(text.isNull() | (text == ""), "—").when(pct != "", F.concat(pct, F.lit("%")))
            .when(hours != "", F.concat(hours, F.lit("h"))).otherwise("Estimated"))


def improvement_pct(before: str | Column, after: str | Column) -> Column:
    """Percent drop after clamping both values to 0…100; 0 when there is nothing to drop from."""
    b, a = (F.least(F.lit(100.0), F.greatest(F.lit(0.0), _c(c).cast("double"))) for c in (before, after))
    return F.when(b > 0, F.floor((b - a) / b * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint")


def words(col: str | Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.filter(F.split(_c(col), r"[ \t\r\n\f]+"), lambda w: w != "")


def terms(col: str | Column) -> Column:
    """Lower-cased runs of letters and digits: the lexical index terms."""
    return F.filter(F.split(F.lower(_c(col)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
