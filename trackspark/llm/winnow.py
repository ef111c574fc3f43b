"""Document fingerprints by winnowing, in DataFrame functions only.

Hashes of ``gram`` consecutive words are rolled over a text by doubling (hashes of 2, then 4, then 5
words); in every window of ``window`` hashes the smallest is chosen, of equal ones the rightmost, and
chosen hashes keep their positions. Any passage of ``window + gram - 1`` words that two texts share
gives both at least one common hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored
from .quality import words_of

GRAM, WINDOW = 5, 8
#: Positions are below this; a packed value is hash * 2**32 + (POSITIONS - position), so that the minimum is the rightmost.
POSITIONS = 2**32 - 1
#: Documents in one range of ids, within which the next document is found.
RANGE_ROWS = 1024
#: Quantiles of the ids that bound ranges; between two of them ranges have equal widths.
MOST_CUTS = 1024


def _shifted(name: str, by: int, f) -> Column:
    """Combine each element with the one ``by`` places on; the last ``by`` have no partner (null)."""
    return F.zip_with(name, F.slice(name, by + 1, F.greatest(F.size(name), F.lit(1))), f)


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: array of chosen packed values of ``text_col`` (null text: empty), in order of position.

    A text of fewer words than a gram has one hash, of all its words; one without words has none. A text
    with fewer grams than a window has one choice. The whole text is read, whatever its length.
    """
    rest = df.columns
    df = df.select(*rest, F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h1"))
    df = df.select(*rest, F.size("h1").alias("_n"), F.col("h1"), _shifted("h1", 1, lambda a, b: F.xxhash64(a, b)).alias("h2"))
    df = df.select(*rest, "_n", F.transform("h1", lambda x: x).alias("h1"), _shifted("h2", 2, lambda a, b: F.xxhash64(a, b)).alias("h4"))
    h5 = F.zip_with("h4", F.slice("h1", 5, F.greatest(F.size("h1"), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    df = df.select(*rest, "_n", h5.alias("h"))
    # a short text's first hash already covers all its words
    df = df.select(*rest, F.slice("h", 1, F.greatest(F.col("_n") - (GRAM - 1), F.least("_n", F.lit(1)))).alias("h"))
    packed = F.transform("h", lambda h, i: F.shiftleft(h.bitwiseAND(0x7FFFFFFF), 32) + (F.lit(POSITIONS) - i))
    df = df.select(*rest, packed.alias("m"))
    step = 1  # least of 2, 4 and 8 in a row; past the end there is nothing smaller
    low = lambda a, b: F.least(a, b)  # noqa: E731  least() skips nulls
    df = df.select(*rest, F.size("m").alias("_n"), _shifted("m", 1, low).alias("m"))
    while (step := step * 2) < WINDOW:
        df = df.select(*rest, "_n", _shifted("m", step, low).alias("m"))
    chosen = F.slice("m", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.least("_n", F.lit(1))))
    return df.select(*rest, F.array_distinct(chosen).alias(out))


def fingerprint_text(packed: Column) -> Column:
    """Chosen hashes with their positions as text: ``hash:position`` in hex and decimal, by commas."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 32))), F.lit(":"), (F.lit(POSITIONS) - x.bitwiseAND(0xFFFFFFFF)).cast("string"))), ",")


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftrightunsigned(x, 32)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) with a sort bucket; the first row of each bucket also ends the bucket before, as a guest.

    Buckets are ranges of ids of about as many rows each, so that the next row is found inside a bucket. Of equal ids the text
    decides; null ids come first. The last bucket's guest is the first row of all.
    """
    rows = max(1, docs.count())
    parts = max(1, min(MOST_CUTS, rows // RANGE_ROWS))
    low, high, inner = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()
    cuts = sorted({low or 0, *((inner or []) if parts > 1 else [])})
    each = -(-rows // (RANGE_ROWS * parts))  # ranges of equal width between two cuts; one while the cuts suffice
    # in doubles: ids may lie at both ends of the longs; rounding keeps the order
    widths = [float((b - a) // each + 1) for a, b in zip(cuts, [*cuts[1:], (high or 0) + 1], strict=True)]
    at = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("doc_id")))
    start = F.element_at(F.lit([float(c) for c in cuts]), at)
    offset = F.floor((F.col("doc_id").cast("double") - start) / F.element_at(F.lit(widths), at))
    offset = F.least(F.lit(each), F.greatest(F.lit(0), offset))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(at * (each + 1) + offset).cast("long")
    df = docs.select("doc_id", "text", bucket.alias("bucket"))
    # one row per bucket: a small table, about a thousandth of the rows
    starts = df.select("bucket", "doc_id").distinct().groupBy("bucket").agg(F.min("doc_id").alias("start"))
    order = Window.orderBy("bucket")
    starts = starts.select("start", F.lag("bucket").over(order).alias("before"), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    starts = starts.select("start", F.coalesce("before", "last").alias("to"), F.col("before").isNull().alias("wraps"))
    starts = stored(starts, "starts")  # its size is known then: texts are not exchanged for it while it is small
    first = df.join(starts, F.col("doc_id").eqNullSafe(F.col("start"))).groupBy("to", "wraps", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    guests = first.select("doc_id", "text", F.col("to").alias("bucket"), F.when(F.col("wraps"), 2).otherwise(1).alias("guest"))
    return df.withColumn("guest", F.lit(0)).unionByName(guests)


def winnow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text; one row per row of ``docs``.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next
    text by ascending id; the first follows the last. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. Null texts count as empty, with an empty fingerprint; two
    empty fingerprints have likeness 1. Repeated rows follow one another; an only row follows itself.
    """
    df = with_next(docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")))
    df = with_fingerprint(df.repartition("bucket"), "text", "fp")
    inside = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    df = df.withColumn("next_text", F.lead("text").over(inside)).withColumn("next_fp", F.lead("fp").over(inside)).where("guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    df = df.select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", hashes(F.col("fp")).alias("own"), hashes(F.col("next_fp")).alias("following"), edited.alias("edited"))
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited", fingerprint_text(F.col("fp")).alias("fingerprint"), "own", likeness("own", "following").alias("near_next"))
    df = with_fingerprint(df, "edited", "efp").drop("edited")
    df = df.withColumn("changed", hashes(F.col("efp")))
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", fingerprint_text(F.col("efp")).alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), "near_next")
