"""Homomorphic multiset hash of a text's paragraphs, in DataFrame expressions.

A paragraph (a line, cut further after sentence ends, and where it stays long behind words picked by their hash) is
hashed to a wide vector of LANES small numbers; a text's fingerprint is the lane-wise sum modulo 2**32, with the
number of paragraphs in front. Sums do not depend on order, so texts with the same paragraphs agree, and a paragraph enters
or leaves a stored fingerprint by one addition or subtraction (`combined`, `removed`). Lane values are 8 bits wide
and the sums 32, so up to 2**24 paragraphs nothing wraps and centred lanes keep the geometry: the cosine of two
fingerprints estimates the share of common paragraphs, with a deviation of 1/8 (the root of one in LANES).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import saved, tasks, text_or_empty

#: A paragraph has HASHES 64-bit hashes, whose bytes are its lane values.
HASHES = 8
LANES = 8 * HASHES
#: In a stored fingerprint two lanes share one 64-bit sum, 32 bits apart.
SUMS = LANES // 2
LOW = 0xFFFFFFFF
MEAN = 127.5
#: While BLOCK paragraphs are added up four lanes share a number, 16 bits apart: 128 bytes stay below 2**15.
BLOCK = 128
FOUR_LANES, TWO_LANES = 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF
#: Ranges of doc_id for each shuffle partition; several even out how they fall.
RANGES = 4
#: Line ends, and sentence marks: those of most scripts before white space, the full-width ones anywhere.
BREAK = r"\n+|(?<=[.!?…।؟۔])\s+|(?<=[。！？｡])"
#: Paragraphs over LONG code points are cut behind one in PICKED words, words over LONG behind one in PICKED letters.
LONG, PICKED = 48, 4


def _cut(units: Column, glue: str) -> Column:
    """The units in one text again, with a line end behind those that their own hash picks.

    Cuts so move with the content, and an edit changes the pieces around it only. None falls between two equal
    units, so a word that is said over and over makes one piece and not many equal ones.
    """
    def ended(unit: Column, following: Column) -> Column:
        picked = (F.pmod(F.xxhash64(unit), F.lit(PICKED)) == 0) & ~unit.eqNullSafe(following)
        return F.when(picked, F.concat(unit, F.lit("\n"))).otherwise(unit)

    # An array of one, so that the units are found once.
    behind = F.transform(F.array(units), lambda u: F.zip_with(u, F.slice(u, F.lit(2), F.size(u)), ended))
    return F.array_join(F.flatten(behind), glue)


def _shorter(paragraph: Column) -> Column:
    """The paragraph as it is, or a long one in pieces of a few words (or letters, where there are no words)."""
    words = F.transform(F.split(paragraph, r"\s+"), lambda w: F.when(F.length(w) > LONG, _cut(F.split(w, ""), "")).otherwise(w))
    return F.when(F.length(paragraph) > LONG, F.split(_cut(words, " "), "\n")).otherwise(F.array(paragraph))


def vector(text: Column) -> Column:
    """Paragraph count, then SUMS sums of two lanes each, as array<bigint>. Blank paragraphs do not count."""
    pieces = F.flatten(F.transform(F.split(text, BREAK, -1), lambda p: _shorter(F.trim(p))))
    paragraphs = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")

    def lanes(paragraph: Column) -> Column:
        values = [F.xxhash64(paragraph, F.lit(j)) for j in range(1, HASHES + 1)]
        return F.array(F.lit(1).cast("long"), *[F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(FOUR_LANES)) for h in values for shift in (0, 8)])

    def added(block: Column) -> Column:
        zeros = F.array_repeat(F.lit(0).cast("long"), 2 * HASHES + 1)
        return F.aggregate(block, zeros, lambda total, p: F.zip_with(total, lanes(p), lambda a, b: a + b))

    def widened(sums: Column) -> Column:
        pairs = F.transform(F.slice(sums, 2, 2 * HASHES), lambda x: F.array(
            x.bitwiseAND(F.lit(TWO_LANES)), F.shiftrightunsigned(x, 16).bitwiseAND(F.lit(TWO_LANES))))
        return F.concat(F.slice(sums, 1, 1), F.flatten(pairs))

    def walk(all_: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))
        start = F.array_repeat(F.lit(0).cast("long"), SUMS + 1)
        return F.aggregate(blocks, start, lambda total, block: combined(total, widened(added(block))))

    return F.get(F.transform(F.array(paragraphs), walk), F.lit(0))


def _added(a: Column, b: Column) -> Column:
    """Two lanes at once, each modulo 2**32; the high lane is summed in its own 32 bits."""
    low = (a.bitwiseAND(F.lit(LOW)) + b.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
    high = (F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32)).bitwiseAND(F.lit(LOW))
    return F.shiftleft(high, 32).bitwiseOR(low)


def combined(a: Column, b: Column) -> Column:
    """Fingerprint vector of the union of two multisets."""
    return F.zip_with(a, b, _added)


def removed(a: Column, b: Column) -> Column:
    """Fingerprint vector of `a` without the paragraphs of `b`."""
    def negative(x: Column) -> Column:
        low = (F.lit(LOW + 1) - x.bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW))
        high = (F.lit(LOW + 1) - F.shiftrightunsigned(x, 32)).bitwiseAND(F.lit(LOW))
        return F.shiftleft(high, 32).bitwiseOR(low)

    return combined(a, F.transform(b, negative))


def as_text(vector: Column) -> Column:
    """16 hex digits a sum, the count first."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _centred(v: Column) -> Column:
    """Lane sums less what as many random lanes sum to on average."""
    count = F.get(v, F.lit(0)).cast("double")
    sums = F.slice(v, 2, SUMS)
    return F.concat(
        F.transform(sums, lambda x: x.bitwiseAND(F.lit(LOW)).cast("double") - MEAN * count),
        F.transform(sums, lambda x: F.shiftrightunsigned(x, 32).cast("double") - MEAN * count),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def with_likeness(frame: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """`frame` with column `name`: 1 for equal vectors, else their cosine within 0 and 1; 0 against an empty one."""
    centred = frame.withColumn("_a", _centred(F.col(a))).withColumn("_b", _centred(F.col(b)))
    summed = centred.withColumn("_ab", _dot(F.col("_a"), F.col("_b"))).withColumn(
        "_n", F.sqrt(_dot(F.col("_a"), F.col("_a")) * _dot(F.col("_b"), F.col("_b"))))
    cosine = F.when(F.col("_n") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ab") / F.col("_n")))).otherwise(0.0)
    return summed.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).otherwise(cosine)).drop("_a", "_b", "_ab", "_n")


def range_bucket(frame: DataFrame, key: str, n: int) -> Column:
    """Number of the range of `key` a row falls in, of about n ranges with as many rows each; null comes first.

    The borders are quantiles of all rows from one mergeable sketch of a few kB. They are kept in about
    sqrt(n) runs, so that a row is compared with 2 * sqrt(n) of them at most.
    """
    if n < 2:
        return F.lit(0)
    shares = [i / n for i in range(1, n)]
    found = frame.agg(F.percentile_approx(key, shares, max(1000, 10 * n)).alias("at")).first()["at"]
    borders = sorted(set(found or []))
    width = max(1, int(len(borders) ** 0.5))
    runs = [borders[i:i + width] for i in range(0, len(borders), width)]
    if not runs:
        return F.lit(0)
    value = F.col(key)
    heads = F.array(*[F.lit(run[0]) for run in runs])
    nested = F.array(*[F.array(*[F.lit(x) for x in run]) for run in runs])
    run = F.size(F.filter(heads, lambda b: b <= value)) - 1
    inside = F.size(F.filter(F.get(nested, run), lambda b: b <= value))
    return F.when(value.isNull(), 0).when(run < 0, 0).otherwise(run * width + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with `v`, the text's vector, and next_text and next_v of the next row in descending doc_id.

    After the last row comes the first. Rows of equal doc_id follow by text, rows without doc_id come last.
    The rows are dealt once into ranges of doc_id with as many rows each; a window in a range looks one row
    ahead, and only the first row of every range travels to the range before it.
    """
    here = docs.withColumn("_range", range_bucket(docs, "doc_id", RANGES * tasks(docs.sparkSession)))
    # The first row of each range: the largest doc_id, the smallest text among its rows.
    key = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id"))
    # Written, so that Spark knows how few rows these are when it plans the join with the texts.
    top = saved(here.groupBy(F.col("_range").alias("_top")).agg(F.max(key).alias("_key")))
    firsts = (
        here.join(top, (F.col("_range") == F.col("_top")) & key.eqNullSafe(F.col("_key")))
        .groupBy("_range").agg(F.min("text").alias("_first"))
    )
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select(
        F.col("_range").alias("_before"), F.coalesce(F.lead("_first").over(down), F.first("_first").over(whole)).alias("_over"),
    ).withColumn("_over_v", vector(F.col("_over")))
    ahead = Window.partitionBy("_range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    led = here.withColumn("v", vector(F.col("text"))).select(
        "doc_id", "text", "v", "_range", F.lead("text").over(ahead).alias("_text"), F.lead("v").over(ahead).alias("_v"))
    return led.join(follow, F.col("_range") == F.col("_before")).select(
        "doc_id", "text", "v", F.coalesce("_text", "_over").alias("next_text"), F.coalesce("_v", "_over_v").alias("next_v"))


def compared(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: fingerprints of its text and of its edited text, and their likeness.

    The edited text: the last third of the code points (rounded down) replaced by the first as many, or all,
    of the next document's. Null text counts as empty; an empty text has the zero fingerprint, is like an
    equal one (1) and unlike any other (0). A single document is its own next one. Rows that repeat a doc_id
    follow each other by text; an empty table gives no rows.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    near = with_next(base)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    hashed = near.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "v", "next_v").select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "v", vector(F.col("edited")).alias("e"), "next_v")
    likened = with_likeness(with_likeness(hashed, "near_edited", "v", "e"), "near_next", "v", "next_v")
    return likened.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"),
                          as_text(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")
