"""Spelling variants by permuterm rotations.

Every word gets a terminator and is rotated in all ways, so that each place of the word comes to the end of one
rotation. Sorted, the rotations of words that differ in that one place stand together under the prefix that
skips it: words with one code point replaced there, and the word without it, whose own rotation is the prefix.
A group has at most one word for each letter and one for none, so it is bounded by the alphabet; from it each
member takes how many others there are and the best of them. Pairs are never written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import saved

#: Letters of a word, as a class of a pattern; both Latin blocks, like the contract's.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
TERMINATOR = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, run): all maximal letter runs of at least `least` code points of whole texts, A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    return found.select("doc_id", lower.alias("run"))


def without_place(word: Column, at: Column) -> Column:
    """The word without its code point at `at`, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def thinned(found: DataFrame, every: int) -> Column:
    """The run, short of one code point where `every` divides the checksum of `<doc_id>:<run>` (no id: empty)."""
    run = found["run"]
    checksum = F.crc32(F.encode(F.concat(F.coalesce(found["doc_id"].cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = F.pmod(checksum, F.length(run)).cast("int")
    return F.when(checksum % every == 0, without_place(run, at)).otherwise(run)


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n): distinct words of whole texts with so many code points and occurrences, typos planted by checksum.

    Null text has no words. Runs too short to become a word are left in the text; counts are summed in each task
    first, so a frequent word travels once a task.
    """
    found = runs(docs, least_length)
    return (
        found.select(thinned(found, every).alias("word")).where(F.length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    )


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, edited, first, word, n): the rotations of each word, filed by what they share with near words.

    edited: the rotation without its last code point, one row for each place of the word. Otherwise the whole
    rotation, one row for each place between, before and behind its letters. `first` marks an edited place whose
    letter differs from the one before: of a run of equal letters only one place counts as the inserted one.
    """
    word, at = F.col("word"), F.col("at")
    ahead, behind = F.substring(word, F.lit(1), at), F.substring(word, at + 1, F.length(word))
    turned = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("word"))))
    skipped = F.concat(F.substring(word, at + 2, F.length(word)), F.lit(TERMINATOR), ahead)
    whole = F.concat(behind, F.lit(TERMINATOR), ahead)
    letter, before = F.substring(word, at + 1, F.lit(1)), F.when(at > 0, F.substring(word, at, F.lit(1)))
    own = F.struct(whole.alias("prefix"), F.lit(False).alias("edited"), F.lit(False).alias("first"))
    cut = F.struct(skipped.alias("prefix"), F.lit(True).alias("edited"), (before.isNull() | (letter != before)).alias("first"))
    filed = F.when(at < F.length(word), F.array(own, cut)).otherwise(F.array(own))  # no letter stands behind the last
    return turned.select("word", "n", F.explode(filed).alias("filed")).select("filed.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, near, near_n): how many near words each word has, and the most frequent of them.

    Near words differ by one inserted, deleted or replaced code point. Ties take the word that is first in
    code-point order; a word without near words has 0 and nulls. The rows of a prefix, at most one for each
    letter and one more, are sorted by prefix and scanned once.
    """
    group = Window.partitionBy("prefix")
    entry = F.struct((-F.col("n")).alias("down"), F.col("word").alias("near"))
    edited = F.col("edited")
    scanned = rotations(words).withColumns({
        "_edits": F.sum(edited.cast("long")).over(group),
        "_inserts": F.sum((edited & F.col("first")).cast("long")).over(group),
        "_whole": F.max(F.when(~edited, entry)).over(group),
        "_best": F.min(F.when(edited, entry)).over(group),
        "_all": F.count(F.lit(1)).over(group),
    }).where("_all > 1")
    second = scanned.withColumn("_next", F.min(F.when(edited & (F.col("_best.near") != F.col("word")), entry)).over(group))
    other = F.when(F.col("_best.near") == F.col("word"), F.col("_next")).otherwise(F.col("_best"))
    shorter = F.col("first") & F.col("_whole").isNotNull()
    emitted = second.select(
        "word", "n",
        F.when(edited, F.col("_edits") - 1 + shorter.cast("long")).otherwise(F.col("_inserts")).alias("near"),
        F.when(edited, F.least(other, F.col("_whole"))).otherwise(F.col("_best")).alias("best"))
    alone = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast(emitted.schema["best"].dataType).alias("best"))
    return emitted.unionByName(alone).groupBy("word", "n").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")).select(
        "word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.down")).alias("near_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """`formed` (word, form, ...) with `root`: the last word reached by following forms; the word itself without one.

    Each round doubles how far every pointer reaches. Along a chain counts at least double, so a chain has no
    circle and at most 63 links: seven rounds at the most, each written to the shared folder.
    """
    reach = saved(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while reach.where("moved").limit(1).count():
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("_beyond"))
        reach = saved(reach.join(further, "root", "left").select(
            "word", F.coalesce("_beyond", "root").alias("root"), F.col("_beyond").isNotNull().alias("moved")))
    return formed.join(reach.drop("moved"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def grouped(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, factor: int = 2) -> DataFrame:
    """One row per word of whole `docs`: word, n, form, form_n, root, n_near.

    A word's form is its near word of largest n, if that is at least `factor` times the word's own; null otherwise.
    Null and empty texts have no words, rows that repeat are counted each, an empty table gives no rows.
    """
    words = saved(vocabulary(docs, least_length, least_count, every))
    enough = F.col("near_n") >= factor * F.col("n")
    formed = saved(near_words(words).select(
        "word", F.when(enough, F.col("near")).alias("form"), "n", "n_near", F.when(enough, F.col("near_n")).alias("form_n")))
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
