"""Audit of how filters interact, by Hart and Mas-Colell's potential of the removal game.

Each document gets one bit for every filter that it fails. All that an order of filters does to a part of the
corpus follows from how many documents have each combination of bits, so the corpus is reduced to at most
2**k counts a part. In the removal game a coalition of filters is worth the documents that it removes. The
potential of a coalition is its worth plus the potentials of the coalitions that lack one member, divided by
its size; a filter's Shapley value is the drop of the grand coalition's potential when the filter leaves.
Differences of coalition worths give each step of each order.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import permutations
from math import factorial, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm.common import text_or_empty

FILTERS = "ABCDE"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
GAMES = ("n", "good", "toxic")


def text_rules(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: too short, too repetitive, shouting, odd marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(doc_id, digest, part, bits, good, toxic): one narrow row per document; texts are read once and stay behind.

    `bits` has bit i where the i-th rule fails. Labels that repeat an id count as good or toxic if one of them says
    so; a document without label, or without id, is neither.
    """
    bits = sum((F.when(F.coalesce(fails, F.lit(False)), 1 << i).otherwise(0) for i, fails in enumerate(rules.values())), F.lit(0))
    rows = docs.select(
        "doc_id", F.unhex(F.sha2(F.encode(text_or_empty(), "utf-8"), 256)).alias("digest"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"), bits.cast("int").alias("bits"))
    says = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return rows.join(says, "doc_id", "left").withColumns({name: F.coalesce(name, no) for name in ("good", "toxic")})


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(part, bits, good, toxic, n): counts of documents, with `bit` set on copies of a text with a smaller id.

    Copies collapse in partial aggregates: per text and part there are at most four rows before the least id of
    the text is sought, so no task meets the copies of a text. Rows that repeat an id and a text are equal, none
    is smaller; rows without id are never copies.
    """
    same = ["digest", "part", "bits", "good", "toxic"]
    each = rows.groupBy("doc_id", *same).agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy(*same).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"),
        F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), F.col("doc_id")).alias("at_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"),
    )
    least = F.min("least").over(Window.partitionBy("digest"))
    first = F.coalesce(F.when(F.col("least") == F.col("overall"), F.col("at_least")), F.lit(0)) + F.col("without")
    split = groups.withColumn("overall", least).select(
        "part", "bits", "good", "toxic",
        F.explode(F.array(
            F.struct(F.lit(0).alias("more"), first.alias("n")),
            F.struct(F.lit(bit).alias("more"), (F.col("n") - first).alias("n")))).alias("half"))
    return split.select("part", F.col("bits").bitwiseOR(F.col("half.more")).alias("bits"), "good", "toxic", F.col("half.n").alias("n"))


def profiles(cells: DataFrame) -> DataFrame:
    """(part, cells): for each part its combinations of bits with their counts of all, good and toxic documents."""
    found = cells.groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"),
    ).where("n > 0")
    return found.groupBy("part").agg(F.collect_list(F.struct("bits", *GAMES)).alias("cells"))


def worths(counts: np.ndarray) -> np.ndarray:
    """What each coalition removes, from the count of each combination of bits (one game a row)."""
    masks = np.arange(counts.shape[1])
    return counts @ ((masks[:, None] & masks[None, :]) != 0).astype(np.int64)


def potentials(worth: Sequence[int], k: int) -> list[int]:
    """lcm(1..k) times the potential of each coalition, which makes all of them whole numbers."""
    unit, found = lcm(*range(1, k + 1)), [0]
    for coalition in range(1, 1 << k):
        members = [i for i in range(k) if coalition >> i & 1]
        found.append((unit * worth[coalition] + sum(found[coalition ^ 1 << i] for i in members)) // len(members))
    return found


def shapley(worth: Sequence[int], k: int) -> list[int]:
    """Each filter's removals summed over all k! orders: k! times its Shapley value."""
    found, grand = potentials(worth, k), (1 << k) - 1
    scale = factorial(k) // lcm(*range(1, k + 1))
    return [scale * (found[grand] - found[grand ^ 1 << i]) for i in range(k)]


def steps(part: str, counts: np.ndarray, filters: str) -> Iterator[tuple]:
    """A row for each order of the filters and each step, from one part's counts (3 games x 2**k)."""
    k, worth = len(filters), worths(counts).tolist()
    grand, total = (1 << k) - 1, int(counts[0].sum())
    values = shapley(worth[0], k)
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = [game[after] - game[before] for game in worth]
            yield (
                part, "".join(filters[j] for j in order), step, total - worth[0][after], gone[0],
                worth[0][1 << i] - gone[0], worth[0][grand] - worth[0][grand ^ 1 << i], gone[1], gone[2], values[i])
            before = after


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps for each part of `cells` (part, bits, good, toxic, n); k! * k rows a part.

    A part without documents has no rows; an empty table gives none.
    """
    layout = pa.schema([
        (name, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind])
        for name, kind in (column.split() for column in STEPS.split(", "))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.zeros((len(GAMES), 1 << len(filters)), dtype=np.int64)
                for cell in row["cells"]:
                    counts[:, cell["bits"]] = [cell[game] for game in GAMES]
                columns = zip(*steps(row["part"], counts, filters))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, layout.types)], schema=layout)

    return profiles(cells).mapInArrow(work, STEPS)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five text filters over whole `docs`, a row per part (each lang, null as empty), order and step.

    Null texts count as empty. kept: documents after the step; removed: by it; redundant: they fail its filter but
    an earlier one removed them; unique_fails: they fail this filter alone; good_lost, toxic_lost: removed here with
    such a label; shapley: removed by the step's filter, summed over all orders.
    """
    rules = text_rules(text_or_empty())
    return interactions(with_copies(judged(docs, labels, rules), 1 << len(rules)))
