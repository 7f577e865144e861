"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every text is lower-cased, runs of anything but letters become one space, and its n-grams of ORDERS code
points, hashed into BUCKETS, are counted with numpy. Training counts come from all training rows: each task
adds up its rows per language and Spark sums the (language, bucket) counts of the tasks. The matrix of
smoothed log probabilities, one row a language, is bounded by BUCKETS and the number of languages; it is
broadcast. Documents are scored many at a time: their buckets and counts stand in one sparse matrix, whose rows
meet the log probabilities in one gather and one segmented sum.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlake.llm.common import unused

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNKNOWN = "und"
#: N-grams of so many starting places are hashed at a time, so that a long text needs little more than itself.
SECTION = 1 << 18
#: Entries of the sparse matrix scored at a time.
GROUP = 1 << 21
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def bucket_sections(text: str, orders=ORDERS, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text with repeats, a section of starting places at a time.

    The text is folded whole and n-grams reach over the end of their section, so sections change no count.
    """
    folded = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    points = np.frombuffer(folded.encode("utf-32-le"), dtype=np.uint32)
    for begin in range(0, len(points), SECTION):
        for n in orders:
            end = min(begin + SECTION, len(points) - n + 1)
            if end <= begin:
                continue
            mixed = np.full(end - begin, n, dtype=np.uint64)
            for i in range(n):
                mixed = (mixed ^ points[begin + i:end + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
            yield (mixed % np.uint64(buckets)).astype(np.int64)


def bucket_ids(text: str, orders=ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed n-grams of a text, with repeats."""
    return np.concatenate(list(bucket_sections(text, orders, buckets)))


def sparse_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket of a whole text."""
    total = np.zeros(buckets, dtype=np.int64)
    for ids in bucket_sections(text, buckets=buckets):
        total += np.bincount(ids, minlength=buckets)
    return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_probs: np.ndarray  # languages x buckets
    log_priors: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        """Most probable language and its posterior; the first in name order wins a tie."""
        return self.score_all([text])[0]

    def score_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """`score` of each text, in groups of about GROUP entries of the sparse matrix."""
        found: list[tuple[str, float]] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        places: list[int] = []
        entries = 0
        for text in texts:
            found.append((UNKNOWN, 0.0))
            if text is None or not self.languages or not _LETTER.search(text):
                continue
            counts = sparse_counts(text, self.log_probs.shape[1])
            at = np.flatnonzero(counts)
            rows.append((at, counts[at]))
            places.append(len(found) - 1)
            entries += len(at)
            if entries >= GROUP:
                self._fill(found, places, rows)
                rows, places, entries = [], [], 0
        if rows:
            self._fill(found, places, rows)
        return found

    def _fill(self, found: list, places: list[int], rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Scores of the rows of a sparse matrix: (buckets, counts) each, never empty."""
        buckets, counts = (np.concatenate(part) for part in zip(*rows))
        starts = np.cumsum([0, *(len(at) for at, _ in rows[:-1])])
        total = np.stack([np.add.reduceat(probs[buckets] * counts, starts) for probs in self.log_probs]) + self.log_priors[:, None]
        best = np.argmax(total, axis=0)
        peak = total[best, np.arange(len(rows))]
        posterior = 1.0 / np.exp(total - peak).sum(axis=0)
        for place, language, value in zip(places, best.tolist(), posterior.tolist()):
            found[place] = (self.languages[language], value)


def train(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """Model of all rows of `docs` (text, lang) with a language; null texts add nothing but their prior.

    Only language-by-bucket sums come to the driver. Without rows the model knows no language.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                name, text = lang.as_py(), text.as_py()
                if name not in sums:
                    sums[name], seen[name] = np.zeros(buckets, dtype=np.int64), 0
                seen[name] += 1
                if text is not None:
                    sums[name] += sparse_counts(text, buckets)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()),
                 pa.array(np.append(total[at], seen[name]), pa.int64())], names=["lang", "bucket", "n"])

    parts = docs.where(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(rows["lang"].to_pylist(), dtype=object)
    languages = tuple(sorted(set(names.tolist())))
    place = {name: i for i, name in enumerate(languages)}
    table = np.zeros((len(languages), buckets + 1), dtype=np.float64)  # the last column is bucket -1: documents
    if languages:
        table[[place[x] for x in names], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    smooth = table[:, :buckets] + SMOOTHING
    log_probs = np.log(smooth) - np.log(smooth.sum(axis=1, keepdims=True))
    log_priors = np.log(table[:, buckets]) - np.log(max(1.0, table[:, buckets].sum()))
    return Model(languages, log_probs, log_priors)


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a row without id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def predicted(docs: DataFrame, model: Model, lang: str = "lang_pred", posterior: str = "score") -> DataFrame:
    """`docs` with columns `lang` and `posterior`, from the text alone; `und` and 0 for a text that is null or
    has no letter.

    A row's score is a sum over its own buckets, so repeated rows agree; an empty table gives no rows. Columns of
    those names, in any case, are replaced, all others kept.
    """
    kept = docs.select(*[c for c in docs.columns if c.lower() not in (lang.lower(), posterior.lower())])
    layout = T.StructType([*kept.schema.fields, T.StructField(lang, T.StringType()), T.StructField(posterior, T.DoubleType())])
    at = kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.score_all(text.as_py() for text in batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, lang, posterior])

    return kept.mapInArrow(score, layout)


def identified(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score. Learns from the rows that are not held out."""
    model = train(docs.where(~held_out()))
    flagged = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predicted(flagged, model).drop("text")


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language; rejected are texts that are null or have no letter.

    The model names the language of every other text: where `lang` is null its prediction is filled in, a given
    label stays. It rejects none, however low the posterior. Where no row that is not held out has a label it knows
    no language, and the letters alone decide. Empty texts go, repeated rows share their fate, an empty table gives
    no rows.
    """
    model = train(docs.where(~held_out()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, posterior = unused(docs, "_lang"), unused(docs, "_posterior")
    scored = predicted(docs, model, lang, posterior)
    return scored.where(F.col(lang) != UNKNOWN).withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)
