"""Best-fit packing of documents into sequences by patterns fitted with non-negative least squares.

All documents become pieces of at most `limit` tokens; only their length histogram, `limit` numbers whatever
the corpus, comes to the driver. There the patterns of up to three lengths that fill a sequence exactly are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded, and what
they leave is packed best-fit, longest first, on the histogram. The plan is again bounded by `limit`:
runs of equal sequences. Pieces take their place in it by their number among the pieces of their length,
which each task counts for itself and a small table of (task, length) counts offsets.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.llm import token_ids
from voltlake.llm.common import saved

LIMIT = 2048
END = 0


def patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All patterns of one to three of `lengths` that sum to `limit`: rows of places in `lengths`, -1 for none."""
    place = np.full(limit + 1, -1, dtype=np.int64)
    place[lengths] = np.arange(len(lengths))
    found = [np.array([[place[limit], -1, -1]])] if place[limit] >= 0 else []
    for small in [0, *lengths.tolist()]:
        middle = np.arange(max(small, 1), (limit - small) // 2 + 1)
        large = limit - small - middle
        good = (place[middle] >= 0) & (large >= middle) & (place[large] >= 0)
        third = np.full(int(good.sum()), place[small] if small else -1)
        found.append(np.stack([place[large[good]], place[middle[good]], third], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def repeat_counts(rows: np.ndarray, counts: np.ndarray, rounds: int = 16, block: int = 384) -> np.ndarray:
    """Non-negative x that brings the patterns' lengths near `counts` in the least-squares sense.

    Active set by blocks: the columns of steepest gradient, no length twice, join the passive set; the normal
    equations are solved on it, and columns that turn negative leave.
    """
    n = len(counts)
    scale = 1.0 / np.sqrt(np.maximum(counts, 1))  # rare lengths weigh as much, relative to their size
    target = counts * scale
    padded = np.append(scale, 0.0)  # place -1 reads the zero
    weights = padded[rows]
    norms = np.sqrt((weights ** 2).sum(axis=1))
    x, passive = np.zeros(len(rows)), np.zeros(len(rows), dtype=bool)

    def columns(chosen: np.ndarray) -> np.ndarray:
        dense = np.zeros((n + 1, len(chosen)))
        for j in range(3):
            np.add.at(dense, (rows[chosen, j], np.arange(len(chosen))), weights[chosen, j])
        return dense[:n]

    best, best_gap = x, float(target @ target)
    for _ in range(rounds):
        used_rows = np.flatnonzero(x)
        gap = target - columns(used_rows) @ x[used_rows]
        if (error := float(gap @ gap)) < best_gap:
            best, best_gap = x.copy(), error
        if best_gap <= 1e-4 * float(target @ target):
            break
        rest = np.append(gap, 0.0)
        gradient = (rest[rows] * weights).sum(axis=1) / norms
        gradient[passive] = 0
        order = np.argsort(-gradient)[:block * 40]
        used: set[int] = set()
        added = []
        for i in order.tolist():
            if gradient[i] <= 1e-6 or len(added) >= block:
                break
            places = [p for p in rows[i].tolist() if p >= 0]
            if not used.intersection(places):
                used.update(places)
                added.append(i)
        if not added:
            break
        passive[added] = True
        for _ in range(3):
            chosen = np.flatnonzero(passive)
            a = columns(chosen)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(chosen)), a.T @ target)
            x = np.zeros(len(rows))
            x[chosen] = np.maximum(z, 0)
            passive[chosen[z <= 0]] = False
            if (z > 0).all():
                break
    return best


@dataclass(frozen=True)
class Plan:
    """Slots of each length in order: `runs[length]` lists (first slot, slots per sequence, first sequence, offsets)."""

    sequences: int
    runs: dict[int, list[tuple[int, int, int, tuple[int, ...]]]]


class _Sequences:
    """Sequences in groups of equal ones: full ones, and open ones by the space that is left."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.limit, self.left = limit, counts.astype(np.int64).copy()
        self.done: list[tuple[tuple[int, ...], int]] = []
        self.spaces: list[int] = []
        self.open: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(self, shape: tuple[int, ...], times: int, space: int) -> None:
        if not space:
            self.done.append((shape, times))
            return
        if space not in self.open:
            insort(self.spaces, space)
        self.open.setdefault(space, []).append((shape, times))

    def groups(self) -> list[tuple[tuple[int, ...], int]]:
        return self.done + [group for space in self.spaces for group in self.open[space]]

    def fit_patterns(self, over: int) -> None:
        """Patterns whose longest piece has more than `over` tokens, as often as the least-squares fit says."""
        lengths = np.flatnonzero(self.left)
        rows = patterns(lengths, self.limit)
        rows = rows[lengths[rows[:, 0]] > over] if len(rows) else rows
        if not len(rows):
            return
        x = repeat_counts(rows, self.left[lengths].astype(np.float64))
        for i in np.argsort(-x, kind="stable").tolist():
            if x[i] < 0.5:
                break
            shape = tuple(sorted((int(lengths[p]) for p in rows[i].tolist() if p >= 0), reverse=True))
            need = {length: shape.count(length) for length in shape}
            times = min([int(round(x[i])), *(int(self.left[length]) // m for length, m in need.items())])
            if times:
                self.done.append((shape, times))
                for length, m in need.items():
                    self.left[length] -= times * m

    def best_fit(self, shortest: int, fresh: bool) -> None:
        """Pieces of `shortest` and more, longest first, into the least space that takes them; where none does,
        into new sequences if `fresh`."""
        for length in range(self.limit, shortest - 1, -1):
            while self.left[length]:
                at = bisect_left(self.spaces, length)
                if at < len(self.spaces):
                    space = self.spaces[at]
                    shape, times = self.open[space].pop()
                    if not self.open[space]:
                        del self.open[space]
                        self.spaces.pop(at)
                    taken = min(times, int(self.left[length]))
                    if times > taken:
                        self.put(shape, times - taken, space)
                    self.put((*shape, length), taken, space - length)
                elif fresh:
                    each = min(self.limit // length, int(self.left[length]))
                    taken = int(self.left[length]) // each
                    self.put((length,) * each, taken, self.limit - each * length)
                    taken *= each
                else:
                    break
                self.left[length] -= taken


def _by_patterns(counts: np.ndarray, limit: int) -> _Sequences:
    """Pieces of over half a sequence need one each, so patterns with them come first, and the spaces that such
    pieces leave where no pattern fitted are filled before shorter pieces get sequences of their own."""
    own = _Sequences(counts[:limit + 1], limit)
    own.fit_patterns(limit // 2)
    own.best_fit(limit // 2 + 1, fresh=True)
    own.best_fit(1, fresh=False)
    own.fit_patterns(0)
    own.best_fit(1, fresh=True)
    return own


def _plain(counts: np.ndarray, limit: int) -> _Sequences:
    """The residual packer alone: best fit of everything, longest first."""
    own = _Sequences(counts[:limit + 1], limit)
    own.best_fit(1, fresh=True)
    return own


def packed_lengths(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences) that use every piece once; counts[i] is of length i.

    Patterns are fitted and the rest is packed by best fit. The same best fit without any pattern is planned too,
    both on the histogram; where rounding the fit cost more sequences than it saved, that plan is taken.
    """
    plans = [own.groups() for own in (_by_patterns(counts, limit), _plain(counts, limit))]
    return min(plans, key=lambda groups: sum(times for _, times in groups))


def planned(counts: np.ndarray, limit: int) -> Plan:
    """Where the pieces of each length go."""
    runs: dict[int, list[tuple[int, int, int, tuple[int, ...]]]] = {}
    used: dict[int, int] = {}
    sequences = 0
    for shape, times in packed_lengths(counts, limit):
        at = 0
        offsets: dict[int, list[int]] = {}
        for length in shape:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, len(places), sequences, tuple(places)))
            used[length] = first + len(places) * times
        sequences += times
    return Plan(sequences, runs)


def pieces(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, end: int = END, with_ids: bool = False,
    cache: int | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids), with its task and number among the
    task's pieces of that length. Null text counts as empty, whose only token is `end`."""
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = token_ids.encoder(vocabulary, cache), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, dtype=np.int64)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            texts = (t.as_py() or "" for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode(texts)):
                ids += last
                for number, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    length = len(part) // 4
                    row = (doc_id, number, at // 4, length, zlib.crc32(part), task, int(seen[length]))
                    rows.append((*row, part) if with_ids else row)
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [()] * (8 if with_ids else 7)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = [part.split()[0] for part in layout.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(work, layout)


def packed(
    docs: DataFrame, vocabulary: str, limit: int = LIMIT, end: int = END, with_ids: bool = False,
    cache: int | None = None,
) -> DataFrame:
    """One row per piece of `docs`: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Every document is its token ids and `end`; only one longer than `limit` is cut. Repeated rows are packed
    as often as they come, other columns are ignored, an empty table gives no rows. `cache` bounds the pieces of
    text whose ids a Python worker keeps.
    """
    found = saved(pieces(docs, vocabulary, limit, end, with_ids, cache))
    by_task = found.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(limit + 1, dtype=np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `limit` rows at most
        counts[row["length"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(planned(counts, limit))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = found.join(offsets, ["task", "length"]).withColumn("number", F.col("nth") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    layout = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = {length: (np.array([r[0] for r in own]), own) for length, own in shared.value.runs.items()}
        for batch in batches:
            lengths, numbers = batch.column("length").to_pylist(), batch.column("number").to_pylist()
            sequence, offset = [], []
            for length, number in zip(lengths, numbers):
                firsts, own = runs[length]
                first, each, begin, places = own[int(np.searchsorted(firsts, number, side="right")) - 1]
                sequence.append(begin + (number - first) // each)
                offset.append(places[(number - first) % each])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(place, layout + ", sequence_id long, offset long")
