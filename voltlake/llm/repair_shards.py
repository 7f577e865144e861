"""Token-id shards compressed by Re-Pair, with random access.

Documents are dealt into ranges of doc_id and sorted; each task cuts its ids into shards of whole documents
with about SHARD tokens and compresses each by itself: frequent pairs of neighbouring symbols are replaced by
new symbols again and again, many pairs a round, from the most frequent down. A shard is a row of a Parquet
table: its rules (two symbols each), the sequence that remains, the expansion length of every rule, and where
its documents begin. Any token range is decoded from the symbols that cover it: the running sum of expansion
lengths finds the first, and only those symbols are expanded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltlake.llm import token_ids
from voltlake.llm.common import shared_dir, tasks, text_or_empty

END = 2
#: A shard is closed when it has so many tokens; a longer document fills one alone.
SHARD = 1 << 18
#: Replacement ends when no pair occurs so often.
LEAST = 8
#: The least count that is replaced falls by this factor from round to round, down to LEAST.
RATIO = 6
SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("base", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
    ("rules", pa.binary()), ("lengths", pa.binary()), ("sequence", pa.binary()),
])
LAYOUT = (
    "part int, shard int, first_token long, n_tokens long, base long, doc_ids array<bigint>, "
    "doc_starts array<bigint>, rules binary, lengths binary, sequence binary"
)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as four planes of bytes, lowest first; the upper ones compress to little."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


@dataclass(frozen=True)
class Grammar:
    """Symbols below `base` are ids; symbol base + i is the pair rules[i]. `lengths` are the rules' expansions."""

    base: int
    rules: np.ndarray  # n x 2
    lengths: np.ndarray
    sequence: np.ndarray

    def symbol_lengths(self, symbols: np.ndarray) -> np.ndarray:
        padded = np.append(self.lengths, 1)
        return np.where(symbols >= self.base, padded[np.where(symbols >= self.base, symbols - self.base, -1)], 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of the symbols in order: the rules among them are expanded once each, a level at a time."""
        at = np.flatnonzero(symbols >= self.base)
        rule = symbols[at] - self.base
        used = np.zeros(len(self.rules), dtype=bool)
        used[rule] = True
        ruled = np.flatnonzero(used) + self.base
        flat = ruled
        while (deep := flat >= self.base).any():
            places = np.arange(len(flat)) + np.cumsum(deep) - deep
            out = np.empty(len(flat) + int(deep.sum()), dtype=np.int64)
            out[places[~deep]] = flat[~deep]
            pair = self.rules[flat[deep] - self.base]
            out[places[deep]], out[places[deep] + 1] = pair[:, 0], pair[:, 1]
            flat = out
        own = self.lengths[ruled - self.base]
        begins = np.zeros(len(self.rules) + 1, dtype=np.int64)
        begins[ruled - self.base] = np.cumsum(own) - own
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[at] = self.lengths[rule]
        ends = np.cumsum(sizes)
        # Where each symbol's ids begin in `flat` with the symbols themselves behind it.
        source = np.arange(len(flat), len(flat) + len(symbols))
        source[at] = begins[rule]
        source -= ends - sizes
        index = np.repeat(source, sizes)
        index += np.arange(len(index))
        return np.concatenate([flat, symbols])[index]

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, from the covering symbols alone."""
        if start >= stop:
            return np.zeros(0, dtype=np.int64)
        ends = np.cumsum(self.symbol_lengths(self.sequence))
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
        begin = int(ends[first - 1]) if first else 0
        return self.expand(self.sequence[first:last + 1])[start - begin:stop - begin]


def _every_other(at: np.ndarray) -> np.ndarray:
    """Which of the ascending places to take so that no two are neighbours: every other in a run, from its first."""
    number = np.arange(len(at))
    starts = np.ones(len(at), dtype=bool)
    starts[1:] = np.diff(at) > 1
    return (number - np.maximum.accumulate(np.where(starts, number, 0))) % 2 == 0


def _most_frequent(sequence: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places, apart from one another, of the most frequent pair at `at` that occurs `least` times; none if none
    does. All places of a pair are among `at` or none. The second array numbers the pair, 0."""
    code = sequence.take(at).astype(np.uint64) << np.uint64(32) | sequence.take(at + 1)
    # Other hashes first leave out most pairs that occur less often, so that few are sorted.
    for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        slots = (code * np.uint64(factor) >> np.uint64(46)).astype(np.intp)
        kept = (np.bincount(slots, minlength=1 << 18) >= least).take(slots)
        at, code = at[kept], code[kept]
    _, own, times = np.unique(code, return_inverse=True, return_counts=True)
    for pair in np.argsort(-times, kind="stable"):
        if times[pair] < least:
            break
        found = at[own == pair]
        found = found[_every_other(found)]
        if len(found) >= max(2, least // 2):  # of a symbol's own repeats every other place is free
            return found, np.zeros(len(found), dtype=np.intp)
    return at[:0], own[:0]


def compress(ids: np.ndarray, base: int, least: int = LEAST) -> Grammar:
    """Re-Pair of one shard, without sorting.

    A round counts the hashes of all neighbouring pairs, which finds every pair that may occur often enough.
    One pair a hash is then counted exactly; one that collides with it has its turn in a later round, whose
    hash differs. Pairs of at least 1 / RATIO of the round's highest count are replaced together. A round at
    `least` that replaces nothing (hashes or overlaps hid every pair) counts the pairs left exactly and replaces
    the most frequent one, so the loop ends only when no pair occurs `least` times.
    """
    sequence = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    lengths = np.zeros(0, dtype=np.int64)
    bits = max(8, min(22, int(len(ids)).bit_length() - 1))
    size, shift, bar = 1 << bits, np.uint32(32 - bits), len(sequence)
    first, number = np.empty(size, dtype=np.int32), np.empty(size, dtype=np.int32)
    for turn in count(1):
        if len(sequence) < 2:
            break
        mixed = sequence[:-1] * np.uint32(0x9E3779B1 + 2 * turn)
        mixed ^= sequence[1:] * np.uint32(0x85EBCA77 + 4 * turn)
        mixed *= np.uint32(0xC2B2AE3D)
        mixed >>= shift
        slots = mixed.astype(np.intp)
        hashed = np.bincount(slots, minlength=size)
        top = int(hashed.max())
        if top < least:
            break
        floor = bar = max(least, min(bar, top) // RATIO)
        full = hashed >= floor
        heavy = at = np.flatnonzero(full.take(slots))
        # From here on the slots that hold so many pairs are numbered in order.
        held = np.flatnonzero(full)
        number[held] = np.arange(len(held), dtype=np.int32)
        own, left, right = number.take(slots.take(at)), sequence.take(at), sequence.take(at + 1)
        first[own] = np.arange(len(at), dtype=np.int32)
        head = first.take(own)
        same = (left == left.take(head)) & (right == right.take(head))
        at, own = at[same], own[same]
        times = np.bincount(own, minlength=len(held)).take(own)
        frequent = times >= floor
        at, own, times = at[frequent], own[frequent], times[frequent]
        # Of overlapping places the more frequent pair has precedence.
        apart = np.diff(at) > 1
        ahead = np.ones(len(at), dtype=bool)
        ahead[1:] &= apart | (times[1:] >= times[:-1])
        ahead[:-1] &= apart | (times[:-1] >= times[1:])
        at, own = at[ahead], own[ahead]
        free = _every_other(at)
        at, own = at[free], own[free]
        uses = np.bincount(own, minlength=len(held))
        worth = uses >= max(2, least // 2)  # overlaps may leave a pair with fewer uses than it has places
        taken = worth.take(own)
        at, own = at[taken], own[taken]
        if not len(at):
            if floor > least:
                continue
            at, own = _most_frequent(sequence, heavy, least)
            if not len(at):
                break
            worth = np.ones(1, dtype=bool)
        placed = np.cumsum(worth) - 1
        new = placed.take(own)
        pair = np.empty((int(placed[-1]) + 1, 2), dtype=np.int64)
        pair[new, 0], pair[new, 1] = sequence.take(at), sequence.take(at + 1)
        known, padded = len(lengths), np.append(lengths, 1)
        rules.append(pair)
        lengths = np.concatenate([lengths, padded[np.where(pair >= base, pair - base, -1)].sum(axis=1)])
        sequence[at] = (base + known + new).astype(np.uint32)
        keep = np.ones(len(sequence), dtype=bool)
        keep[at + 1] = False
        sequence = sequence[keep]
    return Grammar(base, np.concatenate([np.zeros((0, 2), dtype=np.int64), *rules]), lengths, sequence.astype(np.int64))


def shards(docs: DataFrame, vocabulary: str, end: int = END, size: int = SHARD) -> DataFrame:
    """The rows of the file format for (doc_id, text), in ascending doc_id; rows without id come first."""
    dealt = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(tasks(docs.sparkSession), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = token_ids.encoder(vocabulary), TaskContext.get().partitionId()
        base = own.tokenizer.get_vocab_size(with_added_tokens=True)
        last = np.array([end], dtype="<u4").tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        starts: list[int] = []
        done = shard = held = 0

        def row() -> pa.RecordBatch:
            grammar = compress(np.frombuffer(b"".join(ids), dtype="<u4"), base)
            return pa.RecordBatch.from_pylist([{
                "part": part, "shard": shard, "first_token": done, "n_tokens": held, "base": base,
                "doc_ids": doc_ids, "doc_starts": starts, "rules": planes(grammar.rules.ravel()),
                "lengths": planes(grammar.lengths), "sequence": planes(grammar.sequence),
            }], schema=SCHEMA)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), own.encode(t.as_py() for t in batch.column(1))):
                doc_ids.append(doc_id)
                starts.append(done + held)
                ids += [coded, last]
                held += len(coded) // 4 + 1
                if held >= size:
                    yield row()
                    done, shard, held, ids, doc_ids, starts = done + held, shard + 1, 0, [], [], []
        if doc_ids:
            yield row()

    return dealt.sortWithinPartitions("doc_id", "text").mapInArrow(work, LAYOUT)


def write_shards(docs: DataFrame, path: str, vocabulary: str, end: int = END) -> None:
    shards(docs, vocabulary, end).write.parquet(path)


def grammar_of(row: dict) -> Grammar:
    """The grammar of one row of the file format."""
    return Grammar(row["base"], from_planes(row["rules"]).reshape(-1, 2), from_planes(row["lengths"]), from_planes(row["sequence"]))


def documents_of(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the part, ids) of a shard's documents."""
    grammar = grammar_of(row)
    ids = grammar.expand(grammar.sequence).astype("<u4")
    starts = row["doc_starts"]
    for doc_id, start, stop in zip(row["doc_ids"], starts, [*starts[1:], row["first_token"] + row["n_tokens"]]):
        yield doc_id, start, ids[start - row["first_token"]:stop - row["first_token"]]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at `path`: doc_id, start, n_tokens, ids_crc32, all from the decoded ids."""
    files = spark.read.schema(LAYOUT).parquet(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                found = [(row["part"], d, s, len(ids), zlib.crc32(ids)) for d, s, ids in documents_of(row)]
                columns = list(zip(*found)) or [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.mapInArrow(work, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # One row a part, as many as the shuffle had partitions.
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(offsets, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, vocabulary: str, path: str | None = None) -> DataFrame:
    """Write `docs` as shards (to a new shared folder by default) and return what read_documents finds there.

    Null text counts as empty and has the end id alone. Rows that repeat a doc_id are written one after the
    other by text, rows without id first; other columns are ignored. An empty table gives no rows.
    """
    path = path or shared_dir(docs.sparkSession)
    write_shards(docs, path, vocabulary)
    return read_documents(docs.sparkSession, path)
