"""Removal of repeated 200-byte strings by a depth-limited, most-significant-digit radix sort of suffixes.

Two suffixes belong together if their first DEPTH bytes agree; nothing beyond is ever compared. The passes:

1. First digit: the gram of GRAM bytes with the least hash inside a suffix's first DEPTH bytes. It depends on
   those bytes alone, so equal strings have equal digits, and neighbouring suffixes mostly share one: a run.
   Runs are dealt by their digit; a run whose digit no other run has is unique and leaves, as in any radix
   sort a group of one does. That is one row for about 65 bytes of text instead of one a byte.
2. Whole runs: runs of one digit whose bytes agree from end to end are repeated as they stand.
3. Digits of eight bytes, from the first on, for the suffixes of the runs that share their digit but not all
   their bytes. Groups split digit by digit, groups of one leave, and what is together after DEPTH bytes is
   exactly the repeated strings.

Tasks combine equal runs before they deal them, so a passage that fills a third of the corpus travels once a
task. Runs of a digit that more than SPLIT rows have are dealt by their whole bytes too, so that they spread; a
digit with more than SPLIT different runs is grouped by 128-bit hashes of its single strings instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import saved, tasks, text_or_empty

DEPTH = 200
GRAM = 48
#: Bytes of a document looked at together, and of all documents whose equal runs a task combines.
SECTION = 1 << 22
COMBINE = 1 << 25
#: Runs of one digit that one task holds, and different ones that it compares (some 300 bytes each).
SPLIT = 50_000
#: Digits are counted by their last bits first; only those of a crowded bucket are counted one by one.
BUCKETS = 1 << 18
#: Suffixes sorted together.
SORTED = 1 << 20
PASS, FRESH, SEEN = 2, 0, 1
SETTLED, OPEN, WITNESS = 0, 1, 2

RUNS = "digit long, whole long, doc_id long, th long, at long, flag int"


def runs(data: bytes, depth: int = DEPTH, gram: int = GRAM) -> tuple[list[int], list[int], list[int]]:
    """(place of the gram, first suffix, number of suffixes) of every run of at most 2**22 bytes, in order."""
    if len(data) < depth:
        return [], [], []
    h = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    size = 1
    while size < gram:
        step = min(size, gram - size)
        h = h[:len(h) - step] * np.uint64(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> np.uint64(29)
        size += step
    # Hash above place: the least is the leftmost gram of the least hash.
    least = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    size, span = 1, depth - gram + 1
    while size < span:
        step = min(size, span - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1, [len(place)]])
    return place[cuts[:-1]].tolist(), cuts[:-1].tolist(), np.diff(cuts).tolist()


def packed(first, count):
    """First suffix and number of suffixes (at most 255) as one long."""
    return first * 256 + count


def _runs_of(docs: DataFrame, depth: int) -> DataFrame:
    """Runs of all documents; equal ones of a task are combined to one (SEEN) and their places passed on (PASS)."""
    span = 255

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        digits: list[int] = []
        wholes: list[int] = []
        places: list[int] = []
        owners: list[tuple[int | None, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            digit = np.array(digits, dtype=np.uint64).view(np.int64)
            whole = np.array(wholes, dtype=np.uint64).view(np.int64)
            at = np.array(places, dtype=np.int64)
            sizes = [o[2] for o in owners]
            doc = pa.array([o[0] for o in owners], pa.int64()).take(pa.array(np.repeat(np.arange(len(owners)), sizes)))
            th = np.repeat(np.array([o[1] for o in owners], dtype=np.int64), sizes)
            order = np.lexsort((whole, digit))
            d, w = digit[order], whole[order]
            start = np.ones(len(d), dtype=bool)
            start[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
            group = np.cumsum(start) - 1
            many = (np.bincount(group) >= 2)[group] if len(group) else start
            flag = np.where(many, SEEN, FRESH).astype(np.int32)
            heads = order[start]
            yield _table(digit[heads], whole[heads], doc.take(pa.array(heads)), th[heads], at[heads], flag[start])
            rest = order[many & ~start]
            # Places need only reach their document.
            none = np.zeros(len(rest), dtype=np.int64)
            yield _table(none, none, doc.take(pa.array(rest)), th[rest], at[rest], np.full(len(rest), PASS, dtype=np.int32))

        for batch in batches:
            for doc_id, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data, before = text.as_py().encode(), len(digits)
                for base in range(0, max(len(data) - depth + 1, 0), SECTION):
                    part = data[base:base + SECTION + depth - 1]
                    for gram, first, count in zip(*runs(part, depth)):
                        digit = digest(part[gram:gram + GRAM])
                        for begin in range(first, first + count, span):
                            n = min(span, first + count - begin)
                            digits.append(digit)
                            wholes.append(digest(part[begin:begin + n + depth - 1]))
                            places.append(packed(base + begin, n))
                if len(digits) > before:
                    owners.append((doc_id, th, len(digits) - before))
                held += len(data)
                if held >= COMBINE and digits:
                    yield from flush()
                    digits, wholes, places, owners, held = [], [], [], [], 0
        if digits:
            yield from flush()

    return docs.select("doc_id", "th", "text").mapInArrow(work, RUNS)


def _table(digit, whole, doc, th, at, flag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(digit), pa.array(whole), doc, pa.array(th), pa.array(at), pa.array(flag)],
        names=["digit", "whole", "doc_id", "th", "at", "flag"])


def _by_group(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where the value of `column` changes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy()
        if kept and values[-1] == kept[0].column(column)[0].as_py():
            kept.append(batch)
            continue
        last = int(np.searchsorted(values, values[-1]))
        if kept or last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


def _crowded(rows: DataFrame, split: int) -> DataFrame:
    """The digits that more than `split` rows have."""
    bucketed = rows.select("digit", F.col("digit").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))

    def above(frame: DataFrame, column: str) -> DataFrame:
        return saved(frame.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select(column))

    return above(bucketed.join(above(bucketed, "bucket"), "bucket", "left_semi"), "digit")


def _settled(all_runs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(doc_id, th, at, digit, kind): runs that repeat as a whole, and those whose digit has other runs.

    Runs of a digit meet in one task if at most `split` rows have it, else those of equal bytes do. A digit with
    more has several runs, or one that repeats, whose witness then finds nothing.
    """
    n = tasks(all_runs.sparkSession)

    def settle(rows: DataFrame, keys: list[str], column: int) -> DataFrame:
        whole_digits = keys == ["digit"]

        def of_groups(table: pa.Table) -> pa.RecordBatch:
            table = table.sort_by([("digit", "ascending"), ("whole", "ascending")])
            digit, whole = table["digit"].to_numpy(), table["whole"].to_numpy()
            new_digit = np.ones(len(digit), dtype=bool)
            new_digit[1:] = digit[1:] != digit[:-1]
            new_run = new_digit.copy()
            new_run[1:] |= whole[1:] != whole[:-1]
            by_digit, by_run = np.cumsum(new_digit) - 1, np.cumsum(new_run) - 1
            several = (np.bincount(by_digit[new_run]) >= 2)[by_digit] if whole_digits else np.ones(len(digit), dtype=bool)
            repeated = (np.bincount(by_run, weights=1 + table["flag"].to_numpy()) >= 2)[by_run]
            whole_rows, first_rows = np.flatnonzero(repeated), np.flatnonzero(several & new_run)
            kind = np.concatenate([np.full(len(whole_rows), SETTLED), np.where(repeated[first_rows], WITNESS, OPEN)])
            taken = table.take(pa.array(np.concatenate([whole_rows, first_rows])))
            return _kinds(taken, np.where(kind == SETTLED, 0, taken["digit"].to_numpy()), kind)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _by_group(batches, column):
                yield of_groups(table)

        return rows.repartition(n, *keys).sortWithinPartitions(*reversed(keys)).mapInArrow(
            work, "doc_id long, th long, at long, digit long, kind int")

    rows = all_runs.where(F.col("flag") != PASS)
    crowded = _crowded(rows, split)
    passed = all_runs.where(F.col("flag") == PASS).select(
        "doc_id", "th", "at", F.lit(0).cast("long").alias("digit"), F.lit(SETTLED).alias("kind"))
    return settle(rows.join(crowded, "digit", "left_anti").select(all_runs.columns), ["digit"], 0).unionByName(
        settle(rows.join(crowded, "digit", "left_semi").select(all_runs.columns), ["digit", "whole"], 1)).unionByName(passed)


def _kinds(rows, digit: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    columns = [rows.column(name) for name in ("doc_id", "th", "at")]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(digit, pa.int64()), pa.array(kind, pa.int32())], names=["doc_id", "th", "at", "digit", "kind"])


def repeated_suffixes(group: np.ndarray, words: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which suffixes share their first `depth` bytes with another of their group, by passes of eight bytes.

    `words[i]` has the eight bytes from place i on, `at` the suffixes' places. A pass sorts by (group, digit),
    numbers the new groups and drops those of one; the last digit overlaps where depth is no multiple of 8.
    """
    alive, group = np.arange(len(at)), group.astype(np.int64)
    for begin in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        if not len(alive):
            break
        digit = words[at[alive] + begin]
        key = digit * np.uint64(0x9E3779B97F4A7C15) + group.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key)
        g, d = group[order], digit[order]
        start = np.ones(len(order), dtype=bool)
        start[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        number = np.cumsum(start) - 1
        several = (np.bincount(number) >= 2)[number]
        alive, group = alive[order[several]], number[several]
    out = np.zeros(len(at), dtype=bool)
    out[alive] = True
    return out


def eight_bytes(data: bytes) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros follow the end."""
    b = np.frombuffer(data + bytes(7), dtype=np.uint8).astype(np.uint64)
    for step in (1, 2, 4):
        b = (b[:len(b) - step] << np.uint64(8 * step)) | b[step:]
    return b


def _stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, count) of the runs of marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _sorted_repeats(contexts: DataFrame, depth: int) -> DataFrame:
    """(doc_id, th, at) of the repeated suffixes in open runs; digits of at most SPLIT runs each."""
    n = tasks(contexts.sparkSession)

    def sort(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data = rows["context"].to_pylist()
        sizes = np.array([len(x) for x in data])
        counts = sizes - depth + 1
        digit = rows["digit"].to_numpy()
        number = np.cumsum(np.concatenate([[0], digit[1:] != digit[:-1]]))
        row = np.repeat(np.arange(len(data)), counts)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        found = repeated_suffixes(number[row], eight_bytes(b"".join(data)), (np.cumsum(sizes) - sizes)[row] + inside, depth)
        found &= rows["wants"].to_numpy(zero_copy_only=False)[row]
        marks = np.zeros(len(row) + len(data), dtype=bool)  # a gap after each run keeps stretches apart
        marks[np.arange(len(row)) + row] = found
        first, count = _stretches(marks)
        owner = np.repeat(np.arange(len(data)), counts + 1)[first]
        begin = first - (np.cumsum(counts + 1) - counts - 1)[owner] + rows["at"].to_numpy()[owner] // 256
        taken = rows.select(["doc_id", "th"]).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays(
            [taken["doc_id"].combine_chunks(), taken["th"].combine_chunks(), pa.array(packed(begin, count))],
            names=["doc_id", "th", "at"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for table in _by_group(batches, 0):
            held.append(table)
            size += table.num_rows * depth // 2
            if size >= SORTED:
                yield from sort(pa.concat_tables(held))
                held, size = [], 0
        if held:
            yield from sort(pa.concat_tables(held))

    return contexts.select("digit", "doc_id", "th", "at", "wants", "context").repartition(n, "digit").sortWithinPartitions(
        "digit").mapInArrow(work, "doc_id long, th long, at long")


def _hashed_repeats(contexts: DataFrame, depth: int) -> DataFrame:
    """The same for digits with more runs: a row a suffix, grouped by 128 bits of its bytes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, first = row["context"], row["at"] // 256
                own = [xxhash.xxh3_128_digest(data[i:i + depth]) for i in range(len(data) - depth + 1)]
                size = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.binary()), pa.array([row["doc_id"]] * size, pa.int64()), pa.array([row["th"]] * size, pa.int64()),
                     pa.array([packed(first + i, 1) for i in range(size)], pa.int64()), pa.array([row["wants"]] * size)],
                    names=["key", "doc_id", "th", "at", "wants"])

    rows = contexts.select("doc_id", "th", "at", "wants", "context").mapInArrow(
        cut, "key binary, doc_id long, th long, at long, wants boolean")
    many = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key")
    return rows.where("wants").join(many, "key").select("doc_id", "th", "at")


def removed(size: int, stretches: list[int], depth: int = DEPTH) -> tuple[list[tuple[int, int]], int]:
    """Maximal removed (begin, end) runs of a document of `size` bytes, and how many bytes they cover."""
    out: list[list[int]] = []
    for begin, count in sorted(divmod(x, 256) for x in stretches):
        end = begin + count + depth - 1
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out], sum(b - a for a, b in out)


def kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for begin, end in spans:
        parts.append(data[at:begin])
        at = end
    return b"".join([*parts, data[at:]])


TOLD = [("doc_id", "long"), ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string")]


def _told(doc_id, data: bytes, stretches: list[int], depth: int) -> dict:
    spans, total = removed(len(data), stretches, depth)
    digest = hashlib.sha256(kept(data, spans)).hexdigest()
    return {"doc_id": doc_id, "n_bytes": len(data), "n_removed": total, "n_spans": len(spans), "kept_sha256": digest}


def _arrow(layout: list[tuple[str, str]]) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
             "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in layout])


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["_id"]) & (left["th"] == right["_th"])


def deduplicated(docs: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that lies in a `depth`-byte string of the text's UTF-8 bytes which starts anywhere else too is
    removed; strings are judged on the input and never cross documents. Null text counts as empty; texts
    shorter than `depth` lose nothing. Rows are told apart by id and text, so rows that repeat both repeat
    each other's strings and lose them all, as rows of equal text with different ids do. Other columns are
    ignored; an empty table gives no rows.
    """
    base = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("th"), text_or_empty().alias("text"))
    marked = saved(_settled(saved(_runs_of(base, depth)), split))
    lists = marked.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("kind", "at", "digit")).alias("runs"))
    layout = [*TOLD, ("th", "long"), ("kind", "int"), ("pending", "binary"), ("settled", "array<bigint>"),
              ("digit", "long"), ("at", "long"), ("wants", "boolean"), ("context", "binary")]
    schema = _arrow(layout)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document that is done (0) or waits for its open runs (1), and for each such run (2)."""
        for batch in batches:
            rows, size = [], 0
            for at in range(batch.num_rows):
                doc = batch.slice(at, 1).to_pylist()[0]
                data, found = doc["text"].encode(), doc["runs"] or ()
                settled = [r["at"] for r in found if r["kind"] == SETTLED]
                if any(r["kind"] == OPEN for r in found):
                    rows.append({"doc_id": doc["doc_id"], "th": doc["th"], "kind": 1, "pending": data, "settled": settled})
                else:
                    rows.append(_told(doc["doc_id"], data, settled, depth) | {"th": doc["th"], "kind": 0})
                for r in found:
                    if r["kind"] != SETTLED:
                        begin, count = divmod(r["at"], 256)
                        rows.append({"doc_id": doc["doc_id"], "th": doc["th"], "kind": 2, "digit": r["digit"], "at": r["at"],
                                     "wants": r["kind"] == OPEN, "context": data[begin:begin + count + depth - 1]})
                size += len(data)
                if size >= SECTION:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    joined = base.join(lists, _same_row(base, lists), "left").select("doc_id", "th", "text", "runs")
    judged = saved(joined.mapInArrow(judge, ", ".join(f"{name} {kind}" for name, kind in layout)))
    contexts = judged.where("kind = 2")
    hot = saved(contexts.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split).select("digit"))
    repeats = _sorted_repeats(contexts.join(hot, "digit", "left_anti"), depth).unionByName(
        _hashed_repeats(contexts.join(hot, "digit", "left_semi"), depth))
    more = repeats.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list("at").alias("more"))
    waiting = judged.where("kind = 1").select("doc_id", "th", "pending", "settled")
    told = _arrow(TOLD)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                doc = batch.slice(at, 1).to_pylist()[0]
                rows.append(_told(doc["doc_id"], doc["pending"], [*doc["settled"], *(doc["more"] or ())], depth))
            yield pa.RecordBatch.from_pylist(rows, schema=told)

    names = [name for name, _ in TOLD]
    late = waiting.join(more, _same_row(waiting, more), "left").select("doc_id", "pending", "settled", "more").mapInArrow(
        finish, ", ".join(f"{name} {kind}" for name, kind in TOLD))
    return judged.where("kind = 0").select(*names).unionByName(late)
