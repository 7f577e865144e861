"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into BLOCKS blocks; two fingerprints that differ in at most `distance` bits
agree on at least BLOCKS - distance blocks, so each fingerprint is filed under every choice of that many
blocks (5 of 8, 40 bits: few strangers meet even among many billions). Equal fingerprints collapse first, so
a file entry is a fingerprint and copies cost nothing. A bucket's members share 40 bits and so number 2**24
at most, 8 bytes each. Within a bucket a breadth-first walk verifies Hamming distances against the members
not yet reached and yields a spanning forest, never all pairs; connected components follow from the forests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import saved, tasks
from voltlake.llm.components import components

WORDS = 3
DISTANCE = 3
SEED = 42
BLOCKS = 8  # of one byte
#: Bytes of a text hashed at a time.
SECTION = 1 << 20
#: Unreached members of a bucket beyond which probing all near values is cheaper than comparing with each.
PROBE = 200_000
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _sections(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SECTION and (gap := _GAP.search(data, at + SECTION)):
        yield data[at:gap.start()]
        at = gap.end()
    yield data[at:] if at else data


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of a text's word shingles with repeats, unsigned. Fewer words: their whole sequence; none: 0."""
    # bytes.split() and bytes.lower() know the six ASCII white-space characters and A-Z only.
    carried: list[bytes] = []
    ones, total, digest = np.zeros(64, dtype=np.int64), 0, xxhash.xxh64_digest
    for section in _sections((text or "").encode().lower()):
        parts = carried + section.split()
        if len(parts) < words:
            carried = parts
            continue
        line = b" ".join(parts)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:].tolist())])
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
        carried = parts[len(parts) - words + 1:]
    if not total and carried:
        bits = np.unpackbits(np.frombuffer(digest(b" ".join(carried), SEED), dtype=np.uint8))
        ones, total = bits.astype(np.int64), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of whole texts, the 64 bits as a signed long; null text counts as empty and has 0."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def filed(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(key, fp): every fingerprint under each choice of BLOCKS - distance blocks; the key has choice and bytes."""
    choices = list_of_choices(distance)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            blocks = own.view(np.uint8).reshape(-1, BLOCKS).astype(np.int64)
            for at, choice in enumerate(choices):
                key = np.full(len(own), at, dtype=np.int64)
                for block in choice:
                    key = (key << 8) | blocks[:, block]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(work, "key long, fp long")


def list_of_choices(distance: int = DISTANCE) -> list[tuple[int, ...]]:
    """Blocks that make up each kind of key."""
    return list(combinations(range(BLOCKS), BLOCKS - distance))


def free_flips(key: int, distance: int) -> np.ndarray:
    """All changes of one to `distance` bits in the blocks that the key leaves free."""
    kept = list_of_choices(distance)[key >> (8 * (BLOCKS - distance))]
    bits = [np.uint64(1 << (8 * block + i)) for block in range(BLOCKS) if block not in kept for i in range(8)]
    return np.array([sum(c) for n in range(1, distance + 1) for c in combinations(bits, n)], dtype=np.uint64)


def forest(members: np.ndarray, key: int, distance: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of a bucket's distinct members (sorted) under links of at most `distance` bits."""
    left = members
    flips = None
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            if len(left) > PROBE:
                flips = free_flips(key, distance) if flips is None else flips
                part, front = front[:64], front[64:]
                near = part[:, None] ^ flips[None, :]
                place = np.minimum(np.searchsorted(left, near), len(left) - 1)
                rows, columns = np.nonzero(left[place] == near)
                reached, first = np.unique(place[rows, columns], return_index=True)
                source = part[rows[first]]
            else:
                size = max(1, (1 << 21) // len(left))
                part, front = front[:size], front[size:]
                close = np.bitwise_count(part[:, None] ^ left[None, :]) <= distance
                reached = np.flatnonzero(close.any(axis=0))
                source = part[close[:, reached].argmax(axis=0)]
            if len(reached):
                yield source, left[reached]
                front = np.concatenate([front, left[reached]])
                left = np.delete(left, reached)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): spanning forests of all buckets; any two fingerprints at most `distance` bits apart are connected."""
    dealt = filed(distinct, distance).repartition(tasks(distinct.sparkSession), "key").sortWithinPartitions("key")

    def of_groups(keys: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        # Buckets of two are most of those with any pair: compare them all at once.
        pairs = begins[ends - begins == 2]
        a, b = own[pairs], own[pairs + 1]
        close = np.bitwise_count(a ^ b) <= distance
        found = [(a[close], b[close])]
        for begin, end in zip(begins[ends - begins > 2].tolist(), ends[ends - begins > 2].tolist()):
            found += forest(np.sort(own[begin:end]), int(keys[begin]), distance)
        u, v = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own = [], []  # a bucket that goes on in the next batch is carried along
        for batch in batches:
            if not batch.num_rows:
                continue
            keys.append(batch.column(0).to_numpy())
            own.append(batch.column(1).to_numpy().view(np.uint64))
            if keys[-1][-1] == keys[0][0]:
                continue
            all_keys, all_own = np.concatenate(keys), np.concatenate(own)
            last = int(np.searchsorted(all_keys, all_keys[-1]))
            yield from of_groups(all_keys[:last], all_own[:last])
            keys, own = [all_keys[last:]], [all_own[last:]]
        if keys:
            yield from of_groups(np.concatenate(keys), np.concatenate(own))

    return dealt.mapInArrow(work, "u long, v long")


def near_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (hex), component_id (least doc_id that links reach).

    Texts without words have fingerprint 0 and link like any other. Rows that repeat a doc_id share its fate;
    a row without id never names a component, and one of such rows alone has none. An empty table gives no rows.
    """
    marked = saved(fingerprints(docs, words))
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = saved(components(links(distinct, distance)))
    least = rooted.join(distinct, rooted["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select(F.col("node").alias("fp"), "least")
    labels = saved(distinct.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))
    return marked.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` whose doc_id names their component, with all columns; rows alone without id stay.

    Null and empty texts count as one text without words. Rows that repeat an id stay or go together; a row without
    id goes where a row with one is linked to it. An empty table gives no rows.
    """
    stay = near_groups(docs, words, distance).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = saved(stay.select(F.col("doc_id").alias("_stay")).distinct())
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_stay"]), "left_semi")
