"""Distinct slices of a buffer, found without a Python object for each."""

from __future__ import annotations

import numpy as np


def spaces(data: np.ndarray) -> np.ndarray:
    """Which bytes are ASCII white space."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def distinct(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices data[start:end] (not empty), and for each slice its place among them.

    Slices of up to 16 bytes are held as their first and last eight bytes and their length, which tell them
    apart exactly. Each is compared with one slice that a mix of these picks, mostly its like; the others are
    sorted by their mix, and should two different ones ever mix alike, they go the way of the longer slices,
    through a dict.
    """
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    size = ends - starts
    place = np.empty(len(starts), dtype=np.int64)
    short = np.flatnonzero(size <= 16)
    s, n = starts[short], size[short]
    first = words[s] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(n, 8))).astype(np.uint64))
    last = np.where(n > 8, words[np.maximum(ends[short] - 8, 0)], 0)
    mix = (first ^ (first >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mix ^= (mix >> np.uint64(32)) ^ (last * np.uint64(0x9E3779B97F4A7C15))
    mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + n.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    slot = (mix >> np.uint64(64 - max(8, min(20, len(short).bit_length())))).astype(np.intp)
    number = np.arange(len(short), dtype=np.int32)
    holder = np.empty(1 << 20, dtype=np.int32)
    holder[slot] = number
    head = holder.take(slot)
    alike = (first.take(head) == first) & (last.take(head) == last) & (n.take(head) == n)
    heads = np.flatnonzero(head == number)
    rank = np.empty(len(short), dtype=np.int64)
    rank[heads] = np.arange(len(heads))
    place[short] = rank.take(head)
    other = np.flatnonzero(~alike)
    order = other[np.argsort(mix[other])]
    new = np.ones(len(order), dtype=bool)
    new[1:] = mix[order[1:]] != mix[order[:-1]]
    # All slices of a mix are alike if neighbours in order are.
    a, b = order[1:][~new[1:]], order[:-1][~new[1:]]
    rest = np.flatnonzero(size > 16)
    if ((first[a] != first[b]) | (last[a] != last[b]) | (n[a] != n[b])).any():
        rest = np.concatenate([rest, short[other]])
    else:
        place[short[order]] = len(heads) + np.cumsum(new) - 1
        heads = np.concatenate([heads, order[new]])
    found = [data[a:b] for a, b in zip(s[heads].tolist(), (s + n)[heads].tolist())]
    if len(rest):
        known: dict[bytes, int] = {}
        base = len(found)
        place[rest] = [known.setdefault(data[a:b], base + len(known)) for a, b in zip(starts[rest].tolist(), ends[rest].tolist())]
        found += known
    return found, place


def gathered(values: list[bytes], place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values (little-endian unsigned 32-bit numbers) of all places in a row, and where each place's end."""
    flat = np.frombuffer(b"".join(values), dtype="<u4")
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    begins = np.cumsum(sizes) - sizes
    counts = sizes[place]
    ends = np.cumsum(counts)
    index = np.arange(int(ends[-1]) if len(ends) else 0)
    index += np.repeat(begins[place] - (ends - counts), counts)
    return flat[index], ends
