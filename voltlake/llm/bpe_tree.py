"""Byte-level BPE by a segment tree over adjacent pair ranks, and its decoding.

For every word the leaves of a binary tree hold the merge rank of each adjacent pair; inner nodes hold the
least (rank, position), so the root is the leftmost merge of lowest rank. A merge changes at most three
leaves - the pair itself and its two neighbours - and each is carried up in logarithmic time. This repeats
until the root holds no mergeable pair. Words of one tree size are worked on together in numpy: row i of
every array is word i, so a step costs one vector operation a tree level for all words at once.

A text is cut where the pre-tokenizer always cuts - before a single space, around a single line end and before
the mark that ends a word - and the distinct chunks of a section of text, found in numpy, are encoded once
while they stay in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voltlake.llm import slices
from voltlake.llm.token_ids import trim

#: Chunks kept by a Python worker; beyond it the later half goes (common ones come early), which changes no result.
CACHE = 400_000
#: Words in one numpy batch times their tree size.
BATCH = 1 << 19
#: Characters whose chunks are looked up together; longer texts are cut between chunks.
SECTION = 1 << 21
#: Rows of a batch that are in Python's hands at a time.
ROWS = 1000
#: Words over so many bytes go through a tree of their own in plain lists, where numpy would do one word a step.
LONG = 512
NONE = np.int64(1) << np.int64(62)

# The pre-tokenizer's pattern of byte-level BPE.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Vectorised lookup of (left, right) -> (rank, merged id)."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, ids: int):
        self.ids = ids
        keys = pairs[:, 0].astype(np.int64) * ids + pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order].astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair can't merge) and place in `merged`; -1 on either side is no token."""
        keys = left * self.ids + right
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(keys), NONE), at
        good = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(good, self.rank[at], NONE), at


class Encoder:
    """Encoder and decoder of one vocabulary file; added tokens are found in the text first."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        vocab, letters = model["model"]["vocab"], byte_letters()
        split = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        pairs = np.array([[vocab[a], vocab[b]] for a, b in split], dtype=np.int64).reshape(-1, 2)
        merged = np.array([vocab[a + b] for a, b in split], dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.pairs = PairTable(pairs, merged, size)
        self.of_byte = np.zeros(256, dtype=np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        raw = [b""] * size
        for token, at in vocab.items():
            raw[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, at in self.added.items():
            raw[at] = token.encode()
        self.lengths = np.array([len(b) for b in raw], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.names = [str(i) for i in range(size)]
        self.chunks: dict[bytes, tuple[bytes, str]] = {}  # ids as bytes, and as decimal text
        self.ranks: dict[int, tuple[int, int]] | None = None

    def merge_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by the segment tree."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) == 1:
                out[i] = [int(self.of_byte[word[0]])]
            elif len(word) > LONG:
                out[i] = self._long(word)
            elif word:
                by_size.setdefault(1 << max(1, (len(word) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            step = max(1, BATCH // size)
            for at in range(0, len(members), step):
                part = members[at:at + step]
                flat, ends = self._tree([words[i] for i in part], size)
                begin = 0
                for i, end in zip(part, ends):
                    out[i] = flat[begin:end]
                    begin = end
        return out

    def _long(self, word: bytes) -> list[int]:
        """The same tree for one long word."""
        if self.ranks is None:
            keys = zip(self.pairs.keys.tolist(), self.pairs.rank.tolist(), self.pairs.merged.tolist())
            self.ranks = {key: (rank, merged) for key, rank, merged in keys}
        ranks, ids, none = self.ranks, self.pairs.ids, int(NONE)
        size = 1 << (len(word) - 1).bit_length()
        token = self.of_byte[np.frombuffer(word, dtype=np.uint8)].tolist()
        n, width = len(token), size + 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def value(at: int) -> int:
            right = after[at]
            found = ranks.get(token[at] * ids + token[right]) if right < n else None
            return found[0] * width + at if found else none

        def carry(node: int) -> None:
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        for at in range(n):
            tree[size + at] = value(at)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            at = tree[1] % width
            right = after[at]
            token[at] = ranks[token[at] * ids + token[right]][1]
            token[right] = -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            changed = [(right, none), (at, value(at))]
            if before[at] >= 0:
                changed.append((before[at], value(before[at])))
            for leaf, found in changed:
                tree[size + leaf] = found
                carry(size + leaf)
        return [t for t in token if t >= 0]

    def _tree(self, words: list[bytes], size: int) -> tuple[list[int], list[int]]:
        """Ids of all words on end, and where each word's end."""
        n = len(words)
        token = np.full((n, size + 1), -1, dtype=np.int64)
        lengths = np.array([len(w) for w in words])
        held = np.arange(size + 1)[None, :] < lengths[:, None]
        token[held] = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after = np.tile(np.arange(1, size + 2), (n, 1))  # next live token; places past the end hold -1
        before = np.tile(np.arange(-1, size), (n, 1))
        rank, _ = self.pairs.find(token[:, :-1].ravel(), token[:, 1:].ravel())
        # A node holds rank * (size + 1) + position, so that the least is the leftmost of the lowest rank.
        width = size + 1
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        leaves = rank.reshape(n, size)
        tree[:, size:] = np.where(leaves < NONE, leaves * width + np.arange(size), NONE)
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            at = tree[rows, 1] % width
            right = after[rows, at]
            _, place = self.pairs.find(token[rows, at], token[rows, right])
            token[rows, at] = self.pairs.merged[place]
            token[rows, right] = -1
            beyond = np.minimum(after[rows, right], size)
            after[rows, at] = after[rows, right]
            before[rows, beyond] = at
            left = before[rows, at]
            self._update(tree, rows, right, np.full(len(rows), NONE), size)
            ranked, _ = self.pairs.find(token[rows, at], token[rows, beyond])
            self._update(tree, rows, at, np.where(ranked < NONE, ranked * width + at, NONE), size)
            some = left >= 0
            r, l, a = rows[some], left[some], at[some]
            ranked, _ = self.pairs.find(token[r, l], token[r, a])
            self._update(tree, r, l, np.where(ranked < NONE, ranked * width + l, NONE), size)
        live = token >= 0
        return token[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, size: int) -> None:
        good = leaf < size
        rows, node, value = rows[good], leaf[good] + size, value[good]
        tree[rows, node] = value
        while size > 1:
            node, size = node >> 1, size >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _parts(self, chunk: str) -> list[bytes]:
        """Words of a chunk, and added tokens as they are written."""
        if not self.special or "<" not in chunk:
            return [word.encode() for word in WORDS.findall(chunk)]
        parts, at = [], 0
        for found in self.special.finditer(chunk):
            parts += [*WORDS.findall(chunk[at:found.start()]), found[0]]
            at = found.end()
        return [word.encode() for word in (*parts, *WORDS.findall(chunk[at:]))]

    def _learn(self, chunks: list[bytes]) -> None:
        """Take chunks that the cache lacks into it, their distinct words merged together."""
        known, names = self.chunks, self.names
        plain = [c for c in chunks if (c[1:] if c[0] == 32 else c).isalpha()]  # ASCII letters: one word
        mixed = [(c, self._parts(c.decode())) for c in set(chunks).difference(plain)]
        added = {token.encode(): [at] for token, at in self.added.items()}
        words = [*plain, *{w for _, parts in mixed for w in parts}.difference(known, plain, added)]
        merged = self.merge_words(words)
        merged += added.values()
        flat = np.fromiter(chain.from_iterable(merged), dtype="<u4").tobytes()
        ends = (4 * np.cumsum([len(ids) for ids in merged])).tolist()
        for word, a, b, ids in zip([*words, *added], [0, *ends], ends, merged):
            known[word] = (flat[a:b], ",".join([names[i] for i in ids]))
        for chunk, parts in mixed:
            found = [known[w] for w in parts]
            known[chunk] = (b"".join([f[0] for f in found]), ",".join([f[1] for f in found]))

    def _sections(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """(text's place, section) in groups of about SECTION characters."""
        group, held = [], 0
        for place, text in enumerate(texts):
            for section in sections(text):
                group.append((place, section))
                held += len(section)
                if held >= SECTION:
                    yield group
                    group, held = [], 0
        yield group

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids, and the same as decimal text, of each text in order."""
        ids: list[np.ndarray] = []
        listed: list[str] = []
        done = 0
        for group in self._sections(texts):
            for place, own, text in self._group(group):
                while done < place:
                    yield np.concatenate([np.zeros(0, dtype="<u4"), *ids]), ",".join(listed)
                    ids, listed, done = [], [], done + 1
                if len(own):
                    ids.append(own)
                    listed.append(text)
        while done < len(texts):
            yield np.concatenate([np.zeros(0, dtype="<u4"), *ids]), ",".join(listed)
            ids, listed, done = [], [], done + 1

    def _group(self, group: list[tuple[int, str]]) -> Iterator[tuple[int, np.ndarray, str]]:
        """(text's place, ids, decimal text) of sections."""
        coded = [section.encode() for _, section in group]
        data = b"".join(coded)
        begins = np.cumsum([0, *map(len, coded)])
        starts = chunk_starts(data, begins, [section for _, section in group])
        found, place = slices.distinct(data, starts, np.append(starts[1:], len(data)))
        known = self.chunks
        own = list(map(known.get, found))
        unknown = [i for i, ids in enumerate(own) if ids is None]
        self._learn([found[i] for i in unknown])
        for i in unknown:
            own[i] = known[found[i]]
        ids, upto = slices.gathered([o[0] for o in own], place)
        names = [o[1] for o in own]
        edges = np.searchsorted(starts, begins)
        upto = np.concatenate([[0], upto])[edges].tolist()
        for n, (at, _) in enumerate(group):
            yield at, ids[upto[n]:upto[n + 1]], ",".join([names[i] for i in place[edges[n]:edges[n + 1]].tolist()])
        trim(known, CACHE)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of all ids in order, read as UTF-8 with the replacement character for what is none."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        shift = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.blob[shift + np.arange(total)].tobytes().decode("utf-8", "replace")


# White space that str.isspace() knows and ASCII does not, and its separators.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def chunk_starts(data: bytes, begins: np.ndarray, texts: list[str]) -> np.ndarray:
    """Where the chunks of the texts begin, which lie one after the other in `data`."""
    own = np.frombuffer(data, dtype=np.uint8)
    blank = np.ones(len(own) + 2, dtype=bool)
    blank[1:-1] = slices.spaces(own)
    alone = blank[1:-1] & ~blank[:-2] & ~blank[2:]
    start = np.zeros(len(own) + 1, dtype=bool)
    start[:-1] = alone & (own == 32)
    line = np.flatnonzero(alone & (own == 10))
    start[line] = start[line + 1] = True
    start[begins] = True
    # A mark between a letter and the next chunk.
    small = own | 32
    marks = np.flatnonzero(_MARK[own] & start[1:])
    marks = marks[marks > 0]
    start[marks[(small[marks - 1] >= 97) & (small[marks - 1] <= 122)]] = True
    for n, text in enumerate(texts):  # rare: other white space decides where such texts are cut
        if not text.isascii() or not text.isprintable():
            if _WIDE.search(text):
                start[begins[n] + 1:begins[n + 1]] = False
                start[[begins[n] + len(text[:m.start()].encode()) for m in _INSIDE.finditer(text)]] = True
    return np.flatnonzero(start[:-1])


_MARK = np.isin(np.arange(256), list(b",.;:!?"))
_INSIDE = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


def sections(text: str, size: int = SECTION) -> Iterator[str]:
    """The text cut between chunks after every `size` characters or so."""
    at = 0
    while len(text) - at > size:
        cut = _INSIDE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, and the SHA-256 of the ids as text and of the decoded text.

    Null text counts as empty, which has no ids. Texts of any length are encoded whole; repeated rows agree
    and an empty table gives no rows. Added tokens written out in a text are encoded as such.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows = []
            for ids, listed in own.encode_batch([t.as_py() or "" for t in batch.column(1)]):
                decoded = own.decode(ids.astype(np.int64))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
