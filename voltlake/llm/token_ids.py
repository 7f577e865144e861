"""Token ids by the tokenizers library for a vocabulary that drops white space, each distinct word encoded once.

Such a pre-tokenizer never joins characters across white space, so texts are cut at white space, the distinct
pieces of a section of text are found in numpy, and those that a bounded cache lacks go to the library
together. A mark behind a letter is a piece of its own, as it is to the pre-tokenizer, and a capital in front
of small letters is a small one, as it is to the normalizer.

A piece of letters up to U+00FF alone is one word to the pre-tokenizer, and the normalizer makes its letters small
and changes nothing else. Where the vocabulary has just these two, the library's model gets such a piece as small
letters in the byte alphabet, without its normalizer and pre-tokenizer, which cost more than the model. ASCII marks
behind such letters are one more word each time.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice
from operator import attrgetter

import numpy as np

from voltlake.llm import slices

#: Pieces kept by a Python worker; beyond it the later half goes (common words come early), which changes no result.
CACHE = 1_150_000
#: Characters whose pieces are looked up together.
SECTION = 1 << 21
_MARK = np.isin(np.arange(256), list(b",.;:!?"))
# White space of the vocabulary's pattern beyond ASCII. U+001C to U+001F are none, other than for str.split().
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_SMALL_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# The byte alphabet: printable bytes of Latin-1 stand for themselves, the others in order for U+0100 and up.
_OTHERS = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_ALPHABET = {b: 256 + i for i, b in enumerate(_OTHERS)}
# Small letters up to U+00FF beyond ASCII; what an earlier one becomes holds no later one.
_SPELLED = {c: c.encode().decode("latin-1").translate(_ALPHABET) for c in map(chr, range(128, 256)) if c.isalpha() and c == c.lower()}


def _of_letters(word: str) -> bool:
    """Whether a word has only letters that are composed already and have small letters of the same range."""
    return word.isalpha() and (word.isascii() or max(word) <= "\xff")


def _split(word: str) -> tuple[str, str]:
    """The word without the ASCII marks at its end, and these; the pre-tokenizer cuts there if letters come before."""
    head = word if word.isalpha() else word.rstrip(string.punctuation)
    return head, word[len(head):]


def _spelled(words: list[str]) -> list[str]:
    """Words of letters as small letters in the byte alphabet."""
    text = "\n".join(words).lower()
    for letter, spelled in _SPELLED.items():
        text = text.replace(letter, spelled)
    return text.split("\n") if words else []


def trim(known: dict, size: int) -> None:
    """Forget the later half of a cache of more than `size` keys; common ones come early."""
    if len(known) > size:
        for key in list(islice(known, size // 2, None)):
            del known[key]


def pieces_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the pieces in UTF-8 bytes; capitals in front of ASCII letters are made small in `data`.

    A cut between an ASCII letter and the mark that ends its piece changes no id: nothing composes across it.
    """
    held = np.zeros(len(data) + 2, dtype=bool)
    held[1:-1] = ~slices.spaces(data)
    edges = np.flatnonzero(held[1:] != held[:-1])
    starts, ends = edges[::2], edges[1::2]
    small = data | 32
    letter = (small >= 97) & (small <= 122)
    marked = _MARK[data[ends - 1]] & letter[np.maximum(ends - 2, 0)] & (ends - starts > 1)
    cut = ends[marked] - 1
    # The pieces lie apart, so sorting starts and ends by themselves keeps them together.
    starts = np.sort(np.concatenate([starts, cut]))
    ends = np.sort(np.concatenate([ends - marked, cut + 1]))
    capital = np.flatnonzero((data[starts] >= 65) & (data[starts] <= 90))
    upto = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(letter, out=upto[1:])
    first, end = starts[capital], ends[capital]
    words = first[upto[end] - upto[first] == end - first]
    data[words] |= 32
    return starts, ends


class Model:
    """The library's model of a tokenizer alone, which gets one word at a time and makes no offsets for a text."""

    def __init__(self, tokenizer):
        self.model = tokenizer.model

    def encoded(self, words: list[str]) -> Iterator[bytes]:
        tokenize, number = self.model.tokenize, attrgetter("id")
        for word in words:
            yield array("I", map(number, tokenize(word))).tobytes()


class Ids:
    """Encoder of one vocabulary file, without truncation, padding and special tokens around a text."""

    def __init__(self, path: str, cache: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self._model()
        self.known: dict[bytes, bytes] = {}
        self.cache = cache

    def _model(self) -> Model | None:
        """The model alone, for pieces of letters and marks behind them; None where normalizer or pre-tokenizer do more."""
        layout = json.loads(self.tokenizer.to_str())
        whole = all(layout[part] == wanted for part, wanted in _SMALL_WORDS.items())
        # An added token in a piece of letters and marks would be of these itself.
        heads = [_split(token["content"])[0] for token in layout["added_tokens"]]
        return Model(self.tokenizer) if whole and not any(not head or _of_letters(head) for head in heads) else None

    def _library(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (no white space) as little-endian unsigned 32-bit integers."""
        texts = b"\n".join(words).decode().split("\n") if words else []
        parts = list(map(_split, texts))
        of_letters = [_of_letters(head) for head, _ in parts] if self.model is not None else [False] * len(texts)
        marks = list({tail for (_, tail), letters in zip(parts, of_letters) if letters and tail})
        marked = {"": b""} | dict(zip(marks, self._encoded(self.model, marks)))
        by_model = self._encoded(self.model, _spelled([head for (head, _), letters in zip(parts, of_letters) if letters]))
        by_all = self._encoded(self.tokenizer, [text for text, letters in zip(texts, of_letters) if not letters])
        return [next(by_model) + marked[tail] if letters else next(by_all) for (_, tail), letters in zip(parts, of_letters)]

    @staticmethod
    def _encoded(tokenizer, words: list[str]) -> Iterator[bytes]:
        if isinstance(tokenizer, Model):
            yield from tokenizer.encoded(words)
            return
        for at in range(0, len(words), 10_000):
            part = words[at:at + 10_000]
            encoded = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            flat = np.array(encoded.ids, dtype="<u4").tobytes()
            counts = np.bincount(np.array(encoded.word_ids, dtype=np.int64), minlength=len(part))
            ends = (np.cumsum(counts) * 4).tolist()
            yield from (flat[begin:end] for begin, end in zip([0, *ends], ends))

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text in order, as little-endian unsigned 32-bit integers."""
        group: list[bytes] = []
        held = 0
        for text in texts:
            group.append((text if text.isascii() else _WIDE.sub(" ", text)).encode())
            held += len(text)
            if held >= SECTION:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, group: list[bytes]) -> Iterator[bytes]:
        data = b" ".join([*group, b""])
        own = np.frombuffer(data, dtype=np.uint8).copy()
        starts, ends = pieces_of(own)
        found, place = slices.distinct(own.tobytes(), starts, ends)
        known = self.known
        coded = list(map(known.get, found))
        unknown = [i for i, ids in enumerate(coded) if ids is None]
        for i, ids in zip(unknown, self._library([found[i] for i in unknown])):
            coded[i] = known[found[i]] = ids
        ids, upto = slices.gathered(coded, place)
        # Token counts up to each text's last piece.
        texts = np.searchsorted(starts, np.cumsum([len(text) + 1 for text in group]))
        cuts = np.concatenate([[0], upto])[texts].tolist()
        for begin, end in zip([0, *cuts], cuts):
            yield ids[begin:end].tobytes()
        trim(known, self.cache or CACHE)


_encoders: dict[str, Ids] = {}


def encoder(path: str, cache: int | None = None) -> Ids:
    """The worker's encoder of that file, made once; `cache` pieces are kept from now on, by default CACHE."""
    if path not in _encoders:
        _encoders[path] = Ids(path)
    _encoders[path].cache = cache
    return _encoders[path]
