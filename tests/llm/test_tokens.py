"""Token ids, Re-Pair shards, segment-tree BPE, packing: against the library and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voltlake.llm import bpe_tree, pattern_packing, repair_shards, slices, token_ids
from voltlake.llm.checks import vocabulary

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
ALPHABET = [*" \n\t  abcABC'12.,é漢  \r字̈🙂\x1c\x85ΣİÁ\u2001\u3000", "'s", "'ll", "<|endoftext|>", " <|endoftext|>", "<|startoftext|>", ".\n", ". "]


def library(path):
    own = Tokenizer.from_file(path)
    own.no_padding()
    own.no_truncation()
    return own


def mixtures(n, size=30):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_word_ids_equal_the_library():
    texts = [*mixtures(4000), "İ. x", "a" * 40 + ", " + "b" * 17, ""]
    expected = [e.ids for e in library(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in token_ids.Ids(WORD).encode(texts)] == expected


def test_words_of_letters_skip_the_normalizer_and_keep_their_ids(monkeypatch):
    """Every letter up to U+00FF, in both cases, beside others; the model alone gets the words of such letters."""
    letters = [chr(c) for c in range(256) if chr(c).isalpha()]
    rng = random.Random(3)
    words = [*letters, *(a + b for a in "aZ" for b in letters), *("".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(4000))]
    words += ["n\u0303o", "\u0130stanbul", "\u0178", "\u03a3\u03c3", "\u00d7\u00f7", "a1", "don't", "'s", "\ufb01n", "\u01c4"]
    own, whole = token_ids.Ids(WORD), library(WORD)
    seen = []
    monkeypatch.setattr(own, "_encoded", lambda tokenizer, part: seen.append((tokenizer is own.model, list(part))) or token_ids.Ids._encoded(tokenizer, part))
    got = own._library([word.encode() for word in words])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [whole.encode(word, add_special_tokens=False).ids for word in words]
    assert sum(len(part) for by_model, part in seen if by_model) == len(words) - 10
    assert own._library([]) == []


def test_words_with_marks_behind_need_the_model_alone(monkeypatch):
    """Letters with any ASCII marks behind them keep their ids, and the normalizer gets none of them."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    rng = random.Random(5)
    words = [f"{word}{mark}" for word in ("a", "Zo", "\xe9", "ma\xdf", "\xc9T\xc9") for mark in [*marks, "&&&", ".###", "'.", ".'", "<|", "|>", "</"]]
    words += ["".join(rng.choices("abS\xe9\xd6", k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.randint(1, 4))) for _ in range(4000)]
    own, whole = token_ids.Ids(WORD), library(WORD)
    plain = []
    monkeypatch.setattr(own, "_encoded", lambda tokenizer, part: plain.extend(part if tokenizer is own.tokenizer else []) or token_ids.Ids._encoded(tokenizer, part))
    got = own._library([word.encode() for word in words])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [whole.encode(word, add_special_tokens=False).ids for word in words]
    assert plain == []


def test_slices_are_told_apart_where_many_share_a_place():
    """More distinct slices than a short table has room for, beside repeats and long ones."""
    rng = random.Random(9)
    words = ["".join(rng.choices("ab", k=rng.randint(1, 20))).encode() for _ in range(5000)]
    ends = np.cumsum([len(word) for word in words])
    found, place = slices.distinct(b"".join(words), ends - [len(word) for word in words], ends)
    assert [found[at] for at in place] == words and len(set(found)) == len(found)


def test_full_caches_change_nothing(monkeypatch):
    texts = mixtures(600)
    monkeypatch.setattr(token_ids, "CACHE", 5)
    monkeypatch.setattr(token_ids, "SECTION", 60)
    monkeypatch.setattr(bpe_tree, "CACHE", 5)
    expected = [e.ids for e in library(WORD).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in token_ids.Ids(WORD).encode(texts)] == expected
    expected = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids, _ in bpe_tree.Encoder(BYTE).encode_batch(texts)] == expected


def test_byte_ids_equal_the_library_and_decode():
    own, texts = bpe_tree.Encoder(BYTE), mixtures(4000)
    for (ids, listed), encoding, text in zip(own.encode_batch(texts), library(BYTE).encode_batch(texts, add_special_tokens=False), texts):
        assert ids.tolist() == encoding.ids and listed == ",".join(map(str, encoding.ids))
        assert own.decode(ids.astype(np.int64)) == text


@pytest.mark.parametrize("long", [3, 10_000])
def test_long_words_go_through_either_tree(monkeypatch, long):
    monkeypatch.setattr(bpe_tree, "LONG", long)
    word = "".join(random.Random(3).choice("abcdefgh") for _ in range(900))
    (ids, _), = bpe_tree.Encoder(BYTE).encode_batch([word])
    assert ids.tolist() == library(BYTE).encode(word, add_special_tokens=False).ids


def test_sections_cut_between_chunks():
    text = " ".join(mixtures(50))
    assert "".join(bpe_tree.sections(text, 20)) == text and len(list(bpe_tree.sections(text, 20))) > 10


def test_decode_replaces_broken_bytes():
    own = bpe_tree.Encoder(BYTE)
    ids = np.array([int(own.of_byte[b]) for b in b"a\xe6\xbc b"])
    assert own.decode(ids) == library(BYTE).decode(ids.tolist(), skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=24), min_size=1, max_size=30))
def test_distinct_slices(parts):
    data = b"".join(parts)
    ends = np.cumsum([len(p) for p in parts])
    found, place = slices.distinct(data, ends - [len(p) for p in parts], ends)
    assert sorted(found) == sorted(set(parts)) and [found[i] for i in place] == parts


def test_round_trips(edge, texts, empty):
    own = library(BYTE)
    rows = sorted(map(tuple, bpe_tree.round_trips(edge, BYTE).collect()), key=str)
    expected = []
    for doc_id, text in texts:
        ids = own.encode(text, add_special_tokens=False).ids
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), own.decode(ids, skip_special_tokens=False))]
        expected.append((doc_id, len(ids), *shas))
    assert rows == sorted(expected, key=str)
    assert bpe_tree.round_trips(empty, BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.data())
def test_grammar_round_trip_and_random_access(ids, data):
    grammar = repair_shards.compress(np.array(ids, dtype=np.uint32), 5, least=2)
    assert grammar.tokens(0, len(ids)).tolist() == ids
    start = data.draw(st.integers(0, len(ids)))
    stop = data.draw(st.integers(start, len(ids)))
    assert grammar.tokens(start, stop).tolist() == ids[start:stop]
    assert grammar.symbol_lengths(grammar.sequence).sum() == len(ids)


def test_repetition_is_compressed():
    ids = np.tile(np.arange(50), 400)
    grammar = repair_shards.compress(ids, 50)
    assert len(grammar.sequence) < len(ids) / 20 and (grammar.expand(grammar.sequence) == ids).all()
    assert (repair_shards.from_planes(repair_shards.planes(grammar.sequence)) == grammar.sequence).all()


def most_places(grammar):
    return max(Counter(zip(grammar.sequence.tolist(), grammar.sequence[1:].tolist())).values(), default=0)


@pytest.mark.parametrize("seed", range(6))
def test_rounds_go_on_until_no_pair_is_frequent(seed):
    # Frequent words among rare ones: late rounds shorten the sequence by little. Runs of one id overlap themselves.
    rng = np.random.default_rng(seed)
    ids = np.minimum(rng.zipf(1.2, 60_000), 40_000)
    ids[rng.random(len(ids)) < 0.1 * seed] = 3
    grammar = repair_shards.compress(ids, 40_001)
    assert most_places(grammar) < repair_shards.LEAST
    assert (grammar.expand(grammar.sequence) == ids).all()


def test_pairs_that_share_a_hash_or_overlap_are_replaced():
    for ids in ([1, 2, 3] * 8, [1] * 9, [0, 1] * 8, [1, 1, 2, 2] * 8, [*range(400)] + [7, 8, 9, 7] * 9):
        assert most_places(repair_shards.compress(np.array(ids), 400)) < repair_shards.LEAST


def test_shards(spark, edge, texts, empty, monkeypatch):
    monkeypatch.setattr(repair_shards, "SHARD", 40)
    path = repair_shards.shared_dir(spark)
    rows = repair_shards.encoded(edge, WORD, path).collect()
    own, at, expected = library(WORD), 0, []
    for doc_id, text in sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0, t[1])):
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        expected.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected
    # The files themselves are in order, and any token can be reached.
    files = sorted((r.asDict() for r in spark.read.parquet(path).collect()), key=lambda r: (r["part"], r["shard"]))
    ordered = [d for row in files for d, _, _ in repair_shards.documents_of(row)]
    assert ordered == [e[0] for e in expected]
    row = max(files, key=lambda r: r["n_tokens"])
    whole = repair_shards.grammar_of(row).tokens(0, row["n_tokens"])
    assert repair_shards.grammar_of(row).tokens(7, 19).tolist() == whole[7:19].tolist()
    assert repair_shards.encoded(empty, WORD).count() == 0


def check_packing(rows, texts, limit):
    own = library(WORD)
    expected, places = [], defaultdict(list)
    for doc_id, text in texts:
        ids = [*own.encode(text, add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), limit)):
            part = ids[at:at + limit]
            expected.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own_places in places.values():
        at = 0
        for offset, length in sorted(own_places):
            assert offset == at
            at += length
        assert at <= limit
    return len(places), -(-sum(e[3] for e in expected) // limit)


@pytest.mark.parametrize("limit", [2048, 16, 1])
def test_packing(edge, texts, empty, limit):
    frame, rows = (edge, texts) if limit > 1 else (edge.where("doc_id <> 6"), [t for t in texts if t[0] not in (6, None)])
    used, least = check_packing(pattern_packing.packed(frame, WORD, limit).collect(), rows, limit)
    assert used <= least + 2
    assert pattern_packing.packed(empty, WORD, limit).count() == 0


def test_packed_ids(edge):
    for r in pattern_packing.packed(edge, WORD, 64, with_ids=True).collect():
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_every_piece_and_are_nearly_full(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.gamma(1.0 + seed, 300, 20_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    used, total = np.zeros(2049, dtype=int), 0
    for shape, times in pattern_packing.packed_lengths(counts, 2048):
        assert sum(shape) <= 2048
        total += times
        np.add.at(used, list(shape), times)
    least = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))  # no two of the latter fit together
    assert (used == counts).all() and total <= 1.02 * least + 1


@pytest.mark.parametrize("shape, scale", [(4, 300), (9, 76), (2, 500), (30, 23)])
def test_plans_are_never_worse_than_best_fit(shape, scale):
    lengths = np.clip(np.random.default_rng(shape).gamma(shape, scale, 20_000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    plain = pattern_packing._plain(counts, 2048).groups()
    chosen = pattern_packing.packed_lengths(counts, 2048)
    assert sum(times for _, times in chosen) <= sum(times for _, times in plain)
    used = np.zeros(2049, dtype=int)
    for own, times in chosen:
        np.add.at(used, list(own), times)
    assert (used == counts).all()


def test_repeat_counts_fit_an_exact_histogram():
    lengths = np.array([1, 2, 3, 5])
    rows = pattern_packing.patterns(lengths, 8)
    assert sorted(map(tuple, np.sort(np.where(rows < 0, 0, lengths[rows]), axis=1).tolist())) == [(0, 3, 5), (1, 2, 5), (2, 3, 3)]
    x = pattern_packing.repeat_counts(rows, np.array([10.0, 10.0, 7.0, 17.0]))
    fitted = np.zeros(4)
    for row, times in zip(rows, x):
        for p in row[row >= 0]:
            fitted[p] += times
    assert (x >= 0).all() and np.allclose(fitted, [10, 10, 7, 17], atol=1)
