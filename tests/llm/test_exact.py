"""Digest index, multiset hash, repeated strings: against plain loops."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltlake.llm import digest_index, multiset_hash, radix_repeats
from voltlake.llm.common import shared_dir


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digest_index_groups(spark, edge, texts, empty):
    rows = digest_index.deduplicated(edge, digest_index.new_index(spark)).collect()
    by_text = {}
    for doc_id, text in texts:
        by_text.setdefault(text, []).append(doc_id)
    expected = []
    for doc_id, text in texts:
        known = [d for d in by_text[text] if d is not None]
        keep = max(known) if known else None
        expected.append((doc_id, keep, len(by_text[text]), doc_id == keep, sha(text)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(expected, key=key)
    assert digest_index.deduplicated(empty, digest_index.new_index(spark)).count() == 0


def test_digest_index_takes_batches(spark, edge):
    index = digest_index.new_index(spark)
    first = digest_index.deduplicated(edge.where("doc_id <= 4"), index).count()
    later = {r["doc_id"]: r for r in digest_index.deduplicated(edge.where("doc_id > 4"), index).collect()}
    assert first == 5 and not later[5]["kept"] and later[5]["keep_id"] == 4 and later[6]["kept"]
    texts = {r["text"] or "" for r in edge.where("doc_id is not null").collect()}
    assert index.table().count() == index.table().distinct().count() == len(texts)
    again = digest_index.DigestIndex(spark, index.path, index.name + "_reopened", index.buckets)
    assert again.table().count() == len(texts)  # the files are all there is to it


def test_anti_join_reads_the_index_without_a_shuffle(spark, edge):
    index = digest_index.new_index(spark)
    digest_index.deduplicated(edge, index)
    batch = digest_index.digests(edge).distinct().repartition(index.buckets, "digest")
    plan = batch.hint("merge").join(index.table(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange hashpartitioning") <= 2  # distinct and repartition of the batch


def test_distinct_documents_keep_all_columns(spark, edge, empty):
    kept = digest_index.distinct_documents(edge, digest_index.new_index(spark))
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "3", "5", "6", "7", "8", "9", "10", "11", "12", "13", "None"])
    assert digest_index.distinct_documents(empty, digest_index.new_index(spark)).count() == 0


def test_multiset_hash_edits(edge, texts, empty):
    rows = multiset_hash.compared(edge).collect()
    order = sorted(texts, key=lambda t: (t[0] is None, -(t[0] or 0), t[1]))
    expected = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        third = len(text) // 3
        expected.append((doc_id, len(text), sha(text[:len(text) - third] + after[:third])))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == Counter(expected)
    prints = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[4] == prints[5] == prints[-4] and prints[1] == prints[2] != prints[4]
    assert multiset_hash.compared(empty).count() == 0


def hashed(text, *more):
    """Spark's 64-bit hash: the text's XXH64 with seed 42, then each number's with the hash so far as seed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    for number in more:
        h = xxhash.xxh64_intdigest(struct.pack("<I", number), h)
    return h


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def plain_cut(units, glue):
    ends = [u + "\n" * (signed(hashed(u)) % multiset_hash.PICKED == 0 and (i + 1 == len(units) or units[i + 1] != u)) for i, u in enumerate(units)]
    return glue.join(ends)


def plain_paragraphs(text):
    out = []
    for line in re.split(r"\n+|(?<=[.!?…।؟۔])[ \t\n\x0b\f\r]+|(?<=[。！？｡])", text):
        line = line.strip(" ")
        if len(line) > multiset_hash.LONG:
            words = re.split(r"[ \t\n\x0b\f\r]+", line)
            words = [plain_cut(list(w), "") if len(w) > multiset_hash.LONG else w for w in words]
            out += plain_cut(words, " ").split("\n")
        else:
            out.append(line)
    return [p.strip(" ") for p in out if p.strip(" ")]


def plain_vector(text):
    """Number of paragraphs, and 64 lanes: sums of the bytes of eight hashes of every paragraph."""
    found = plain_paragraphs(text)
    lanes = [0] * 64
    for paragraph in found:
        for j in range(8):
            for byte, value in enumerate(struct.pack("<Q", hashed(paragraph, j + 1))):
                lanes[8 * j + byte] += value
    return len(found), lanes


def as_stored(n, lanes):
    """The count, then pairs of lanes as 64-bit numbers: of each hash bytes 4 and 0, 6 and 2, 5 and 1, 7 and 3."""
    pairs = [lanes[8 * j + high] << 32 | lanes[8 * j + low] for j in range(8) for high, low in ((4, 0), (6, 2), (5, 1), (7, 3))]
    return f"{n:016x}" + "".join(f"{p:016x}" for p in pairs)


def plain_likeness(a, b):
    a, b = plain_vector(a), plain_vector(b)
    if a == b:
        return 1.0
    x, y = ([v - 127.5 * n for v in lanes] for n, lanes in (a, b))
    size = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return max(0.0, min(1.0, sum(v * w for v, w in zip(x, y)) / size)) if size else 0.0


def test_vectors_and_likeness_against_plain_loops(make):
    rng = random.Random(3)
    texts = ["", "short", "漢字の文。" * 40, "word " * 60, "one\n\n two  three\tfour " * 9, "a. b! c? d… e。f", "x" * 200]
    texts += [" ".join(rng.choice(["alpha", "beta,", "gamma.", "delta", "Ω", "line\nend"]) + str(rng.randrange(9)) for _ in range(n)) for n in (3, 20, 90, 400, 4000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in multiset_hash.compared(make("doc_id long, text string", rows)).collect()}
    for i, text in rows:
        after = texts[i - 1]  # descending ids, the last after the first
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        for name, of in (("fingerprint", text), ("edited_fingerprint", edited)):
            assert got[i][name] == as_stored(*plain_vector(of))
        assert math.isclose(got[i]["near_edited"], plain_likeness(text, edited), abs_tol=1e-9)
        assert math.isclose(got[i]["near_next"], plain_likeness(text, after), abs_tol=1e-9)


def test_likeness_is_graded_for_every_kind_of_text(spark, make):
    chinese = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(900))
    rows = [(1, " ".join(f"w{i}" for i in range(900))), (2, chinese), (3, "。".join(f"漢字文{i}章" for i in range(90))), (0, " ".join(f"z{i}" for i in range(900)))]
    for r in multiset_hash.compared(make("doc_id long, text string", rows)).collect():
        assert 0.25 < r["near_edited"] < 0.98 and r["near_next"] < 0.4  # two thirds and nothing, give or take 1/8
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long_enough = docs.where(F.size(F.split("text", r"\s+")) >= 20).select("doc_id")
    near = [r[0] for r in multiset_hash.compared(docs).join(long_enough, "doc_id").select("near_edited").collect()]
    assert sum(v < 0.3 for v in near) < 0.02 * len(near)  # 80 of 1,000 when sentences were the least paragraphs


def test_single_document_is_its_own_next(make):
    row = multiset_hash.compared(make("doc_id long, text string", [(1, "abc def")])).collect()[0]
    assert row["near_next"] == 1.0 and row["edited_sha256"] == sha("abc dab")


def test_multiset_hash_is_homomorphic(make):
    frame = make("a string, b string, ab string, ba string", [("One.\nTwo.", "Three. Four", "One.\nTwo.\nThree.\nFour", "Four\nThree. Two.\nOne.")])
    v = {c: multiset_hash.vector(F.col(c)) for c in frame.columns}
    row = frame.select(
        multiset_hash.combined(v["a"], v["b"]).alias("sum"), v["ab"].alias("ab"), v["ba"].alias("ba"),
        multiset_hash.removed(v["ab"], v["b"]).alias("less"), v["a"].alias("a")).first()
    assert row["sum"] == row["ab"] == row["ba"] and row["less"] == row["a"]


def test_range_buckets_ascend(spark):
    frame = spark.range(1000).selectExpr("case when id < 400 then 7 else id end doc_id")
    bucket = multiset_hash.range_bucket(frame, "doc_id", 20)
    spans = frame.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("b").collect()
    assert len(spans) > 5 and all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


def brute_repeats(texts, depth):
    count = Counter(t[i:i + depth] for t in texts for i in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if count[t[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [50_000, 1])
def test_repeated_strings(edge, texts, empty, split):
    rows = radix_repeats.deduplicated(edge, split=split).collect()
    expected = Counter((t[0], *e) for t, e in zip(texts, brute_repeats([t[1].encode() for t in texts], 200)))
    assert Counter(map(tuple, rows)) == expected
    assert any(r["n_removed"] for r in rows)
    assert radix_repeats.deduplicated(empty, split=split).count() == 0


def test_runs_of_a_frequent_digit_spread(spark):
    # Digit 7 has 3,000 runs, every tenth of them twice; the other digits have one or two each.
    runs = spark.range(3300).selectExpr(
        "7L as digit", "(id % 3000) * 7919 as whole", "id as doc_id", "id as th", "256 as at", "0 as flag").unionByName(
        spark.range(900).selectExpr("id % 600 + 10 as digit", "id as whole", "id as doc_id", "id as th", "256 as at", "0 as flag"))
    runs = runs.selectExpr("digit", "whole", "doc_id", "th", "cast(at as bigint) at", "flag")
    together = Counter(map(tuple, radix_repeats._settled(runs).collect()))
    spread = radix_repeats._settled(runs, split=100)
    where = Counter(r["p"] for r in spread.withColumn("p", F.spark_partition_id()).where("digit = 7").collect())
    assert len(where) >= 3 and max(where.values()) < 1500
    counts = lambda rows: Counter((d, k) for _, _, _, d, k in rows.elements())
    assert counts(Counter(map(tuple, spread.collect()))) == counts(together)
    assert counts(together)[7, radix_repeats.WITNESS] == 300 and counts(together)[7, radix_repeats.OPEN] == 2700


def test_periodic_texts_and_section_ends(make, monkeypatch):
    base = "ab" * 300 + "".join(chr(97 + (i * i) % 26) for i in range(900)) + "q" * 500
    rows = [(i, base[i * 37:] + str(i)) for i in range(12)] + [(90, base), (91, base)]
    frame = make("doc_id long, text string", rows)
    got = {r["doc_id"]: tuple(r)[1:] for r in radix_repeats.deduplicated(frame).collect()}
    expected = dict(zip([r[0] for r in rows], brute_repeats([r[1].encode() for r in rows], 200)))
    assert got == expected


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=60), max_size=6), st.integers(9, 20))
def test_digit_passes_find_equal_strings(parts, depth):
    import numpy as np

    data = "|".join(parts).encode()
    at = np.arange(max(len(data) - depth + 1, 0))
    found = radix_repeats.repeated_suffixes(np.zeros(len(at)), radix_repeats.eight_bytes(data), at, depth)
    count = Counter(data[i:i + depth] for i in at.tolist())
    assert found.tolist() == [count[data[i:i + depth]] > 1 for i in at.tolist()]


def test_runs_depend_on_their_bytes_alone():
    shared = bytes((i * 7919) % 251 for i in range(1000))
    a = {x[0] - 50: x for x in zip(*radix_repeats.runs(b"x" * 50 + shared + b"y" * 70))}
    b = {x[0] - 300: x for x in zip(*radix_repeats.runs(b"zz" * 150 + shared + b"w" * 9))}
    common = set(a) & set(b)
    assert len(common) > 5 and sum(n for *_, n in zip(*radix_repeats.runs(shared))) == 801


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(spark) != shared_dir(spark)


def test_registered_sql_agrees(spark):
    from compare import connect, differences
    from voltlake.llm import checks

    sf = "/root/testdata/sf0.001"
    for name, sql in checks.ORACLE_SQL.items():
        assert differences(checks.QUERIES[name](spark, sf), connect(sf), sql) == []
