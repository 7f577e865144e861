"""Filter audit, line cleaning, spelling variants: against plain loops."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import connect, differences
from voltlake.llm import checks, filter_audit, line_cleaning, spelling_variants

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- filter audit


def plain_fails(text, is_copy):
    words = words_of(text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": is_copy,
    }


def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); labels: id -> (good, toxic). Walks every order over every document."""
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    parts = {}
    for doc_id, text, lang in docs:
        copy = doc_id is not None and doc_id > least[text or ""]
        parts.setdefault(lang or "", []).append((plain_fails(text or "", copy), *labels.get(doc_id, (False, False))))
    rows = {}
    for part, members in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(members)
            for step, name in enumerate(order, 1):
                gone = [m for m in left if m[0][name]]
                left = [m for m in left if not m[0][name]]
                shapley[name] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(m[0][name] for m in members) - len(gone),
                    sum(m[0][name] and sum(m[0].values()) == 1 for m in members),
                    sum(m[1] for m in gone), sum(m[2] for m in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return rows


def as_rows(frame):
    return {(r["part"], r["filter_order"], r["step"]): [
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] for r in frame.collect()}


def test_audit_of_edge_rows(make, edge, empty):
    labels = make("doc_id long, quality int, toxic int, lang string, extra int", [
        (4, 1, 0, "zz", 1), (5, 1, 1, None, 1), (5, 0, 0, None, 1), (6, None, 1, None, 1), (None, 1, 1, None, 1), (13, 1, None, None, 1), (99, 1, 1, None, 1)])
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in edge.collect()]
    known = {4: (True, False), 5: (True, True), 6: (False, True), 13: (True, False)}
    frame = filter_audit.audited(edge, labels)
    assert frame.columns == [c.split()[0] for c in filter_audit.STEPS.split(", ")]
    assert as_rows(frame) == plain_audit(docs, known)
    assert filter_audit.audited(empty, labels).count() == 0
    assert as_rows(filter_audit.audited(edge, labels.where("false"))) == plain_audit(docs, {})


def test_audit_of_random_documents(make):
    rng = random.Random(11)
    texts = ["", "A B C", "x " * 250, "| menu", "LOUD WORDS HERE"] + [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (150, 220, 400)]
    texts += [t + " #" for t in texts]
    docs = [(None if rng.random() < 0.05 else rng.randrange(-50, 400), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(500)]
    known = {i: (rng.random() < 0.5, rng.random() < 0.3) for i in range(0, 400, 2)}
    labels = [(i, int(g), int(t)) for i, (g, t) in known.items()]
    frame = filter_audit.audited(make("doc_id long, text string, lang string", docs), make("doc_id long, quality int, toxic int", labels))
    assert as_rows(frame) == plain_audit(docs, known)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6).flatmap(lambda k: st.tuples(st.just(k), st.lists(st.integers(0, 9), min_size=1 << k, max_size=1 << k))))
def test_potentials_give_the_sum_over_all_orders(case):
    k, counts = case
    worth = filter_audit.worths(filter_audit.np.array([counts]))[0].tolist()
    assert worth == [sum(n for mask, n in enumerate(counts) if mask & s) for s in range(1 << k)]
    expected = [0] * k
    for order in permutations(range(k)):
        before = 0
        for i in order:
            expected[i] += worth[before | 1 << i] - worth[before]
            before |= 1 << i
    assert filter_audit.shapley(worth, k) == expected and sum(expected) == factorial(k) * worth[-1]


# ---------------------------------------------------------------- line cleaning


def plain_measures(text):
    text = text or ""
    words = words_of(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if words_of(line)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), failed)


def measures(v):
    return v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed


PROSE = "The first line of this text is plain prose, and it ends with a full stop as prose does."


@pytest.mark.parametrize("line, reason", [
    ("Home | News | Sport | Contact", "navigation"), ("home » news » sport » today", "navigation"), ("Read  more", "navigation"),
    ("Back to top.", "navigation"), ("Released under the MIT License.", "boilerplate"), ("We use Cookies on this site.", "boilerplate"),
    ("word### other*** third$$$ is. noisy", "punctuation"), ("one two three four five six seven eight", "punctuation"),
    ("one two three four five six seven", None), (PROSE, None), ("A price of $5 is named in one of these more than ten words here.", None),
    ("a - b is a dash.", None), ("漢字の文が一つだけここにある。", None),
])
def test_line_faults(line, reason):
    data = line.encode()
    assert line_cleaning.fault(data, data.split()) == reason


def test_cleaned_texts():
    menu = "Home | News | Sport | Contact"
    body = [" ".join(f"word{i}x{j}" for j in range(15)) + "." for i in range(5)]
    kept = line_cleaning.cleaned_text("\n".join([menu, *body, "", "All rights reserved."]))
    assert kept.kept and kept.clean_text == "\n".join([*body, ""]) and kept.n_lost_words == 7 + 3
    assert (kept.n_navigation, kept.n_boilerplate, kept.n_punctuation) == (1, 1, 0)
    lost = line_cleaning.cleaned_text("\n".join([f"h{i} | n{i} | s{i} | c{i}" for i in range(12)] + body[:1]))
    assert not lost.base_failed and not lost.kept
    # at the border: 30 of 100 words may go, 31 may not
    words = [f"w{i}" for i in range(100)]
    at = line_cleaning.cleaned_text(" ".join(words[:70]) + ".\n" + " ".join(words[70:]))
    over = line_cleaning.cleaned_text(" ".join(words[:69]) + ".\n" + " ".join(words[69:]))
    assert at.n_lost_words == 30 and at.kept and over.n_lost_words == 31 and not over.kept


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é", "漢", "#x", "|", "<b>", " ", "\n", "\t", "\x0b", "\xa0", "\r"]), max_size=200).map(" ".join))
def test_measures_of_random_texts(text):
    assert measures(line_cleaning.cleaned_text(text)) == plain_measures(text)


def test_line_cleaning_of_edge_rows(edge, texts, empty):
    rows = line_cleaning.judged(edge).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == Counter((doc_id, *plain_measures(text)) for doc_id, text in texts)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert line_cleaning.judged(empty).count() == 0 and line_cleaning.filtered(empty).count() == 0
    with_text = line_cleaning.judged(edge, with_text=True)
    assert {r["doc_id"]: r["clean_text"] for r in with_text.collect()}[9] == "The cat sat. The dog ran.\nA line\nA line"


def test_filtered_documents_keep_their_columns(edge):
    wide = edge.withColumn("_verdict", F.lit("own")).withColumn("text", F.when(F.col("doc_id") == 7, F.concat(F.lit("Home | A | B | C\n"), "text")).otherwise(F.col("text")))
    kept = line_cleaning.filtered(wide)
    assert kept.columns == wide.columns
    by_id = {r["doc_id"]: r for r in kept.collect()}
    assert 7 in by_id and not by_id[7]["text"].startswith("Home") and by_id[7]["_verdict"] == "own" and 4 not in by_id


# ---------------------------------------------------------------- spelling variants


def plain_words(docs, least_length=5, least_count=3, every=97):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_length and n >= least_count}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words, factor=2):
    near_of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    rows = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, words[w], len(near_of[w]), words[form[w]] if form[w] else None))
    return rows


def grouped_rows(frame):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def test_variants_of_edge_rows(edge, empty):
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert grouped_rows(spelling_variants.grouped(edge)) == plain_groups(plain_words(docs))
    assert spelling_variants.grouped(empty).count() == 0


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abé", 2), ("aÀ×ÿ", 3)])
def test_variants_of_dense_vocabularies(make, letters, seed):
    """Few letters: runs of equal letters, long chains of forms, full groups."""
    rng = random.Random(seed)
    docs = []
    for i in range(120):
        words = ["".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 6, 7]))) for _ in range(rng.choice([5, 40]))]
        docs.append((i if i % 9 else None, " ".join(w.title() if rng.random() < 0.1 else w for w in words) + "-" + words[0] * 2))
    words = plain_words(docs, every=5)
    assert len(words) > 50
    got = spelling_variants.grouped(make("doc_id long, text string", docs), every=5)
    assert grouped_rows(got) == plain_groups(words)


def test_chains_of_forms(make):
    words = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "bbbbbb": 63, "ccccc": 5}
    formed = make("word string, form string", [("aaaaa", "aaaab"), ("aaaab", "aaabb"), ("aaabb", "aabbb"), ("aabbb", "abbbb"), ("abbbb", "bbbbb"), ("bbbbb", None), ("ccccc", None)])
    roots = {r["word"]: r["root"] for r in spelling_variants.with_roots(formed).collect()}
    assert roots == {w: ("ccccc" if w == "ccccc" else "bbbbb") for w in roots}
    frame = make("word string, n long", list(words.items()))
    got = {r["word"]: (r["n_near"], r["near"], r["near_n"]) for r in spelling_variants.near_words(frame).collect()}
    assert got["bbbbb"] == (2, "bbbbbb", 63) and got["ccccc"] == (0, None, None) and got["abbbb"] == (2, "bbbbb", 32)


def test_a_word_meets_its_neighbours_without_pairs(make):
    """All words of five letters that differ from 'aaaaa' at one place: each group has one row a letter."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {"aaaaa"[:i] + c + "aaaaa"[i + 1:] for i in range(5) for c in letters}
    rows = spelling_variants.rotations(make("word string, n long", [(w, 3) for w in words]))
    assert rows.count() == sum(2 * len(w) + 1 for w in words)
    assert rows.groupBy("prefix").count().agg(F.max("count")).first()[0] <= len(letters) + 1
    got = {r["word"]: r["n_near"] for r in spelling_variants.near_words(make("word string, n long", [(w, 3) for w in words])).collect()}
    assert got == {w: sum(near(w, v) for v in words) for w in words}


# ---------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_line_cleaning", "op13_spelling_variants"])
def test_query_equals_sql(spark, name):
    assert differences(checks.QUERIES[name](spark, SF), connect(SF), checks.ORACLE_SQL[name]) == []
