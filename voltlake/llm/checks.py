"""The operators' registered queries, each over its whole table, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voltlake.llm import (
    bpe_tree, digest_index, filter_audit, language_id, line_cleaning, multiset_hash, pattern_packing, radix_repeats,
    repair_shards, secret_scan, simhash, spelling_variants, url_filter,
)

Run = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_shards.encoded(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.packed(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.deduplicated(_table(spark, sf_dir, "documents"), digest_index.new_index(spark))


OP8_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(_table(spark, sf_dir, "documents"))


def op4_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.compared(_table(spark, sf_dir, "documents"))


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.round_trips(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_repeats.deduplicated(_table(spark, sf_dir, "documents"))


# The rules of the query.
RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents").select("text"), RULES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP11_SQL = """WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
fails AS (
  SELECT words.doc_id, part, quality IS NOT DISTINCT FROM 1 AS good, toxic IS NOT DISTINCT FROM 1 AS toxic, map {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), FALSE)} AS f
  FROM words LEFT JOIN labels ON labels.doc_id = words.doc_id),
alike AS (SELECT part, f, good, toxic, count(*) AS n FROM fails GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM l a, l b, l d, l e, l g
  WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
walked AS (
  SELECT part, filter_order, step, f, good, toxic, n, substr(filter_order, step, 1) AS own,
    len(list_filter(string_split(left(filter_order, step - 1), ''), lambda c: c <> '' AND f[c])) > 0 AS earlier
  FROM alike, orders, (SELECT unnest(range(1, 6)) AS step)),
steps AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, own,
    sum(n) FILTER (NOT earlier AND NOT f[own]) AS kept, sum(n) FILTER (NOT earlier AND f[own]) AS removed,
    sum(n) FILTER (earlier AND f[own]) AS redundant,
    sum(n) FILTER (f[own] AND len(list_filter(map_values(f), lambda x: x)) = 1) AS unique_fails,
    sum(n) FILTER (NOT earlier AND f[own] AND good) AS good_lost, sum(n) FILTER (NOT earlier AND f[own] AND toxic) AS toxic_lost
  FROM walked GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM steps"""


def op12_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.judged(_table(spark, sf_dir, "documents"))


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SYMBOL_CLASS = f"[{line_cleaning.SYMBOLS.decode()}]"
OP12_SQL = f"""WITH lines AS (
  SELECT doc_id, line, nth, list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS nth
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
judged AS (
  SELECT doc_id, nth, w, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS again,
    len(list_filter(w, lambda x: list_contains({_quoted(line_cleaning.SEPARATORS)}, x))) AS separators,
    len(list_filter(w, lambda x: regexp_matches(x, '{_SYMBOL_CLASS}'))) AS marked,
    translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS joined
  FROM lines WHERE len(w) > 0),
graded AS (
  SELECT *, CASE
    WHEN separators >= {line_cleaning.SEPARATORS_LEAST} AND 4 * separators >= len(w)
      OR list_contains({_quoted(line_cleaning.CAPTIONS)}, trim(joined, '.!: ')) THEN 'navigation'
    WHEN regexp_matches(joined, '{'|'.join(line_cleaning.NOTICES)}') THEN 'boilerplate'
    WHEN {line_cleaning.SYMBOL_WORDS} * marked > len(w)
      OR len(w) >= {line_cleaning.LONG_LINE} AND NOT regexp_matches(line, '[{line_cleaning.MARKS}]') THEN 'punctuation' END AS fault
  FROM judged),
totals AS (
  SELECT doc_id, sum(len(w)) AS n_words, sum(list_sum(list_transform(w, lambda x: length(x)))) AS word_chars,
    count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fault = 'navigation') AS n_navigation,
    count(*) FILTER (fault = 'boilerplate') AS n_boilerplate, count(*) FILTER (fault = 'punctuation') AS n_punctuation,
    sum(len(w)) FILTER (fault IS NOT NULL) AS n_lost_words
  FROM graded GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS word, nth, generate_subscripts(w, 1) AS place FROM judged),
grams AS (
  SELECT doc_id, nth, place, [word, lead(word, 1) OVER o, lead(word, 2) OVER o] AS gram, lead(word, 2) OVER o IS NOT NULL AS whole
  FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY nth, place)),
twice AS (SELECT doc_id, nth, place, whole AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS hit FROM grams),
covered AS (
  SELECT doc_id, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY nth, place ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM covered GROUP BY doc_id),
measured AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^{line_cleaning.SYMBOLS.decode()}]+', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_navigation, 0) AS n_navigation, coalesce(n_boilerplate, 0) AS n_boilerplate,
    coalesce(n_punctuation, 0) AS n_punctuation, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM documents d LEFT JOIN totals t ON t.doc_id = d.doc_id LEFT JOIN repeats r ON r.doc_id = d.doc_id)
SELECT *, n_words < {line_cleaning.FEWEST} OR 100 * n_repeat_words > {line_cleaning.REPEATED} * n_words AS base_failed,
  NOT base_failed AND 100 * n_lost_words <= {line_cleaning.LOSS} * n_words AS kept
FROM measured"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(_table(spark, sf_dir, "documents"))


# CRC-32 by its polynomial, a bit at a time: DuckDB has no function for it.
_BIT = "xor({0} >> 1, 3988292384 * ({0} & 1))"


def _crc_byte(value: str) -> str:
    for i in range(8):
        value = f"list_transform([{value}], lambda b{i}: {_BIT.format(f'b{i}')})[1]"
    return value


OP13_SQL = f"""WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(octet_length(s) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE CAST('0x' || substr(x, CAST(2 * i - 1 AS INT), 2) AS BIGINT) END),
    lambda c, b: xor(c >> 8, {_crc_byte('xor(c, b) & 255')}))) AS h
  FROM (SELECT run, n, encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS s, hex(s) AS x FROM runs)),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
cuts AS (SELECT word, n, i, left(word, i - 1) || '?' || substr(word, i + 1) AS form, left(word, i - 1) || substr(word, i + 1) AS rest FROM gaps),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.form = b.form AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(d := -n, w := near)) AS top FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.d >= 2 * w.n THEN top.w END AS form,
    CASE WHEN -top.d >= 2 * w.n THEN -top.d END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word),
chain AS (
  SELECT word, word AS nth FROM formed
  UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.nth WHERE formed.form IS NOT NULL)
SELECT formed.word, formed.form, chain.nth AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN chain ON chain.word = formed.word JOIN formed last ON last.word = chain.nth AND last.form IS NULL"""


QUERIES: dict[str, Run] = {
    "op1_repair_shards": op1_repair_shards,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_multiset_hash": op4_multiset_hash,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_bpe_tree": op7_bpe_tree,
    "op8_digest_index": op8_digest_index,
    "op9_radix_repeats": op9_radix_repeats,
    "op10_url_filter": op10_url_filter,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_cleaning": op12_line_cleaning,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op8_digest_index": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_line_cleaning": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
