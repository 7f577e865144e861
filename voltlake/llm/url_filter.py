"""URL filter: longest matching rule, else naive Bayes over segmented host names and path tokens.

Word counts of the corpus text give a unigram model. The letter runs of every distinct host are looked up in
it by all their substrings of such lengths as words have (a join, so neither the word list nor the hosts need fit
anywhere whole), and Viterbi picks the split of highest probability. Naive Bayes learns from the pages that a rule decides: words
of the host (without its last label, which the rules name) and tokens of the path. All of it is done for
distinct hosts and distinct (host, path); pages meet their verdict in one join at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import saved, text_or_empty

ALLOW, BLOCK = "allow", "block"
SMOOTHING = 1.0
LETTERS = r"[^\p{L}]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty where it is null or has no `://`."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    begin = F.instr(url, "://")
    after = F.coalesce(F.when(begin > 0, F.substr(url, begin + 3)), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), upper, lower)
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, by characters; null where none does.

    Of equally long ones a blocking rule has precedence, then the first in text order.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == BLOCK, [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the lower-case letter runs in column text, over all rows and of any length."""
    words = texts.select(F.explode(F.split(F.lower(text_or_empty()), LETTERS)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(run: str, known: dict[tuple[int, int], int], total: int) -> list[str]:
    """Viterbi: the split of highest unigram probability; `known` counts the words at (start, length).

    Letters in no word stand alone, each worth a tenth of the rarest word for every such letter. Of equal
    splits the one with the longer last word wins, and so on from the end.
    """
    total = max(total, 1)
    unknown = math.log(0.1 / total)
    score, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
    ending: dict[int, list[int]] = {}
    for start, size in sorted(known):
        ending.setdefault(start + size, []).append(start)
    for end in range(1, len(run) + 1):
        starts = ending.get(end, [])
        for start in starts if end - 1 in starts else [*starts, end - 1]:
            n = known.get((start, end - start), 0)
            value = score[start] + (math.log(n / total) if n else unknown)
            if value > score[end]:
                score[end], back[end] = value, start
    words, end = [], len(run)
    while end:
        words.append(run[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) of the distinct letter runs in `runs`, split by the counts in `words`.

    The driver learns which word lengths there are up to the longest run, one number each; only substrings of these
    lengths are looked up. Longer words count in the total and cannot stand in a run.
    """
    words = saved(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    longest = runs.agg(F.max(F.length("run"))).first()[0] or 0
    sizes = sorted(r[0] for r in words.select(F.length("word").alias("size")).where(F.col("size") <= longest).distinct().collect())
    spots = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("start")).select(
        "run", "start", F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("size")
    ).where(F.col("size") <= F.length("run") - F.col("start") + 1)
    parts = spots.select("run", "start", "size", F.expr("substring(run, start, size)").alias("word"))
    met = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("start", "size", "n")).alias("known"))
    ready = runs.join(met, "run", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_, lists = batch.column("run").to_pylist(), batch.column("known").to_pylist()
            found = [best_split(run, {(k["start"] - 1, k["size"]): k["n"] for k in known or ()}, total)
                     for run, known in zip(runs_, lists)]
            yield pa.RecordBatch.from_arrays([pa.array(runs_, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["run", "words"])

    return ready.mapInArrow(split, "run string, words array<string>")


def _name_runs(host: Column) -> Column:
    """Letter runs of a host without its last label, which rules name; a host of one label keeps it."""
    labels = F.split(F.lower(host), r"\.")
    own = F.when(F.size(labels) > 1, F.slice(labels, F.lit(1), F.size(labels) - 1)).otherwise(labels)
    return F.filter(F.split(F.array_join(own, "."), LETTERS), lambda r: r != "")


def host_tokens(urls: DataFrame, texts: DataFrame) -> DataFrame:
    """(host, token, m): segmented words of every distinct host with the times it has them."""
    runs = saved(urls.select("host").distinct().select("host", F.explode(_name_runs(F.col("host"))).alias("run")))
    split = segmented(runs.select("run").distinct(), word_counts(texts))
    words = runs.join(split, "run").select("host", F.explode("words").alias("word"))
    return words.groupBy("host", F.concat(F.lit("h:"), "word").alias("token")).agg(F.count(F.lit(1)).alias("m"))


def path_tokens(urls: DataFrame) -> DataFrame:
    """`urls` with a row for each letter run of the path, as token."""
    runs = F.filter(F.split(F.lower("path"), LETTERS), lambda r: r != "")
    return urls.withColumn("token", F.explode(runs)).withColumn("token", F.concat(F.lit("p:"), "token"))


def judged(pages: DataFrame, texts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule (null where none fits), verdict.

    `texts` has the corpus text of the unigram model. Where no rule fits, naive Bayes decides; a tie and a
    table without any ruled page give allow. Null URLs and those without `://` have empty host and path and are
    judged by the prior. Repeated rows agree; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    ruled = parsed.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"))
    urls = saved(ruled.groupBy("host", "path", "ruled").agg(F.count(F.lit(1)).alias("n")))
    names = saved(host_tokens(urls, texts))

    def by_class(column: str = "n") -> list[Column]:
        return [F.sum(F.when(F.col("ruled") == label, F.col(column)).otherwise(0)).alias(label) for label in (ALLOW, BLOCK)]

    hosts = urls.groupBy("host").agg(*by_class())
    of_hosts = names.join(hosts, "host").groupBy("token").agg(*[F.sum(F.col("m") * F.col(c)).alias(c) for c in (ALLOW, BLOCK)])
    of_paths = path_tokens(urls.where("ruled is not null")).groupBy("token").agg(*by_class())
    counts = saved(of_hosts.unionByName(of_paths).where(f"{ALLOW} + {BLOCK} > 0"))
    size, allow, block = counts.agg(F.count(F.lit(1)), F.sum(ALLOW), F.sum(BLOCK)).first()
    pages_allow, pages_block = (x or 0 for x in urls.agg(*by_class()).first())
    gain = F.log(F.col(BLOCK) + SMOOTHING) - F.log(F.col(ALLOW) + SMOOTHING) - F.lit(
        math.log((block or 0) + SMOOTHING * max(size, 1)) - math.log((allow or 0) + SMOOTHING * max(size, 1)))
    gains = counts.select("token", gain.alias("gain"))
    prior = math.log(pages_block + SMOOTHING) - math.log(pages_allow + SMOOTHING)
    open_ = urls.where("ruled is null").select("host", "path")
    host_score = names.join(gains, "token").groupBy("host").agg(F.sum(F.col("m") * F.col("gain")).alias("_h"))
    path_score = path_tokens(open_).join(gains, "token").groupBy("host", "path").agg(F.sum("gain").alias("_p"))
    total = F.lit(prior) + F.coalesce("_h", F.lit(0.0)) + F.coalesce("_p", F.lit(0.0))
    # Rounded, so that the order in which tasks add up cannot tip a tie.
    scored = open_.join(host_score, "host", "left").join(path_score, ["host", "path"], "left").select(
        "host", "path", F.when(F.round(total, 9) > 0, BLOCK).otherwise(ALLOW).alias("scored"))
    out = ruled.join(saved(scored), ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "scored").alias("verdict"))
