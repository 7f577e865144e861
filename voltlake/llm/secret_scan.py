"""Secret scan in DataFrame expressions: pattern matches, and windows of high Shannon entropy in candidate strings.

Positions come from the pieces between matches: text split at a pattern gives the gaps, extracting all
matches gives their lengths, and a running sum of both places every match in code points. No row leaves its
document, so nothing is shuffled; documents without any candidate skip the positional work.

Entropy: a candidate is a run of token characters of CANDIDATE length or more that mixes letters and digits.
A window of fixed length slides over it, its character counts change by one in and one out, and the sum of
c * log2(c) follows the two changed counts: entropy = log2(w) - sum / w. Windows of the whole run are judged by
the class `base64`, those inside a stretch of hex digits in either case by the class `hex`, wherever in the run
the stretch lies; a stretch of decimal digits alone is a number. Windows at or over their class's threshold
merge into spans of kind `entropy`.
Candidates that match the allow list (identifiers, dates, paths) are suppressed. A piece between separators that
holds a stand-in word hides the windows that touch it and no others: what is left of its candidate is judged.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import text_or_empty, unused

# The patterns of the three base kinds, in order of their rank, and their least lengths. The last
# two match whole runs of their letters, where a run that is too short hides no other match, so they ask for the
# length themselves; too short an assignment takes its place and fails.
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{%d,}" % (LEAST_ACCESS - 4)
HEX = "[0-9a-f]{%d,}" % LEAST_HEX
KINDS = ("assign", "access", "hex", "entropy")

# Cheap tests that hold for every document with a match.
ASSIGN_WORD = r"(?i:password|passwd|secret|token|api_?key)"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = 20
RUN = "[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE
#: Window length and least entropy in bits a character, by class.
CLASSES = {"hex": (20, 3.0), "base64": (20, 3.8)}
#: A whole stretch of hex digits that holds a window and is no number.
STRETCH = "(?<![0-9A-Fa-f])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{%d,}" % CLASSES["hex"][0]
#: Candidates that look random but are no secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9+=_/-]*$",  # numbers and dates
    r"^[A-Za-z+=_/-]*$",  # words
    r"^/?([A-Za-z]+|[0-9]+)([/_-]([A-Za-z]+|[0-9]+))+/?$",  # paths and slugs of plain words and numbers
)
#: A piece between separators that names itself a stand-in.
STAND_IN = "(?<![A-Za-z0-9])[A-Za-z0-9]*(?i:example|sample|placeholder|xxxx)[A-Za-z0-9]*"


SPANS = "array<struct<start:bigint,rank:int,end:bigint>>"


def _none(layout: str) -> Column:
    return F.expr("array()").cast(layout)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out a single time, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _in_blocks(items: Column, start: Column, step: Callable[[Column, Column], Column], layout: str) -> Column:
    """Walk over `items` from the number `start`; `step` gets (number so far, a block of items) and gives a struct of
    the next number, `at`, and what the block adds, `found`, an array of the given layout. (at, found) of all.

    An append copies its array. Blocks of about the square root of the items keep these copies short.
    """
    def walk(all_: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_))).cast("int"))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / width).cast("int")),
            lambda k: F.slice(all_, k * width + 1, width))
        return F.aggregate(
            blocks, F.struct(start.alias("at"), _none(f"array<{layout}>").alias("found")),
            lambda state, block: _once(step(state["at"], block), lambda inner: F.struct(
                inner["at"].alias("at"), F.array_append(state["found"], inner["found"]).alias("found"))),
            lambda state: F.struct(state["at"].alias("at"), F.flatten(state["found"]).alias("found")))

    return _once(items, walk)


def _places(gaps: Column, hits: Column) -> Column:
    """(start, hit) of every hit, from the gaps around them. Both arrays are inputs of the walk, so made once."""
    layout = "array<struct<start:bigint,hit:string>>"

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        place = F.struct(begin.alias("start"), pair["hit"].alias("hit"))
        return F.struct(
            (begin + F.coalesce(F.length(pair["hit"]), F.lit(0))).alias("at"),
            F.when(pair["hit"].isNull(), state["found"]).otherwise(F.array_append(state["found"], place)).alias("found"),
        )

    def block(at: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.alias("at"), _none(layout).alias("found")), step)

    return _in_blocks(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), F.lit(0).cast("long"), block, layout)["found"]


def _spans(text: Column, pattern: str, test: Column, rank: int, group: int, least: int) -> Column:
    """Spans of one base kind whose `group` has `least` characters; documents that fail `test` skip the work."""
    placed = _places(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)))
    measured = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    typed = F.zip_with(placed, measured, lambda p, m: F.struct(
        p["start"].alias("start"), F.lit(rank).alias("rank"), (p["start"] + F.length(p["hit"])).alias("end"),
        (F.length(m) >= least).alias("long_enough")))
    kept = F.transform(F.filter(typed, lambda s: s["long_enough"]), lambda s: F.struct(s["start"], s["rank"], s["end"]))
    return F.when(test, kept.cast(SPANS)).otherwise(_none(SPANS))


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def hot_windows(run: Column, width: int, least: float) -> Column:
    """Merged (start, end) ranges of the windows of `run` whose entropy reaches `least`, by incremental counts."""
    log_w = math.log2(width)
    slots = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # Each step has the slot that enters the window and the one that leaves it, -1 while the window fills.
    moves = F.filter(F.arrays_zip(slots.alias("into"), F.concat(F.array_repeat(F.lit(-1), width), slots).alias("out")),
                     lambda m: m["into"].isNotNull())

    def step(state: Column, move: Column) -> Column:
        into, out, at = move["into"], move["out"], state["at"] + 1
        same = into == out
        gain = F.when(same, 0.0).otherwise(_weight(F.get(state["n"], into) + 1) - _weight(F.get(state["n"], into)))
        loss = F.when(same | (out < 0), 0.0).otherwise(_weight(F.get(state["n"], out)) - _weight(F.get(state["n"], out) - 1))
        total = state["s"] + gain - loss
        counts = F.when(same, state["n"]).otherwise(
            F.transform(state["n"], lambda c, k: c + (k == into).cast("int") - (k == out).cast("int")))
        # The tolerance keeps sums of rounded logarithms on the same side of the threshold.
        hot = (at >= width) & (F.lit(log_w) - total / width >= least - 1e-9)
        here = F.struct((at - width).alias("start"), at.alias("end"))
        joined = F.when(hot, _joined(state["ranges"], here)).otherwise(state["ranges"])
        return F.struct(at.alias("at"), counts.alias("n"), total.alias("s"), joined.alias("ranges"))

    start = F.struct(
        F.lit(0).cast("long").alias("at"), F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0.0).alias("s"),
        _no_ranges().alias("ranges"))
    return F.aggregate(moves, start, step, lambda state: _closed(state["ranges"]))


# Ranges are gathered with the last one apart, so that only a range that is over is appended.
_RANGES = "array<struct<start:bigint,end:bigint>>"


def _no_ranges() -> Column:
    nothing = F.lit(-1).cast("long")
    return F.struct(_none(_RANGES).alias("over"), nothing.alias("start"), nothing.alias("end"))


def _closed(ranges: Column) -> Column:
    last = F.struct(ranges["start"].alias("start"), ranges["end"].alias("end"))
    return F.when(ranges["start"] < 0, ranges["over"]).otherwise(F.array_append(ranges["over"], last))


def _joined(ranges: Column, here: Column) -> Column:
    """The ranges with one more, which starts no earlier than any of them."""
    grows = (ranges["start"] >= 0) & (ranges["end"] >= here["start"])
    return F.struct(
        F.when(grows, ranges["over"]).otherwise(_closed(ranges)).alias("over"),
        F.when(grows, ranges["start"]).otherwise(here["start"]).alias("start"),
        F.when(grows, F.greatest(ranges["end"], here["end"])).otherwise(here["end"]).alias("end"))


def _merged(ranges: Column) -> Column:
    """(start, end) ranges in order, those that touch or overlap as one."""
    return F.aggregate(F.array_sort(ranges), _no_ranges(), _joined, _closed)


def _moved(ranges: Column, by: Column) -> Column:
    return F.transform(ranges, lambda w: F.struct((by + w["start"]).alias("start"), (by + w["end"]).alias("end")))


def _hot(run: Column) -> Column:
    """Merged (start, end) ranges of the hot windows of `run`, each judged by the class of its own characters."""
    nothing = _none("array<struct<start:bigint,end:bigint>>")
    # Of hex digits alone no window is hot in the class `base64` only.
    whole = F.when(run.rlike("^[0-9A-Fa-f]*$"), nothing).otherwise(hot_windows(run, *CLASSES["base64"]))
    stretches = _places(F.split(run, STRETCH, -1), F.regexp_extract_all(run, F.lit(f"({STRETCH})"), F.lit(0)))
    hexed = F.flatten(F.transform(stretches, lambda s: _moved(hot_windows(s["hit"], *CLASSES["hex"]), s["start"])))
    return F.when(run.rlike(STRETCH), _merged(F.concat(whole, hexed))).otherwise(whole)


def _suspicious(run: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | run.rlike(pattern)
    return ~allowed


def _unmasked(run: Column) -> Column:
    """Hot ranges of what lies between the stand-ins of `run`."""
    names = F.regexp_extract_all(run, F.lit(f"({STAND_IN})"), F.lit(0))
    rests = _places(F.concat(F.array(F.lit("")), names), F.split(run, STAND_IN, -1))
    rests = F.filter(rests, lambda r: (F.length(r["hit"]) >= CANDIDATE) & _suspicious(r["hit"]))
    return F.flatten(F.transform(rests, lambda r: _moved(_hot(r["hit"]), r["start"])))


def _entropy_spans(text: Column) -> Column:
    placed = _places(F.split(text, RUN, -1), F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(0)))

    def windows(run: Column) -> Column:
        return F.transform(_unmasked(run["hit"]), lambda w: F.struct(
            (run["start"] + w["start"]).alias("start"), F.lit(3).alias("rank"), (run["start"] + w["end"]).alias("end")))

    found = F.flatten(F.transform(F.filter(placed, lambda run: _suspicious(run["hit"])), windows))
    return F.when(text.rlike(RUN), found.cast(SPANS)).otherwise(_none(SPANS))


def with_spans(docs: DataFrame, base: str = "_base", every: str = "_all") -> DataFrame:
    """`docs` with `base` and `every`: the spans (start, rank, end) of the base kinds, and of all kinds, in order.

    Offsets are code points, end exclusive; rank is the place in KINDS. Null text counts as empty and has no
    spans. Every row is judged by itself, so repeated rows give repeated results and an empty table none.
    """
    text = text_or_empty()
    assign = _spans(text, ASSIGN, text.rlike(ASSIGN_WORD), 0, 2, LEAST_ASSIGN)
    access = _spans(text, ACCESS, text.contains("AKIA"), 1, 0, LEAST_ACCESS)
    hexed = _spans(text, HEX, text.rlike(HEX), 2, 0, LEAST_HEX)
    return docs.withColumn(base, F.array_sort(F.concat(assign, access, hexed))).withColumn(
        every, F.array_sort(F.concat(base, _entropy_spans(text))))


def _listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    def count(rank: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["rank"] == rank)).cast("long")

    return with_spans(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(_listed(F.col("_base")), "utf-8"), 256).alias("base_sha256"),
        _listed(F.col("_all")).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows of `docs`, every merged span in text replaced by `mark`; n_chars follows where the column exists.

    Null and empty texts and texts without a span stay as they are, repeated rows change alike, an empty table gives
    no rows.
    """
    base, every, fresh = (unused(docs, name) for name in ("_base", "_all", "_clean"))
    text = text_or_empty()

    def block(at: Column, spans: Column) -> Column:
        """The block's part of the text is cut out once; what stays of it, each piece with a mark behind it."""
        end = F.greatest(at, F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), at))

        def cut(region: Column) -> Column:
            def step(state: Column, s: Column) -> Column:
                stays = F.substring(region, (state["at"] - at + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
                grown = F.array_append(state["found"], F.concat(stays, F.lit(mark)))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                                F.when(s["start"] >= state["at"], grown).otherwise(state["found"]).alias("found"))

            return F.aggregate(spans, F.struct(at.alias("at"), _none("array<string>").alias("found")), step)

        return _once(F.substring(text, (at + 1).cast("int"), (end - at).cast("int")), cut)

    walked = _in_blocks(F.col(every), F.lit(0).cast("long"), block, "array<string>")
    clean = _once(walked, lambda w: F.concat(F.array_join(w["found"], ""), F.substring(text, (w["at"] + 1).cast("int"), F.length(text))))
    out = with_spans(docs, base, every).withColumn(fresh, F.when(F.size(every) == 0, F.col("text")).otherwise(clean))
    swaps = {"text": F.col(fresh)}
    if "n_chars" in docs.columns:
        length = F.length(fresh).cast(docs.schema["n_chars"].dataType)
        swaps["n_chars"] = F.when(F.size(every) == 0, F.col("n_chars")).otherwise(length)
    return out.select(*[swaps[c].alias(c) if c in swaps else F.col(c) for c in docs.columns])
