"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE_CLASS, WORD_CLASS, text_of

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

# Very common words of the languages the rules are meant for, lower case.
STOP_WORDS = tuple(
    (
        "the of and to in a is that for it as was with be by on are this from at or an "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als "
        "de la le les et des en un une du que est pour qui dans par sur au pas plus "
        "el los las y del que en un por con para se no su al es lo como más"
    ).split()
)
#: The words as written inside and at the start of a sentence.
STOP_FORMS = tuple(sorted({w for s in STOP_WORDS for w in (s, s.capitalize())}))


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie between ``least`` and ``most``; a null bound is open."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are null, and so pass, where their denominator is zero.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2, most=14),
    Rule("symbol_ratio", most=0.1),
    Rule("bang_ratio", most=0.2),
    Rule("stop_word_ratio", least=0.03),
    Rule("bar_ratio", most=0.2),
    Rule("dup_line_ratio", most=0.5),
)


#: Up to so many windows positions stand beside the upper bits of a window's hash in one long; longer texts sort (hash,
#: position) pairs by all 64 bits.
_BITS = 12
_PACKED = 1 << _BITS


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows at sorted positions: each adds 3, or its distance to the window before if less."""
    return F.aggregate(
        positions,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(p - s["last"], F.lit(3))).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def _twice(ordered: str, value, position) -> Column:
    """Positions of the items of a sorted array that agree in ``value`` with a neighbour, in order and without repeats."""
    n = F.greatest(F.size(ordered) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(ordered, F.lit(1), n), F.slice(ordered, F.lit(2), n), lambda a, b: F.when(value(a) == value(b), F.array(position(a), position(b)))
    )
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))


def _with_repeats(df: DataFrame, hashes: str) -> DataFrame:
    """Add ``_few`` and ``_many``: positions of repeated windows of ordinary and of very long texts, else empty.

    Texts whose window hashes all differ need no sort. Every array that is looked at more than once is its own column.
    """
    h = F.col(hashes)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    df = df.withColumn("_some", F.size(F.array_distinct(h)) < F.size(h))
    packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, _BITS), _BITS).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumns(
        {
            "_packed": F.when(F.col("_some") & (F.size(h) <= _PACKED), packed).otherwise(empty("bigint")),
            "_pairs": F.when(F.col("_some") & (F.size(h) > _PACKED), pairs).otherwise(empty("struct<h:bigint,i:int>")),
        }
    )
    few = _twice("_packed", lambda x: F.shiftrightunsigned(x, _BITS), lambda x: x.bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int"))
    return df.withColumns({"_few": few, "_many": _twice("_pairs", lambda x: x["h"], lambda x: x["i"])})


def measures(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the counts that rules may name; a null text has no words.

    Counts (long): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word),
    n_stop_words, n_bang (pairs of exclamation marks), n_bars. 3-word windows are compared by 64-bit hashes, in texts of
    up to 4,096 of them by 52 bits: a text of any length mistakes two windows with a chance below 1e-8 up to 500,000 words.
    """
    t, w = F.col("_t"), F.col("_w")
    step = df.select(*keep, text_of(text).alias("_t")).withColumn("_trim", F.btrim("_t", F.lit(SPACES)))
    none = F.array().cast("array<string>")
    step = step.select(
        *keep,
        "_t",
        F.when(F.col("_trim") == "", none).otherwise(F.split("_trim", SPACE_CLASS + "+")).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)).alias("_l"),
    )
    # No lambda looks into another array by index: an optimiser that inlines that array would build it for every word.
    step = step.withColumn("_x", F.transform(w, lambda x: F.xxhash64(x)))
    x, n = F.col("_x"), F.greatest(F.size(w) - 2, F.lit(0))
    two = F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    step = step.withColumn("_h", F.zip_with(two, F.slice(x, F.lit(3), n), lambda a, b: F.xxhash64(a, b)))
    step = _with_repeats(step, "_h")
    plain = t
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lost = lambda part: F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))
    longs = {
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.length(t) - F.length(plain),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": _covered(F.col("_few")) + _covered(F.col("_many")),
        "n_lines": F.size("_l"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_FORMS))),
        "n_bang": F.floor(lost("!!") / 2),
        "n_bars": lost("|"),
    }
    # The counts pass through a generator of one row: filters on them stay above it and don't repeat their expressions.
    step = step.select(*keep, *[c.cast("long").alias(name) for name, c in longs.items()])
    return step.select(*keep, F.inline(F.array(F.struct(*longs))))


#: Ratio measures, computed from the counts.
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "bang_ratio": ("n_bang", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "bar_ratio": ("n_bars", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


def verdict(rules: tuple[Rule, ...]) -> Column:
    """One boolean expression for the whole table."""
    passed = F.lit(True)
    for r in rules:
        value = F.try_divide(*[F.col(c) for c in RATIOS[r.measure]]) if r.measure in RATIOS else F.col(r.measure).cast("double")
        if r.least is not None:
            passed &= F.coalesce(value >= r.least, F.lit(True))
        if r.most is not None:
            passed &= F.coalesce(value <= r.most, F.lit(True))
    return passed


def quality_rules(df: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns with all measures, ``base_failed`` and ``kept``, from one projection without user functions.

    ``base_failed``: fewer than 50 words, or more than half of the words lie in repeated 3-word windows.
    ``kept``: not base_failed and every rule of the table holds. A null or empty text has no words and is not kept.
    Every input row gives one row, in an empty table none. ``keep`` must not name a measure.
    """
    out = measures(df, keep, text)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules))
