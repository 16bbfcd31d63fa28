"""Quality rules as a short-circuit cascade of native column expressions.

Every rule is a Boolean column. On a bounded sample the job times each rule by
itself against a job that asks nothing, and counts what it rejects; the cascade
then asks the rules in order of rejections per second, and a document stops at
the first rule that rejects it, so what later rules would need is not computed.
Rules are timed in the form in which they are asked. The order changes only what
is computed, never whether a document stays.

`verdicts` is the bare cascade: its rules look at the raw text. `quality_rules`
also gives the base counts, which it has to compute for every row; there the base
condition comes first, from these counts, and only documents that pass it enter
the cascade of the other rules, which look at counts and words that are there:
comparisons of counts go before walks over the words unless these reject far more.

Words are maximal runs of anything but the six ASCII white-space characters.
A null text counts as an empty one, and so do texts without a word: they fail.
Null ids pass through; repeated rows are judged one by one; texts of any length
are judged whole; rules with equal rejections per second go by cost, then name;
an empty table gives an empty result. Other columns stay, whatever their names,
but for those called like a column of the result, which give way.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, packed

SYMBOLS = "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rejecting condition over the column `text`, which has no nulls."""

    name: str
    rejects: Column


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))


def _windows(w: Column) -> Column:
    """A 64-bit hash of every three words in a row; each word is hashed once."""
    n = F.size(w)
    near = lambda h, k: F.slice(h, k, n - 2)
    pairs = lambda h: F.zip_with(near(h, 1), near(h, 2), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= 3, let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.zip_with(pairs(h), near(h, 3), lambda a, b: F.xxhash64(a, b))))


def _repeats(windows: Column) -> Column:
    """The windows with their places, in order, where one of them comes twice; else null."""
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
    )


def _covered(repeats: Column) -> Column:
    """How many words lie in windows that come twice or more."""
    same = lambda x, i: F.coalesce(x["h"] == F.get(repeats, i)["h"], F.lit(False))
    again = F.filter(repeats, lambda x, i: same(x, i - 1) | same(x, i + 1))
    at = F.flatten(F.transform(again, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)))
    # The size of a null array is -1 or null, as ANSI mode is off or on.
    return F.when(repeats.isNotNull(), F.size(F.array_distinct(at))).otherwise(F.lit(0)).cast("long")


@dataclass(frozen=True)
class Inputs:
    """What the rules look at: expressions over the raw text, or columns that are there already."""

    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column
    words: Column


def _duplicates(x: Column) -> Column:
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def raw_inputs(text: str = "text") -> Inputs:
    t = F.col(text)
    return Inputs(n_words(t), word_chars(t), n_symbols(t), F.size(lines(t)).cast("long"), let(lines(t), _duplicates), words(t))


def measured(texts: DataFrame) -> DataFrame:
    """`texts` with the base counts of its column `text`, its words and number of lines, all native.

    Three-word windows are told apart by a 64-bit hash within one text. They are
    sorted with their places only where a first look finds one of them twice.
    """
    t = F.col("text")
    d = texts.withColumn("words", words(t)).withColumn("windows", _windows(F.col("words")))
    d = d.withColumn("repeats", _repeats(F.col("windows"))).withColumn("lines", lines(t))
    return (
        d.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", F.length(F.concat_ws("", "words")).cast("long"))
        .withColumn("n_symbols", n_symbols(t))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dup_lines", _duplicates(F.col("lines")))
        .withColumn("n_repeat_words", _covered(F.col("repeats")))
    )


def base_rules(x: Inputs | None = None) -> list[Rule]:
    """The base condition in two rules."""
    x = x or raw_inputs()
    repeated = let(x.words, lambda w: let(_windows(w), lambda h: let(_repeats(h), _covered)))
    return [Rule("few_words", x.n_words < 50), Rule("repeated_words", repeated * 100 > x.n_words * 50)]


def default_rules(x: Inputs | None = None) -> list[Rule]:
    """Rules beside the base condition; all are ratios, so size alone rejects nothing."""
    x = x or raw_inputs()
    w = x.n_words
    return [
        Rule("symbols", x.n_symbols * 10 > x.word_chars),
        Rule("bars", F.size(F.filter(x.words, lambda v: v == "|")) * 4 > w),
        Rule("duplicate_lines", (x.n_lines >= 4) & (x.n_dup_lines * 2 > x.n_lines)),
        Rule("word_length", (x.word_chars < 2 * w) | (x.word_chars > 30 * w)),
        Rule("no_letters", F.size(F.filter(x.words, lambda v: v.rlike(r"\p{L}"))) * 2 < w),
    ]


def ordered(sample: DataFrame, rules: list[Rule], clock=time.perf_counter, runs: int = 2) -> list[tuple[Rule, float, float]]:
    """Rules with their seconds over `sample` and share of rejections, best first.

    `sample` should be small and cached. A rule's time is the least of `runs` jobs
    that ask nothing else, less that of a job without a rule.
    """

    def run(rejects: Column) -> tuple[float, float]:
        times, share = [], 0.0
        for _ in range(runs):
            began = clock()
            share = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double"))).first()[0] or 0.0
            times.append(clock() - began)
        return min(times), float(share)

    empty = run(F.lit(False))[0]
    found = []
    for rule in rules:
        took, share = run(rule.rejects)
        found.append((rule, max(took - empty, 1e-6), share))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name)).otherwise(out)
    return out


def fitted_order(texts: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 17) -> list[Rule]:
    """`rules` in the order that a sample of at most `sample_rows` rows gives; `texts` has what the rules look at."""
    share = min(1.0, 2.0 * sample_rows / max(texts.count(), 1))
    sample = texts.sample(share, seed).limit(sample_rows).cache()
    try:
        sample.count()
        return [x[0] for x in ordered(sample, rules)]
    finally:
        sample.unpersist()


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return packed(docs, text).select("row", F.coalesce("c0", F.lit("")).alias("text"))


def verdicts(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000, seed: int = 17) -> DataFrame:
    """`docs` with `failed_rule` and `kept` by the bare cascade, base rules included."""
    d = _texts(docs, text)
    order = fitted_order(d.select("text"), [*base_rules(), *default_rules()] if rules is None else rules, sample_rows, seed)
    own = [c for c in docs.columns if c.lower() not in ("failed_rule", "kept")]
    d = d.select("row", cascade(order).alias("failed_rule"))
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "failed_rule", F.col("failed_rule").isNull().alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000, seed: int = 17) -> DataFrame:
    """`docs` with the base counts, `base_failed`, `failed_rule` and `kept`.

    `sample_rows` bounds what the order of the rules is fitted on. The default
    rules look at the counts and words that are there already, and so do their times.
    """
    rules = default_rules(Inputs(*[F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "words")])) if rules is None else rules
    d = measured(_texts(docs, text))
    order = fitted_order(d.select("text", "words", "n_lines", *COUNTS), rules, sample_rows, seed)
    new = (*COUNTS, "base_failed", "failed_rule", "kept")
    own = [c for c in docs.columns if c.lower() not in new]
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    d = d.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return d.withColumn("kept", F.col("failed_rule").isNull()).select(*[F.col(f"row.`{c}`").alias(c) for c in own], *new)
