"""Quality rules as a short-circuit cascade.

A rule is a named native predicate that rejects a document. Each rule's
selectivity (share of documents that it rejects) and cost (seconds a document)
are estimated on a bounded sample, and the rules are nested in the order of
rejection per cost: a document that one rule rejects is not put to the later
ones. The order changes the cost alone; which documents are kept does not
depend on it.

All expressions are Spark SQL functions. Words are [^\\x20\\x09-\\x0D]+.

Defined cases: a null or empty text has no words and fails the base; a
predicate that is null rejects nothing; repeated rows are each judged; an
empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import SPACES, let, words_of

#: Most documents in the sample on which rules are timed, and the longest one in it.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 1 << 16
#: Evaluations of a rule on each row of the sample in one job, and jobs of which the median counts.
REPEATS, RUNS = 20, 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects: a predicate over the rows' columns, or a function from the measures to one."""

    name: str
    rejects: Column | Callable[[Column], Column]

    def of(self, measured: Column | None) -> Column:
        return self.rejects if isinstance(self.rejects, Column) else self.rejects(measured)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    selectivity: float
    seconds: float

    @property
    def rank(self) -> float:
        return self.selectivity / max(self.seconds, 1e-9)


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(_text(text), SPACES, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return (F.length(_text(text)) - F.length(F.translate(_text(text), SYMBOLS, ""))).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(_text(text), "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(words: Column) -> Column:
    """Words in windows of three words that are found twice or more, the first included.

    Windows are hashed to 64 bits. Only where some repeat are they sorted with
    their places; equal neighbours are the repeated ones, and each of their
    places covers three words, or as many as there are before the next.
    """

    def spans(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, i: F.coalesce(
                x["h"] == F.get(s, i - 1)["h"], F.lit(False)
            ) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

        def covered(at: Column) -> Column:
            wide = F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(3)), F.lit(3)))
            return F.aggregate(wide, F.lit(0), lambda a, x: a + x)

        return let(let(placed, places), covered)

    def hashed(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return let(
            windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spans(h))
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(hashed(words)).cast("bigint")


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def measures(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; the text is split once."""

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"), word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
            n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(words).alias("n_repeat_words"),
        )

    def judged(m: Column) -> Column:
        failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        return F.struct(*(m[c].alias(c) for c in _BASE[:5]), failed.alias("base_failed"))

    return let(let(words_of(text), counted), judged)


def standard_rules() -> list[Rule]:
    """Rules over text and the measures.

    symbols: over 7 % of the characters in words are of #*$%&|<>;
    word_length: the mean word has fewer than 2 or more than 15 characters;
    dup_lines: more than three lines, and over 30 % of them, repeat earlier ones;
    few_letters: under half of the characters in words are letters;
    long_word: a run of over 200 characters without white space.
    """
    text = _text(F.col("text"))
    lines = F.length(text) - F.length(F.translate(text, "\n", "")) + 1
    letters = F.length(F.regexp_replace(text, "\\P{L}+", ""))
    return [
        Rule("symbols", lambda m: 100 * m["n_symbols"] > 7 * m["word_chars"]),
        Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
        Rule("dup_lines", lambda m: (m["n_dup_lines"] > 3) & (100 * m["n_dup_lines"] > 30 * lines)),
        Rule("few_letters", lambda m: 2 * letters < m["word_chars"]),
        Rule("long_word", lambda m: text.rlike("[^\\x20\\x09-\\x0D]{201}")),
    ]


def estimate(sample: DataFrame, rules: Sequence[Rule], measured: str = "__quality") -> list[Estimate]:
    """Selectivity and seconds a row of each rule over the rows of sample, which should be cached.

    Each rule is evaluated REPEATS times on every row in one job, and the median
    of RUNS jobs counts, less the median of as many jobs that evaluate nothing.
    A cost that their spread could be is taken for that spread, and costs are
    rounded to powers of four: rules whose costs can't be told apart have the
    same, so that their order is by what they reject and repeats.
    """
    rows = max(1, sample.count())
    many = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("__turn"))

    def timed(value: Column) -> tuple[int, list[float]]:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            found = many.agg(F.count_if(value & (F.col("__turn") > 0))).first()[0]
            took.append(time.perf_counter() - began)
        return found // REPEATS, sorted(took)

    timed(F.lit(True))
    nothing = timed(F.lit(True))[1]
    floor = max(nothing[-1] - nothing[0], nothing[RUNS // 2] / 4)
    out = []
    for rule in rules:
        found, took = timed(F.coalesce(rule.of(F.col(measured)), F.lit(False)))
        seconds = max(took[RUNS // 2] - nothing[RUNS // 2], floor) / (rows * REPEATS)
        out.append(Estimate(rule, found / rows, 4.0 ** round(math.log(seconds, 4))))
    return out


def order(estimates: Sequence[Estimate]) -> list[Rule]:
    """By rejection per cost, the best first; ties by cost, then by name."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.rank, e.seconds, e.rule.name))]


def cascade(rules: Sequence[Rule], measured: Column | None = None) -> Column:
    """True if no rule rejects; a later rule isn't evaluated for a rejected row."""
    return reduce(
        lambda later, rule: F.when(F.coalesce(rule.of(measured), F.lit(False)), F.lit(False)).otherwise(later),
        reversed(rules),
        F.lit(True),
    )


def ordered(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """rules in the order of rejection per cost, by a sample of docs' rows that the base lets through.

    The sample is of at most sample_rows rows of at most SAMPLE_BYTES each, a
    tenth of the rows that are read; it decides the order and so the cost alone.
    """
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = short.sample(0.1, seed=7).limit(sample_rows).collect()
    if len(rows) < sample_rows:
        rows = short.limit(sample_rows).collect()
    local = docs.sparkSession.createDataFrame(rows, docs.schema)
    sample = local.select("*", measures(F.col("text")).alias("__quality")).where("NOT __quality.base_failed").cache()
    out = order(estimate(sample, rules))
    sample.unpersist()
    return out


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with the base columns and kept: the base holds and no rule rejects.

    Columns of docs with the names of base columns are replaced; the names
    __quality and __turn are reserved.
    """
    chosen = ordered(docs, standard_rules() if rules is None else list(rules), sample_rows)
    kept = lambda m: ~m["base_failed"] & cascade(chosen, m)
    whole = let(measures(F.col("text")), lambda m: F.struct(*(m[c].alias(c) for c in _BASE[:6]), kept(m).alias("kept")))
    own = [c for c in docs.columns if c not in _BASE]
    return docs.select(*own, whole.alias("__quality")).select(*own, *(F.col(f"__quality.{c}").alias(c) for c in _BASE))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of docs that are kept, with their own columns alone: one filter, which measures each text once."""
    chosen = ordered(docs, standard_rules() if rules is None else list(rules))
    return docs.where(let(measures(F.col("text")), lambda m: ~m["base_failed"] & cascade(chosen, m)))
