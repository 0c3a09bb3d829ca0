"""Quality rules: learned decision lists over document statistics, in Spark expressions alone.

The statistics are DataFrame expressions on each text. Sequential covering sees those of a bounded sample of labelled rows on the
driver: it grows a conjunction of thresholds by FOIL gain, prunes it on the rows held back from growing, and goes on with the rows
that no rule covers, whose thresholds are looked for anew. The list becomes one conditional expression over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, sampled

#: Fixed values of the contract: white space between words, symbols, words of a window, and when a text fails outright.
BLANK, SYMBOLS, RUN, LEAST_WORDS, REPEAT_PERCENT = " \t\n\x0b\x0c\r", "#*$%&|<>", 5, 10, 20
#: Labelled rows that training takes at most; most rules and conditions; share of label 0 that a rule must reach on either part of
#: the rows; rows that it must cover.
TRAIN_ROWS, MOST_RULES, MOST_CONDITIONS, PRECISION, LEAST_ROWS = 20_000, 64, 3, 0.95, 5
#: What rules may ask about, in the order that settles ties.
NAMES = ("repeat_share", "symbol_share", "upper_share", "bang_share", "distinct_share", "adjacent_share", "bar_share", "dup_line_share", "mean_word", "n_words")


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and NAMES) of each row's whole text.
    Null and blank texts have no words; shares of nothing are 0. Windows are told apart by a 64-bit hash of their words'
    64-bit hashes; the sort that finds their places runs only for texts that repeat a window."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(F.col("t"), F.lit(BLANK))
    read = docs.select("doc_id", text.alias("t")).select("doc_id", "t", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_regex(BLANK)}]+", -1)).alias("words"))
    # What is left of a text without all but some characters; a search in whole texts for each of them costs more.
    only = lambda chars: F.regexp_replace("t", f"[^{_regex(chars)}]+", "")
    hashed = read.select("doc_id", "t", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), only(SYMBOLS + "!").alias("marks"))
    n = F.size("h")
    window = lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(RUN)))
    windows = F.when(n >= RUN, F.transform(F.sequence(F.lit(0), n - RUN), window)).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("t", "\n", -1), lambda line: F.trim(line, F.lit(BLANK)) != "")
    counted = hashed.select(
        "doc_id", "h", windows.alias("runs"), F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        (F.length("t") - F.length(only(BLANK))).alias("word_chars"),
        *((F.length("marks") - F.length(F.translate("marks", chars, ""))).alias(name) for name, chars in (("n_symbols", SYMBOLS), ("bangs", "!"), ("bars", "|"))),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).alias("uppers"),
    )
    placed = F.array_sort(F.transform("runs", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct("runs")) < F.size("runs"), placed)
    found = counted.withColumn("placed", repeats).withColumn("at", _repeated_places(F.col("placed")))
    covered = F.when(F.col("at").isNull(), 0).otherwise(_covered(F.col("at")))
    told = found.select(
        "doc_id", F.size("h").cast("long").alias("n_words"), F.col("word_chars").cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("h")).alias("n_distinct"), "bangs", "bars", "uppers",
        F.size(F.filter(F.zip_with("h", F.slice(F.col("h"), F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)).alias("n_adjacent"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return told.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_symbols", "word_chars").alias("symbol_share"), share("uppers", "word_chars").alias("upper_share"),
        share("bangs", "word_chars").alias("bang_share"), share("n_distinct", "n_words").alias("distinct_share"), share("n_adjacent", "n_words").alias("adjacent_share"),
        share("bars", "word_chars").alias("bar_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("word_chars", "n_words").alias("mean_word"),
    )


def _repeated_places(placed: Column) -> Column:
    """Places, rising, of the windows that come twice or more, from structs (window, place) in order."""
    n = F.size(placed)
    before = F.concat(F.array(F.lit(None).cast("struct<x:bigint,i:int>")), F.slice(placed, F.lit(1), n - 1))
    after = F.concat(F.slice(placed, F.lit(2), n - 1), F.array(F.lit(None).cast("struct<x:bigint,i:int>")))
    twin = lambda a, b: F.coalesce(a["x"] == b["x"], F.lit(False))
    left = F.zip_with(placed, before, lambda a, b: F.struct(a.alias("a"), twin(a, b).alias("same")))
    both = F.zip_with(left, after, lambda a, b: F.struct(a["a"]["i"].alias("i"), (a["same"] | twin(a["a"], b)).alias("same")))
    return F.array_sort(F.transform(F.filter(both, lambda x: x["same"]), lambda x: x["i"]))


def _covered(at: Column) -> Column:
    """Words in windows that start at these rising places."""
    n = F.size(at)
    gaps = F.zip_with(F.slice(at, F.lit(1), n - 1), F.slice(at, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(RUN)))
    return F.aggregate(gaps, F.lit(RUN), lambda s, x: s + x)


def _regex(chars: str) -> str:
    return "".join(f"\\x{ord(c):02x}" for c in chars)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.name) > F.lit(self.cut) if self.above else F.col(self.name) <= F.lit(self.cut)

    def holds(self, values: np.ndarray) -> np.ndarray:
        at = values[:, NAMES.index(self.name)]
        return at > self.cut if self.above else at <= self.cut

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: the first that holds rejects the text; else it is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def kept(self) -> Column:
        verdict = F
        for rule in self.rules:
            verdict = verdict.when(_all(rule), F.lit(False))
        return verdict.otherwise(F.lit(True)) if self.rules else F.lit(True)

    def rule_number(self) -> Column:
        """1 for the first rule, and so on; null where none holds."""
        number = F
        for k, rule in enumerate(self.rules, 1):
            number = number.when(_all(rule), F.lit(k))
        return number if self.rules else F.lit(None).cast("int")

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) or "keep all"


def _all(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def learn(rows: DataFrame, train_rows: int = TRAIN_ROWS, most_rules: int = MOST_RULES, most_conditions: int = MOST_CONDITIONS, precision: float = PRECISION, least_rows: int = LEAST_ROWS) -> DecisionList:
    """Rules that tell label 0, from (key, label 0 or 1, NAMES): of these rows the train_rows whose keys hash lowest. Two thirds of
    them, by their keys' hashes, grow a rule; the others prune it. Without rows of label 0: no rules."""
    known = rows.where(F.col("label").isin(0, 1)).select("key", "label", *(F.col(c).cast("double").alias(c) for c in NAMES))
    grow = F.pmod(F.xxhash64("key"), F.lit(3)) > 0
    seen = sampled(known, "key", train_rows).select("label", grow.alias("grow"), *NAMES).collect()
    label, grows = (np.array([r[k] for r in seen], bool) for k in (0, 1))
    values = np.array([r[2:] for r in seen], float).reshape(-1, len(NAMES))
    rules: list[tuple[Condition, ...]] = []
    left = np.ones(len(seen), bool)
    while len(rules) < most_rules:
        x, y, g = values[left], label[left], grows[left]
        # The best beginning whose rule stays precise on rows that it did not grow on.
        tried = (_prune(x, y, g, _grow(x[g], y[g], first, most_conditions), precision, least_rows) for _, first in _gains(x[g], y[g]))
        rule = next(filter(None, tried), None)
        if not rule:
            break
        rules.append(rule)
        left &= ~_holds(rule, values)
    return DecisionList(tuple(rules))


def _holds(rule: tuple[Condition, ...], values: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(values) for c in rule], np.ones(len(values), bool))


def _gains(values: np.ndarray, label: np.ndarray) -> list[tuple[float, Condition]]:
    """The best cut of each statistic on either side, by falling FOIL gain."""
    found: list[tuple[float, Condition]] = []
    if not (~label).any() or not label.any():
        return found
    prior = np.log2(np.mean(~label))
    for j, name in enumerate(NAMES):
        order = np.argsort(values[:, j], kind="stable")
        x, bad = values[order, j], np.cumsum(~label[order])
        # A cut lies between two values; counts of label 0 and of all rows up to it and above it.
        cut = np.flatnonzero(x[1:] > x[:-1])
        for above in (True, False):
            zero, every = (bad[-1] - bad[cut], len(x) - 1 - cut) if above else (bad[cut], cut + 1)
            gain = zero * (np.log2(np.maximum(zero, 1e-9) / every) - prior)
            if len(gain) and gain.max() > 1e-9:
                k = cut[int(gain.argmax())]
                middle = float((x[k] + x[k + 1]) / 2)
                found.append((float(gain.max()), Condition(name, above, middle if x[k] <= middle < x[k + 1] else float(x[k]))))
    return sorted(found, key=lambda f: -f[0])


def _grow(values: np.ndarray, label: np.ndarray, first: Condition, most: int) -> tuple[Condition, ...]:
    """A first condition and the ones of most gain, one after the other, on the rows that the ones before leave."""
    rule = (first,)
    while len(rule) < most:
        here = rule[-1].holds(values)
        values, label = values[here], label[here]
        if not (gains := _gains(values, label)):
            break
        rule = (*rule, gains[0][1])
    return rule


def _prune(values: np.ndarray, label: np.ndarray, grows: np.ndarray, rule: tuple[Condition, ...], precision: float, least: int) -> tuple[Condition, ...] | None:
    """The beginning of the rule that does best on the held-back rows, if it is precise there and on the growing rows."""
    best = None
    for k in range(1, len(rule) + 1):
        here = _holds(rule[:k], values)
        (z1, o1), (z0, o0) = (((here & ~label & part).sum(), (here & label & part).sum()) for part in (grows, ~grows))
        if z1 + z0 >= least and z1 >= precision * (z1 + o1) and z0 >= precision * (z0 + o0):
            # A clean text lost weighs as four bad ones caught.
            value = z0 - 4 * o0
            if best is None or value > best[0]:
                best = (value, rule[:k])
    return best[1] if best else None


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """base_statistics, rule (the number of the rule that rejects, null if none) and kept (false where base_failed or a rule
    holds), one row for each of (doc_id, text). labels: (doc_id, label), learned from where doc_id meets a document; rows that repeat
    a doc_id on either side are each learned from with each of the other. Statistics are computed once and written."""
    rows = checkpoint(base_statistics(docs))
    known = checkpoint(rows.join(labels.select(F.col("doc_id").alias("key"), "label"), F.col("doc_id") == F.col("key")).select("key", "label", *NAMES))
    found = learn(known, **options)
    return rows.withColumn("rule", found.rule_number()).withColumn("kept", ~F.col("base_failed") & found.kept())
