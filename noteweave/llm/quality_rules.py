"""Quality rules as a ledger of bits: every rule is evaluated once, policies are applied to its bits afterwards.

`ledger` reads each text once and stores what was measured, and in `failed` one bit for each rule that the text
fails. A policy is a version with the mask of the rules that reject under it, so a new version needs no text:
a row is kept where `failed & mask` is zero. `ablation` groups the ledger by its bits first (a few rows for
each set of rules that fail together) and finds for each version and rule what fails it, what it alone
rejects and what would be kept without it, all by bitwise operators on that small table.

Everything is built from DataFrame functions; texts are not shuffled. The words of a text are bound once, as the only
element of an array, so that a text of n words costs n log n (the sort of its windows).

Defined results: a null or empty text has no words, measures zero everywhere and fails `few_words`; a text without
letters or lines passes the rules that are shares of them; a share that stands exactly on its threshold passes; repeated rows and
null ids each give their own row; an empty table gives an empty ledger; further columns are not read; a mask without bits keeps all.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.functions.text import text_or_empty

#: White space between words, and the characters that count as symbols (fixed values).
SPACE, SYMBOLS = r"\x20\x09-\x0D", "#*$%&|<>"


#: What is measured of a text: all longs, lengths in code points.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letterless", "n_upper", "n_letters")


class Rule(NamedTuple):
    """A rule fails where its condition on the measurements holds; its place in RULES is its bit."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


def share(part: str, whole: str, percent: int) -> Callable[[dict[str, Column]], Column]:
    """Whether `part` is more than so many hundredths of `whole`, in integers."""
    return lambda m: 100 * m[part] > percent * m[whole]


RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_words", share("n_repeat_words", "n_words", 50)),
    Rule("symbols", share("n_symbols", "n_words", 10)),
    Rule("duplicate_lines", share("n_dup_lines", "n_lines", 50)),
    Rule("shouting", share("n_upper", "n_letters", 50)),
    Rule("wordless", share("n_letterless", "n_words", 30)),
    Rule("long_words", lambda m: m["word_chars"] > 20 * m["n_words"]),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versions of the policy, by the rules that reject; rules are only ever added at the end of RULES.
POLICIES = {1: ("few_words", "repeated_words"), 2: tuple(BIT)}
BASE, CURRENT = 1, 2


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def removed(text: Column, pattern: str) -> Column:
    """How many code points of the text a pattern's matches have."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(words: Column) -> Column:
    """Words that stand in a three-word window which the text holds twice or more.

    The windows are sorted, equal ones then stand side by side, and the places that those cover are counted once.
    """
    window = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")))
    same = lambda s, x, i: F.coalesce(F.get(s, i)["k"] == x["k"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1))
    places = lambda found: F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.size(F.array_distinct(places(once(F.sort_array(window(words)), twice))))


def measures(text: Column) -> Column:
    """All measurements of a text as one struct of longs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    counts = lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: ~x.rlike(r"\p{L}"))).alias("n_letterless"))
    by_word = once(F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+"), F.lit(0)), counts)
    by_line = once(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    whole = {
        "word_chars": removed(text, f"[^{SPACE}]+"), "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_upper": removed(text, r"\p{Lu}+"), "n_letters": removed(text, r"\p{L}+"),
    }
    nested = F.struct(by_word.alias("w"), by_line.alias("l"), *(c.alias(n) for n, c in whole.items()))
    place = {"n_words": "w", "n_repeat_words": "w", "n_letterless": "w", "n_lines": "l", "n_dup_lines": "l"}
    return once(nested, lambda m: F.struct(*((m[place[n]][n] if n in place else m[n]).cast("long").alias(n) for n in MEASURES)))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, all measurements and `failed`: one bit for each rule of RULES."""
    measured = once(text_or_empty(F.col(text_col)), measures)

    def judged(m: Column) -> Column:
        known = {n: m[n] for n in MEASURES}
        bits = (F.when(rule.fails(known), F.lit(BIT[rule.name])).otherwise(0).cast("long") for rule in RULES)
        failed = F.lit(0).cast("long")
        for bit in bits:
            failed = failed.bitwiseOR(bit)
        return F.struct(*(m[n].alias(n) for n in MEASURES), failed.alias("failed"))

    return docs.select(F.col(id_col), once(measured, judged).alias("_m")).select(id_col, "_m.*")


def passes(version: int, failed: str = "failed") -> Column:
    """Whether a row of the ledger is kept under a version of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(version))) == 0


def verdicts(rows: DataFrame) -> DataFrame:
    """The ledger with `base_failed` and `kept`, under the base rules and under the current policy."""
    return rows.withColumns({"base_failed": ~passes(BASE), "kept": passes(BASE) & passes(CURRENT)})


def ablation(rows: DataFrame, versions: tuple[int, ...] = tuple(POLICIES)) -> DataFrame:
    """For each version and rule: `rows`, `failing` the rule, `kept`, rejected by the rule `alone`, and `kept_without` it.

    The ledger is grouped by its bits before anything else: at most one row for each set of rules that fail together.
    """
    spark = rows.sparkSession
    sets = rows.groupBy("failed").agg(F.count("*").alias("n"))
    asked = spark.createDataFrame([(v, mask(v), name, BIT[name]) for v in versions for name in POLICIES[v]], "version int, mask long, rule string, bit long")
    met = F.col("failed").bitwiseAND(F.col("mask"))
    rest = F.col("failed").bitwiseAND(F.col("mask").bitwiseAND(F.bitwise_not("bit")))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    every = asked.join(F.broadcast(sets), F.lit(True), "left")  # a few rules with at most 2 ** len(RULES) sets
    return every.groupBy("version", "rule").agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("failing"),
        total(met == 0).alias("kept"), total((met != 0) & (rest == 0)).alias("alone"), total(rest == 0).alias("kept_without"),
    )


def common_bits(rows: DataFrame, *group: str) -> DataFrame:
    """For each group the rules that `all_fail`, those that `any_fails`, and how many rows there are."""
    return rows.groupBy(*group).agg(F.bit_and("failed").alias("all_fail"), F.bit_or("failed").alias("any_fails"), F.count("*").alias("n"))
