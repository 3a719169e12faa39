"""Quality rules: base thresholds, then a decision list learned by sequential covering.

Everything is column expressions. The statistics of a text come from higher-order functions over its words and lines; rules
are conjunctions of thresholds on whole-number statistics, grown and pruned on exact histograms that Spark counts over all
labelled rows, so the driver sees counts by value of a statistic and nothing of a document. The list is applied as one ordered
conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import Scratch, table

#: Characters that count as symbols, and white space between words, as in regular expressions.
SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
MOST_RULES = 12
MOST_TESTS = 4
#: A test must hold for so many rows of the rule's class, a rule must be right in so many percent of the rows that prune it.
LEAST_ROWS = 5
LEAST_RIGHT = 70

#: Statistics that rules test, whole numbers of at most a few thousand values each: shares are per mille.
STATISTICS = ("size", "word_length", "symbol_share", "digit_share", "capital_share", "stop_share", "comma_share", "dup_line_share", "repeat_share", "distinct_share", "line_words", "char_share")


def let(value: Column, use) -> Column:
    """``use(value)``, the value computed once: as the variable of a function over an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words of an array lie in windows of three words that come twice or more, first windows included.

    Windows are sorted, so that equal ones are neighbours; then the places of those that have an equal neighbour, in order,
    cover three words each, or as many as the next one leaves.
    """

    def places(s: Column) -> Column:
        alike = F.transform(s, lambda e, k: F.when(e["g"].eqNullSafe(F.get(s, k - 1)["g"]) | e["g"].eqNullSafe(F.get(s, k + 1)["g"]), e["i"]))
        return F.sort_array(F.filter(alike, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("bigint"), lambda s, x: s + x)

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("g"), i.alias("i")))
    return F.when(F.size(words) > 3, let(F.sort_array(windows), lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("bigint"))


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of a text belong to a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"{pattern}+", ""))).cast("bigint")


def text_statistics(text: Column) -> Column:
    """A struct of counts of one whole text."""
    kept = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = F.when(kept == "", F.array().cast("array<string>")).otherwise(F.split(kept, BLANK))
    lines = F.filter(F.split(text, "\n"), lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")
    return F.struct(
        let(words, of_words).alias("w"), let(lines, of_lines).alias("l"), F.length(text).cast("bigint").alias("n_chars"), F.length(F.regexp_replace(text, BLANK, "")).cast("bigint").alias("word_chars"),
        count_of(text, SYMBOLS).alias("n_symbols"), count_of(text, "[0-9]").alias("n_digits"), count_of(text, "[A-Z]").alias("n_capitals"), count_of(text, "[.!?]").alias("n_stops"), count_of(text, "[,;:]").alias("n_commas"),
    )


def share(part: str, whole: str, most: int = 1000) -> Column:
    """``most * part / whole`` rounded down; 0 where there is no whole."""
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * most / F.col(whole))).otherwise(0).cast("int")


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, the contract's counts, ``base_failed`` and STATISTICS of every row, in one pass without a shuffle."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), text_statistics(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("s"))
    own = own.select("id", "s.w.*", "s.l.*", *(f"s.{k}" for k in ("n_chars", "word_chars", "n_symbols", "n_digits", "n_capitals", "n_stops", "n_commas")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return own.select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.floor(F.log2(F.col("n_words") + 1) * 16).cast("int").alias("size"), F.least(F.lit(2000), share("word_chars", "n_words", 10)).alias("word_length"), share("n_symbols", "word_chars").alias("symbol_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_capitals", "word_chars").alias("capital_share"), share("n_stops", "word_chars").alias("stop_share"), share("n_commas", "word_chars").alias("comma_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"), F.least(F.lit(2000), share("n_words", "n_lines", 1)).alias("line_words"), share("word_chars", "n_chars").alias("char_share"),
    )


@dataclass(frozen=True)
class Rule:
    """A class and the tests ``(statistic, "<=" or ">=", threshold)`` that must all hold for it."""

    verdict: int
    tests: tuple[tuple[str, str, int], ...]

    def column(self) -> Column:
        return holds(self.tests)


def holds(tests) -> Column:
    out = F.lit(True)
    for name, sign, at in tests:
        out = out & ((F.col(name) <= at) if sign == "<=" else (F.col(name) >= at))
    return out


def best_test(counts: list[tuple[str, int, int, int]]) -> tuple | None:
    """The test with the largest information gain for the rows of the rule's class, of ``(statistic, value, p, n)``: p rows of the
    class and n others have the value. A threshold lies in the middle between two values that come next to each other. Ties go to the
    statistic that comes first, then to the smaller threshold."""
    by: dict[str, list] = {}
    for name, value, p, n in counts:
        by.setdefault(name, []).append((value, p, n))
    best = None
    for name in STATISTICS:
        rows = sorted(by.get(name, []))
        all_p, all_n = sum(p for _, p, _ in rows), sum(n for _, _, n in rows)
        if not all_p:
            continue
        low_p = low_n = 0
        for (value, p, n), (above, _, _) in zip(rows, rows[1:], strict=False):
            low_p, low_n = low_p + p, low_n + n
            for sign, own_p, own_n in (("<=", low_p, low_n), (">=", all_p - low_p, all_n - low_n)):
                if own_p >= LEAST_ROWS:
                    gain = own_p * (log2(own_p / (own_p + own_n)) - log2(all_p / (all_p + all_n)))
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        middle = (value + above) // 2
                        best = (gain, (name, sign, middle + (sign == ">=")), own_n)
    return best


def learn(rows: DataFrame) -> tuple[list[Rule], int]:
    """A decision list and the class of the rest, from stored ``label`` (0 or 1), ``grow`` (boolean) and STATISTICS.

    In turn: the rarer class among the rows that no rule covers yet gets a rule. Tests are added by information gain on the
    rows to grow on until none of the other class is left; then tests are cut from the end as long as the rule does no worse
    on the rows to prune on. Learning ends with the first rule that isn't right in LEAST_RIGHT percent of those, that covers none
    of them, or after MOST_RULES. Each step is one aggregate over the rows.
    """
    rules: list[Rule] = []
    free = F.lit(True)
    while len(rules) < MOST_RULES:
        left = rows.where(free)
        many = {0: 0, 1: 0} | dict(left.where("grow").groupBy("label").count().collect())
        verdict = 0 if many[0] <= many[1] else 1
        if many[verdict] < LEAST_ROWS or not many[1 - verdict]:
            break
        tests: list = []
        while len(tests) < MOST_TESTS:
            each = left.where(F.col("grow") & holds(tests)).select("label", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(s).alias("v")) for k, s in enumerate(STATISTICS)))).alias("x"))
            counts = each.groupBy("x.k", "x.v").agg(F.count_if(F.col("label") == verdict).alias("p"), F.count_if(F.col("label") != verdict).alias("n")).collect()
            found = best_test([(STATISTICS[r["k"]], r["v"], r["p"], r["n"]) for r in counts])
            if found is None:
                break
            tests.append(found[1])
            if not found[2]:
                break
        if not tests:
            break
        sides = [F.count_if(holds(tests[:k]) & (F.col("label") == c)) for k in range(1, len(tests) + 1) for c in (verdict, 1 - verdict)]
        seen = left.where("not grow").agg(*(s.alias(f"c{k}") for k, s in enumerate(sides))).first()
        right = [(seen[2 * k], seen[2 * k + 1]) for k in range(len(tests))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in right]
        k = max(range(len(tests)), key=lambda k: (worth[k], -k))
        if 100 * right[k][0] < LEAST_RIGHT * sum(right[k]) or not right[k][0]:
            break
        rules.append(Rule(verdict, tuple(tests[: k + 1])))
        free = free & ~rules[-1].column()
    rest = {0: 0, 1: 0} | dict(rows.where(free).groupBy("label").count().collect())
    return rules, 1 if rest[1] >= rest[0] else 0


def applied(rules: list[Rule], rest: int) -> tuple[Column, Column]:
    """The list as ordered conditional expressions: the class, and the number of the rule that decides (from 1; null: the rest)."""
    verdict, number = F.lit(rest), F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        verdict, number = F.when(rules[k].column(), rules[k].verdict).otherwise(verdict), F.when(rules[k].column(), k + 1).otherwise(number)
    return verdict, number


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, held_out, rule`` of every row.

    The list is learned from all labels 0 and 1 of rows that pass the base rules and whose id's CRC-32 modulo 3 is not 1 (others
    and those without an id are held out); a hash of the id parts them into rows to grow and, one in three, to prune rules
    on. ``rule`` is the number of the rule that decided: 0 base rules, 1.. the list's, null none of them. Null texts are empty and
    fail; without labels, or with labels of one class, there are no rules, and what passes the base rules is kept (unless
    all labels are 0). Equal texts get equal verdicts; repeated rows stay rows, repeated labels count each time. Other
    columns are ignored, and no rows give no rows.
    """
    store = Scratch(docs.sparkSession)
    stats = store.put(statistics(docs, id_col, text_col))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    grow = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(3)) != 0
    rules, rest = learn(store.put(stats.where("not base_failed").join(known, "id").select("label", grow.alias("grow"), *STATISTICS)))
    verdict, number = applied(rules, rest)
    return stats.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (verdict == 1)).alias("kept"), held_out(F.col("id")).alias("held_out"), F.when(F.col("base_failed"), 0).otherwise(number).alias("rule"),
    )


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every document, by the base rules and a list learned from ``labels.quality``."""
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
