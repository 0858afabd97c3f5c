"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Each rule is a condition that rejects a text. On a sample the time of each rule is taken by itself, and all rules' outcomes are counted together; rules are
then put in the order of rejections per cost, each time among the rows that the rules before it leave. The cascade is one conditional
expression in that order, so a text that a rule rejects is spared the rules after it. The order decides the cost, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.llm.common import materialise, split_of

#: Rows of the sample, on average.
SAMPLE_ROWS = 2_000
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first included. Windows are told by 64-bit hashes."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))

    def covered(s: Column) -> Column:
        """``s``: hashes with their positions, sorted."""
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(F.sort_array(F.transform(twice, lambda x: x["at"])), start, step, lambda a: a["n"])

    def count(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_let(placed, covered))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")


def _points(text: Column, pattern: str) -> Column:
    """Code points that are left without what ``pattern`` matches."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), pattern, "")).cast("long")


#: What rules are about, as expressions of the text.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: F.size(word_list(t)).cast("long"),
    "word_chars": lambda t: _points(t, r"[\x20\x09-\x0D]+"),
    "n_symbols": lambda t: F.regexp_count(F.coalesce(t, F.lit("")), F.lit(SYMBOLS)).cast("long"),
    "n_lines": lambda t: F.size(_lines(t)).cast("long"),
    "n_dup_lines": lambda t: _let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": lambda t: repeat_words(word_list(t)),
    "n_letters": lambda t: _points(t, r"\P{L}+"),
    "n_capitals": lambda t: _points(t, r"\P{Lu}+"),
    "n_bullets": lambda t: F.size(F.filter(_lines(t), lambda x: F.ltrim(x).rlike("^[-*•]"))).cast("long"),
    "n_trailing": lambda t: F.size(F.filter(_lines(t), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
}

Rule = Callable[[Callable[[str], Column]], Column]

#: The rules that ``base_failed`` is made of, and all others; each rejects where it is true.
BASE_RULES: dict[str, Rule] = {
    "short": lambda of: of("n_words") < 50,
    "repeats": lambda of: 100 * of("n_repeat_words") > 50 * of("n_words"),
}
RULES: dict[str, Rule] = {
    "symbols": lambda of: 10 * of("n_symbols") > of("n_words"),
    "word_length": lambda of: (of("word_chars") < 2 * of("n_words")) | (of("word_chars") > 15 * of("n_words")),
    "dup_lines": lambda of: 2 * of("n_dup_lines") > of("n_lines"),
    "letters": lambda of: 10 * of("n_letters") < 6 * of("word_chars"),
    "capitals": lambda of: 2 * of("n_capitals") > of("n_letters"),
    "bullets": lambda of: 10 * of("n_bullets") > 9 * of("n_lines"),
    "trailing": lambda of: 10 * of("n_trailing") > 3 * of("n_lines"),
}


def rank_rules(cost: dict[str, float], outcomes: dict[tuple[bool, ...], int]) -> list[str]:
    """Names of ``cost`` in order: next is always the rule that rejects most per cost of the rows which are left. ``outcomes`` counts rows by the
    rules' verdicts, in the order of ``cost``. Rules that reject nothing more come last, cheapest first."""
    names, order, left = list(cost), [], dict(outcomes)
    while len(order) < len(names):
        rejected = {n: sum(k for o, k in left.items() if o[i]) for i, n in enumerate(names) if n not in order}
        best = max(rejected, key=lambda n: (rejected[n] / cost[n], -cost[n]))
        order.append(best)
        left = {o: k for o, k in left.items() if not o[names.index(best)]}
    return order


def estimate(sample: DataFrame, rejects: dict[str, Column]) -> tuple[dict[str, float], dict[tuple[bool, ...], int]]:
    """Seconds of each rule over the rows of ``sample`` (written), and how many rows have which outcomes (as many at most as it has rows)."""

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            sample.agg(F.count_if(condition)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(F.lit(True))
    cost = {name: max(seconds(condition) - idle, 1e-4) for name, condition in rejects.items()}
    told = sample.select(*(c.alias(f"r{i}") for i, c in enumerate(rejects.values())))
    counted = told.groupBy(*told.columns).agg(F.count("*").alias("n")).collect()
    return cost, {tuple(bool(x) for x in r[:-1]): r["n"] for r in counted}


def some(docs: DataFrame) -> DataFrame:
    """About ``SAMPLE_ROWS`` rows of ``docs``, or all."""
    n = docs.count()
    return docs.sample(min(1.0, SAMPLE_ROWS / n), seed=11) if n else docs


def cascade(sample: DataFrame, rejects: dict[str, Column]) -> Column:
    """Whether a row passes every rule, as a conditional in the order that ``sample`` suggests."""
    out = F.lit(True)
    for name in reversed(rank_rules(*estimate(materialise(sample, "sample"), rejects))):
        out = F.when(rejects[name], False).otherwise(out)
    return out


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: dict[str, Rule] | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A null or empty text has zeros and fails. ``base_failed``: fewer than 50 words, or more than half of them in repeated windows of three
    words; ``kept`` needs all of ``rules`` (``RULES`` by default) besides. Texts are taken whole; repeated rows and null ids are documents like any
    other; other columns are ignored, whatever their names. Nothing is shuffled.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = {"n_words": F.size("words").cast("long"), "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_repeat_words": repeat_words(F.col("words"))}

    def of(name: str) -> Column:
        return F.col(name) if name in counts else STATISTICS[name](F.col("text"))

    def measured(rows: DataFrame) -> DataFrame:
        listed = rows.select("doc_id", "text", word_list(F.col("text")).alias("words"))
        done = listed.select("doc_id", "text", *(own.get(c, STATISTICS[c](F.col("text"))).alias(c) for c in counts))
        return done.withColumn("base_failed", BASE_RULES["short"](of) | BASE_RULES["repeats"](of))

    rejects = {"base": F.col("base_failed")} | {name: rule(of) for name, rule in (RULES if rules is None else rules).items()}
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return measured(narrow).select("doc_id", *counts, "base_failed", cascade(measured(some(narrow)), rejects).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that pass all rules (``BASE_RULES`` and ``RULES`` by default), with all their columns. Every statistic is computed within
    its rule, so only for texts that reach it."""
    (name,) = split_of(docs, "words_of")
    every = {**BASE_RULES, **RULES} if rules is None else rules
    rejects = {n: rule(lambda s: STATISTICS[s](F.col(text))) for n, rule in every.items()}
    kept = cascade(some(docs.select(text)), rejects)
    return docs.withColumn(name, kept).where(F.col(name)).drop(name)
