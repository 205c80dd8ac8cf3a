"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[ \\t-\\r]+"
_WORD = "[^ \\t-\\r]+"
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(x: Column, step: int) -> Column:
    """Hashes of each element with the one ``step`` later; x is longer than step."""
    n = F.size(x) - step
    return F.zip_with(F.slice(x, 1, n), F.slice(x, step + 1, n), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column, window: int = 8) -> Column:
    """How many words lie in windows of 8 words found twice or more in the text.

    Windows are compared by 64-bit hashes made by doubling. Only if some
    repeat, the windows are sorted; the covered words are then counted over
    the sorted places of the repeated ones.
    """
    if window != 8:
        raise ValueError("windows of 8 words only")

    def covered(grams: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            nobody = F.array(F.struct(F.lit(None).cast("long").alias("g"), F.lit(None).cast("int").alias("i")))
            before = F.concat(nobody, F.slice(s, 1, n - 1))
            after = F.concat(F.slice(s, 2, n - 1), nobody)
            at = F.zip_with(F.zip_with(before, s, lambda a, b: F.struct(F.coalesce(a["g"] == b["g"], F.lit(False)).alias("same"), b["i"].alias("i"))), F.zip_with(s, after, lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False))), lambda x, y: F.when(x["same"] | y, x["i"]))
            places = F.sort_array(F.filter(at, lambda x: x.isNotNull()))
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
            return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"].cast("long"))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))), of_sorted))

    by_word = F.transform(words, lambda w: F.xxhash64(w))
    grams = _let(by_word, lambda a: _let(_pairs(a, 1), lambda b: _let(_pairs(b, 2), lambda c: _pairs(c, 4))))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(_let(grams, covered))


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``_row``, the columns of docs, with the base figures and those that the cascade's rules need."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    x = docs.select(row, text.alias("_text")).withColumn("_words", F.filter(F.split("_text", _SPACE), lambda w: w != ""))
    x = x.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda line: line.rlike(_WORD)))
    figures = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", _BLANKS, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", _SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    # a part that isn't deterministic keeps Catalyst from moving filters on the figures below them, where each use would make them again
    once = F.least(F.monotonically_increasing_id(), F.lit(0))
    return x.select("_row", "_text", "_words", *[(v + once).alias(f"_q_{k}") for k, v in figures.items()])


def base_failed() -> Column:
    return (F.col("_q_n_words") < 20) | (100 * F.col("_q_n_repeat_words") > 30 * F.col("_q_n_words"))


def default_rules() -> dict[str, Column]:
    """Name -> rejects. Thresholds are those usual for web text."""
    n = F.col("_q_n_words")
    letters = F.length(F.regexp_replace("_text", "[^\\p{L}]+", ""))
    return {
        "symbols": 10 * F.col("_q_n_symbols") > n,
        "word_length": (F.col("_q_word_chars") < 3 * n) | (F.col("_q_word_chars") > 10 * n),
        "repeated_lines": 10 * F.col("_q_n_dup_lines") > 3 * F.col("_q_n_lines"),
        "few_letters": 10 * F.size(F.filter("_words", lambda w: w.rlike("\\p{L}"))) < 8 * n,
        "capitals": 10 * (letters - F.length(F.regexp_replace("_text", "[^\\p{Ll}]+", ""))) > 5 * letters,
        "few_distinct_words": 100 * F.size(F.array_distinct("_words")) < 25 * F.least(n, F.lit(400)),
    }


def ordered_rules(docs: DataFrame, rules: Mapping[str, Column], text_col: str = "text", sample_rows: int = 2000, repeats: int = 2, tie: float = 2.0) -> list[tuple[str, float, float]]:
    """(name, seconds a row, share rejected) of each rule on a sample, by rejection per cost, most first.

    The sample is about ``sample_rows`` documents drawn from the whole input,
    copies each for itself; it sets the order alone, and the verdict doesn't
    depend on the order. Each rule runs over the sample so many times within
    one job that it sees ``sample_rows`` documents at least, once to warm up,
    all rules in one job, and then ``repeats`` times in turns with the others; its least time counts,
    less that of an empty rule. Rules whose rejection per cost is within a factor
    of ``tie`` of the best that is left go by name, so that the order repeats.
    """
    texts = docs.select(F.col(f"`{text_col}`").alias("text"))
    total = texts.count()
    if not total:
        return [(k, 0.0, 0.0) for k in sorted(rules)]
    # drawn before any figure is made
    drawn = texts.sample(fraction=min(1.0, sample_rows / total), seed=7) if total > sample_rows else texts
    # one small partition, so that a job's time is the rule's
    sample = with_figures(drawn).drop("_row").repartition(1).cache()
    n = max(1, sample.count())
    times = -(-sample_rows // n)
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def hits(rule: Column) -> Column:
        return F.coalesce(F.sum(F.when(rule, 1).otherwise(0)), F.lit(0))

    def timed(rule: Column) -> float:
        began = time.perf_counter()
        again.agg(hits(rule)).first()
        return time.perf_counter() - began

    every = {None: F.lit(False), **rules}
    # one job warms up all rules; the driver keeps the state of every job
    shares = dict(zip(every, (x / (n * times) for x in again.agg(*[hits(rule).alias(f"r{k}") for k, rule in enumerate(every.values())]).first()), strict=True))
    seconds = dict.fromkeys(every, float("inf"))
    for _ in range(repeats):
        for k, rule in every.items():
            seconds[k] = min(seconds[k], timed(rule))
    sample.unpersist()
    cost = {k: max(0.02 * seconds[None], seconds[k] - seconds[None]) / (n * times) for k in rules}
    left, found = sorted(rules, key=lambda k: -shares[k] / cost[k]), []
    while left:
        best = shares[left[0]] / cost[left[0]]
        group = [k for k in left if tie * shares[k] / cost[k] >= best]
        found += [(k, cost[k], shares[k]) for k in sorted(group)]
        left = [k for k in left if k not in group]
    return found


def cascade(order: list[str], rules: Mapping[str, Column]) -> Column:
    """The first rule in ``order`` that rejects the row, else null; later rules aren't evaluated."""
    verdict = F.lit(None).cast("string")
    for name in reversed(order):
        verdict = F.when(rules[name], F.lit(name)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, text_col: str = "text", rules: Mapping[str, Column] | None = None, sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """docs with base figures, ``base_failed``, ``rejected_by`` and ``kept``.

    Null and empty texts have no words. Base rules come first and the cascade
    runs only on rows that pass them. Very long texts are read whole. Input
    columns whose names, in any case, clash with the new ones are replaced, all
    others stay. Repeated rows are judged alike; an empty table gives no rows.
    """
    rules = default_rules() if rules is None else rules
    added = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept"}
    x = with_figures(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c.lower() not in added]), text_col)
    if order is None:
        order = [k for k, _, _ in ordered_rules(docs, rules, text_col, sample_rows)]
    rejected = F.when(base_failed(), F.lit("base")).otherwise(cascade(order, rules))
    out = x.select("_row.*", *[F.col(f"_q_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base_failed().alias("base_failed"), rejected.alias("rejected_by"))
    return out.withColumn("kept", F.col("rejected_by").isNull())
