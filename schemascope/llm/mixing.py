"""Mixing documents to target weights by soft domain membership, in DataFrame functions only.

A logistic regression, fitted on a labelled table, gives each document a
posterior over domains. Non-negative document rates are then fitted by
projected gradient least squares so that the expected tokens of each domain,
sum over documents of rate * tokens * posterior, meet the targets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, stage

_BETWEEN = "[^\\p{L}\\p{N}]+"


def features(text: Column) -> Column:
    """n, the text's words, lower-cased runs of letters and digits; words, the
    distinct ones, and a few marks of the text's shape as words with a leading
    blank: how many characters for each word lie between words, beyond one."""
    # lambdas share no subexpressions: what is used twice is a field of a struct
    def counted(words: Column) -> Column:
        odd = F.length(text) - F.length(F.array_join(words, "")) - F.size(words)
        return F.struct(F.size(words).alias("n"), F.array_distinct(words).alias("words"), odd.alias("odd"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).alias("upper"))

    def of(x: Column) -> Column:
        shape = F.array_compact(F.array(
            *[F.when(10 * x["odd"] > share * x["n"], F.lit(f" odd {share}")) for share in (3, 6, 10, 20)],
            F.when(100 * F.size(x["words"]) < 40 * F.least(x["n"], F.lit(400)), F.lit(" repeats")),
            F.when(2 * x["upper"] > F.length(text), F.lit(" capitals")),
        ))
        return F.struct(x["n"].cast("long").alias("n"), F.concat(x["words"], shape).alias("words"))

    words = F.filter(F.split(F.lower(text), _BETWEEN), lambda w: w != "")
    return F.element_at(F.transform(F.transform(F.array(words), counted), of), 1)


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", most_labelled: int = 20_000, vocabulary: int = 256, penalty: float = 0.1) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(domains, word -> weight by domain, start by domain) of a multinomial logistic regression.

    ``labelled`` has id_col and domain_col; at most about ``most_labelled`` of
    its rows, picked by hash, are used; of several domains of one id the first
    by name counts. The words used are the ``vocabulary`` that tell most about
    the domain; ``penalty`` is that on the squared weights of the whole sample.
    As the starts have none, the sample's mean posteriors are its labels' shares.
    """
    total = labelled.count()
    part = max(1, math.ceil(total / most_labelled))
    some = labelled.where(F.col(id_col).isNotNull() & F.col(domain_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("_domain"))
    some = some.where(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(part)) == 0).groupBy("_id").agg(F.min("_domain").alias("_domain"))
    texts = docs.select(F.col(id_col).alias("_of"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sample = stage(texts.join(F.broadcast(some), F.col("_of") == F.col("_id")).select("_domain", features(F.col("_text"))["words"].alias("words")), "sample")
    sizes = {d: n for d, n in sample.groupBy("_domain").count().collect()}
    domains = sorted(sizes)
    if len(domains) < 2:
        return domains, {}, [0.0] * len(domains)
    counts = sample.select("_domain", F.explode("words").alias("word")).groupBy("word").agg(*[F.count(F.when(F.col("_domain") == d, 1)).alias(f"n{k}") for k, d in enumerate(domains)])
    n = sum(sizes.values())
    df = sum((F.col(f"n{k}") for k in range(len(domains))), F.lit(0))
    # gain of knowing whether the word is there: G-test on the word's table
    def cell(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    gain = sum((cell(F.col(f"n{k}"), df * sizes[d] / n) + cell(sizes[d] - F.col(f"n{k}"), (n - df) * sizes[d] / n) for k, d in enumerate(domains)), F.lit(0.0))
    words = [r["word"] for r in counts.where((df >= 3) & (df < n)).orderBy(gain.desc(), "word").limit(vocabulary).collect()]
    if not words:
        return domains, {}, [math.log(sizes[d] / n) for d in domains]
    # one lambda, not an expression for each word: the driver compiles and keeps the code; what it uses is bound
    # by another lambda, as the optimiser would put a column's own expression inside and evaluate it for each word
    known = F.array(F.array_intersect("words", F.array(*[F.lit(w) for w in words])))
    x = array_to_vector(F.element_at(F.transform(known, lambda own: F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(own, w).cast("double"))), 1))
    y = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("_domain")).cast("double") - 1
    rows = stage(sample.select(y.alias("label"), x.alias("features")), "vectors")
    model = LogisticRegression(family="multinomial", regParam=penalty / n, standardization=False, maxIter=60, tol=1e-6).fit(rows)
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    release(sample, rows)
    return domains, {w: [float(v) for v in weights[:, i]] for i, w in enumerate(words)}, [float(v) for v in start]


def posteriors(texts: Column, model: tuple) -> Column:
    """A struct of ``tokens`` (words: runs of letters and digits) and ``p`` (a posterior for each domain)."""
    domains, weights, start = model
    lit = lambda v: F.array(*[F.lit(float(a)) for a in v])

    def scored(found: Column) -> Column:
        if not domains:
            return F.struct(found["n"].alias("tokens"), F.array().cast("array<double>").alias("p"))
        scores = lit(start)
        if weights:
            table = F.create_map(*[y for w, v in weights.items() for y in (F.lit(w), lit(v))])
            known = F.array_intersect(found["words"], F.array(*[F.lit(w) for w in weights]))
            scores = F.aggregate(F.transform(known, lambda w: F.element_at(table, w)), scores, lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
        return F.struct(found["n"].alias("tokens"), F.element_at(F.transform(F.array(scores), softmax), 1).alias("p"))

    def softmax(s: Column) -> Column:
        most = F.array_max(s)
        exps = F.transform(s, lambda v: F.exp(v - most))
        return F.element_at(F.transform(F.array(exps), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), 1)

    return F.element_at(F.transform(F.array(features(F.coalesce(texts.cast("string"), F.lit("")))), scored), 1)


def fit_rates(scored: DataFrame, targets: list[float], rounds: int = 12, tolerance: float = 1e-4) -> tuple[Column, list[float], list[float]]:
    """(rate expression over tokens and p, expected totals by domain, targets).

    From rate 1 on, each round moves along the gradient of the squared gaps per
    token (so that documents of equal posteriors get equal rates), scaled by
    the domains' Gram matrix over the documents whose rate isn't zero, and
    projects on rates >= 0. The driver sees k + k*k sums a round.
    """
    k = len(targets)
    share = [F.col("tokens") * F.element_at("p", i + 1) for i in range(k)]
    rate = F.lit(1.0)
    totals: list[float] = [0.0] * k
    best: tuple[float, Column, list[float]] | None = None
    for _ in range(rounds + 1):
        x = scored.select("tokens", "p", rate.alias("r"))
        on = F.when(F.col("r") > 0, 1.0).otherwise(0.0)
        sums = [F.sum(F.col("r") * share[i]).alias(f"s{i}") for i in range(k)]
        gram = [F.sum(on * share[i] * F.element_at("p", j + 1)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
        row = x.agg(*sums, *gram).first()
        totals = [float(row[f"s{i}"] or 0) for i in range(k)]
        gap = np.array(totals) - np.array(targets)
        size = float(np.abs(gap).sum()) / max(1.0, float(np.sum(targets)))
        if best is None or size < best[0]:
            best = (size, rate, totals)
        if size <= tolerance:
            break
        g = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                g[i, j] = g[j, i] = float(row[f"g{i}_{j}"] or 0)
        ridge = 1e-6 * max(1e-9, float(np.trace(g)) / k)
        step = np.linalg.solve(g + ridge * np.eye(k), gap)
        move = sum((F.element_at("p", i + 1) * float(step[i]) for i in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate - move)
    return best[1], best[2], list(targets)


def _goals(figures: DataFrame, domains: list[str], weights: Mapping[str, float] | None, totals: Mapping[str, float] | None) -> list[float]:
    # a factor goes with a document's likeliest domain: rates equal to the factors meet these goals, so no other document has to pay for them
    main = F.array_position("p", F.array_max("p"))
    factor = F.element_at(F.array(*[F.lit(float((totals or {}).get(d, 1.0))) for d in domains]), main.cast("int"))
    share = [F.col("tokens") * F.element_at("p", i + 1) for i in range(len(domains))]
    row = figures.agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(share)], *[F.sum(factor * x).alias(f"t{i}") for i, x in enumerate(share)]).first()
    have = {d: float(row[f"s{i}"] or 0) for i, d in enumerate(domains)}
    every = sum(have.values())
    if weights is not None:
        return [weights[d] * every if d in weights else have[d] for d in domains]
    return [float(row[f"t{i}"] or 0) for i in range(len(domains))]


def mix(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, totals: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", rounds: int = 12, most_labelled: int = 20_000) -> DataFrame:
    """doc_id, tokens, p_<domain> for each domain, rate: one row per input row.

    ``weights``: each domain's share of the corpus's own number of tokens;
    ``totals``: a factor for each domain instead; the targets are the expected
    tokens left when every document has the factor of its likeliest domain.
    Domains that neither names keep what they have. Null and empty texts have no
    tokens, so any rate would do; theirs is what their posterior gives. Very
    long texts are read whole. Repeated rows are rated alike. With no labelled
    document, or an empty table, every rate is 1 and there is no p_ column.
    Other columns, of any name, are ignored. Texts are read for the fit and
    once to be scored; the rounds read token counts and posteriors only.
    """
    model = fit_domains(docs, labelled, id_col, text_col, domain_col, most_labelled)
    scored = stage(docs.select(F.col(id_col).alias("doc_id"), posteriors(F.col(text_col), model).alias("x")).select("doc_id", "x.tokens", "x.p"), "scored")
    rate = fit_rates(scored, _goals(scored, model[0], weights, totals), rounds)[0] if model[0] else F.lit(1.0)
    return scored.select("doc_id", "tokens", *[F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(model[0])], rate.alias("rate"))


def mix_rows(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float] | None = None, totals: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", rounds: int = 12, most_labelled: int = 20_000) -> DataFrame:
    """The rows of docs with their ``rate``; a column of that name, in any case,
    is replaced, all others stay as they are.

    As ``mix``, but the texts are scored again on the way out rather than
    written or joined.
    """
    model = fit_domains(docs, labelled, id_col, text_col, domain_col, most_labelled)
    own = [c for c in docs.columns if c.lower() != "rate"]
    row = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    if not model[0]:
        return docs.select(row).select("row.*", F.lit(1.0).alias("rate"))
    scored = docs.select(row, posteriors(F.col(f"`{text_col}`"), model).alias("x")).select("row", "x.tokens", "x.p")
    figures = stage(scored.select("tokens", "p"), "scored")
    rate = fit_rates(figures, _goals(figures, model[0], weights, totals), rounds)[0]
    release(figures)
    return scored.select("row", rate.alias("rate")).select("row.*", "rate")


def copies(rate: Column, key: Column, slack: float = 0.0) -> Column:
    """Whole copies for a rate: a number whose expectation over hashes of
    ``key`` is the rate. Rates within ``slack`` of a whole number are taken as it."""
    part = F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return F.when(F.abs(rate - F.round(rate)) <= slack, F.round(rate)).otherwise(F.floor(rate + part)).cast("int")
