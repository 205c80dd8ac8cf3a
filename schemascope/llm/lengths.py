"""Exact length histogram of encoded documents and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import stage


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, extra: int = 1) -> DataFrame:
    """length, n_docs: how many documents have how many tokens, the end token included.

    Null and empty texts count ``extra`` tokens. Repeated rows count each, very
    long texts are encoded whole. Other columns, of any name, are ignored; an
    empty table gives no row.
    """
    path = tokenizer or tokens.default_tokenizer()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(lambda it: tokens.lengths(it, path, extra), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length that occurs, taken as the context limit: documents and
    tokens up to it, documents longer than it, tokens that remain when longer
    documents are cut there, and the share of documents that fit.

    Sums run within blocks of ``block`` lengths and over the blocks' totals, so
    no task holds the whole histogram. Between two lengths that occur the
    figures follow from the lower one (``truncated_at``). Empty in, empty out.
    The histogram is written once, so that its documents are encoded once
    though both the sums and the rows read it.
    """
    h = stage(histogram, "histogram").withColumn("block", (F.col("length") / block).cast("long")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = totals.select("block", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    w = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    x = h.join(totals, "block").withColumn("d1", F.col("d0") + F.sum("n_docs").over(w)).withColumn("t1", F.col("t0") + F.sum("tokens").over(w))
    return x.select(
        "length", "n_docs", F.col("d1").alias("docs_up_to"), F.col("t1").alias("tokens_up_to"), (F.col("all_d") - F.col("d1")).alias("docs_longer"), (F.col("all_t") - F.col("t1")).alias("tokens_longer"),
        (F.col("t1") + F.col("length") * (F.col("all_d") - F.col("d1"))).alias("tokens_truncated"), (F.col("d1") / F.col("all_d")).alias("quantile"),
    )


def quantile(totals: DataFrame, q: float) -> int | None:
    """The least length that at least a share ``q`` of the documents stays within."""
    return totals.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def truncated_at(totals: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``, for any limit."""
    row = totals.where(F.col("length") <= limit).agg(F.max_by(F.struct("tokens_up_to", "docs_longer"), "length")).first()[0]
    if row:
        return row.tokens_up_to + limit * row.docs_longer
    return limit * (totals.agg(F.sum("n_docs")).first()[0] or 0)
