"""Calls of outside services from inside a query: what may be tried again, and batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of messages that stand for a passing trouble: limits, network, locks.
LIMITS = ["REQUEST_LIMIT_EXCEEDED", "TotalRequests Limit exceeded", "ConcurrentPerOrgLongTxn Limit exceeded"]
PASSING = ["ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "socket hang up", "UNABLE_TO_LOCK_ROW", "SERVER_UNAVAILABLE"]
# Providers that a model's name may begin with.
PROVIDERS = ["ollama", "openai", "claude", "gemini"]


def retryable(message: Column) -> Column:
    """Whether a failure with this message may be tried again; no message is no."""
    m = F.coalesce(message, F.lit(""))
    return F.exists(F.array(*[F.lit(x) for x in (*LIMITS, *PASSING)]), lambda x: m.contains(x))


def may_retry(error: Exception) -> bool:
    return any(x in str(error) for x in (*LIMITS, *PASSING))


def retried(call: Callable, tries: int = 3, first: float = 1.0, cap: float = 30.0, again: Callable[[Exception], bool] = may_retry, sleep: Callable[[float], None] = time.sleep):
    """``call()``, tried again after passing failures, each wait twice the last up to ``cap``."""
    wait = first
    for k in range(tries):
        try:
            return call()
        except Exception as e:
            if k == tries - 1 or not again(e):
                raise
        sleep(min(wait, cap))
        wait *= 2


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 3):
    """A function from a text column to a vector column, made by ``embed`` in
    batches within Arrow batches; null texts have null vectors. Vectors of one
    call must have one length."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = pd.Series([None] * len(part), dtype=object)
            texts = [(i, t) for i, t in enumerate(part) if t is not None]
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                found = retried(lambda some=some: embed([t for _, t in some]), tries)
                if len(found) != len(some) or len({len(v) for v in found}) > 1:
                    raise ValueError("one vector of one length is needed for each text")
                for (i, _), v in zip(some, found, strict=True):
                    out[i] = np.asarray(v, dtype=np.float32)
            yield out

    return vectors


def model_flag(flag: Column, provider: str, model: str) -> Column:
    """struct(provider, model) of ``provider:model``; without a known provider the
    whole flag is the model, without a flag both are the defaults."""
    known = F.regexp_extract(flag, f"^({'|'.join(PROVIDERS)}):", 1)
    named = known != ""
    return F.struct(F.when(named, known).otherwise(F.lit(provider)).alias("provider"), F.when(named, F.substring(flag, F.length(known) + 2, F.length(flag))).otherwise(F.coalesce(F.nullif(flag, F.lit("")), F.lit(model))).alias("model"))
