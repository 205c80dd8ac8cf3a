"""Shared helpers of the training-data operators: staging tables in the shared
checkpoint folder and splitting text into words and word shingles."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import bounded, release  # noqa: F401  for the operators
from ..plans.staging import staged as stage

#: ASCII white space of the contracts: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows of a few
    numbers each; a larger one is left to be shuffled."""
    return bounded(df, most)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str):
    """A key that tells rows apart even where ids repeat: the id and a hash of the text."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))


def keep_rows(docs: DataFrame, key, kept: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose key is in kept's only column; of rows with equal keys one."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    out = keyed.join(kept.toDF("key"), "key", "left_semi")
    repeated = stage(keyed.groupBy("key").count().where("count > 1").select("key"), "repeated")
    if not repeated.isEmpty():
        out = out.join(repeated, "key", "left_anti").unionByName(out.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return out.select("row.*")


# --- words and shingles -----------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit hashes of the words of texts: A-Z lower-cased, split on ASCII
    white space only. Known words are kept in a dictionary of bounded size."""

    def __init__(self, limit: int = 1 << 20):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        known = self.known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], dtype=np.uint64)


_WORDS: list[Words] = []


def known_words() -> Words:
    """One dictionary for each worker process."""
    if not _WORDS:
        _WORDS.append(Words(1 << 17))
    return _WORDS[0]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, repeats included. Fewer than k words:
    one shingle, the whole sequence; no words: none."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    out = np.full(n - m + 1, m, dtype=np.uint64)
    for i in range(m):
        out = mix64(out + words[i : n - m + 1 + i] * _ODD[i % len(_ODD)])
    return out
