"""URL rules by cascades of Bloom filters.

Every key that a url of the corpus could match (a host suffix with a path
prefix) belongs to the universe. Level 1 encodes the listed keys; level 2 the
unlisted keys of the universe that level 1 wrongly holds; level 3 the listed
keys that level 2 wrongly holds, and so on until no key is wrong. A key's
verdict is then exact for the whole universe, found without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/ ? #`` or end, A-Z
    lower-cased; then up to ``? #`` or end. Null or no ``://``: both empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:cut]


def keys_of(host: str, path: str, cuts: Iterable[int]) -> list[str]:
    """Keys the url could match, longest first: suffixes of the host at its
    dots with prefixes of the path of the lengths that rules have."""
    labels = host.split(".") if host else []
    prefixes = [path[:n] for n in cuts if 0 < n <= len(path)]
    found = [".".join(labels[i:]) + p for i in range(len(labels)) for p in prefixes]
    return sorted(found, key=lambda k: (-len(k), k))


class Bloom:
    """A Bloom filter over strings; ``level`` makes each level's hashes its own."""

    def __init__(self, n: int, rate: float, level: int):
        self.level, rate = level, min(max(rate, 1e-6), 0.999)
        self.size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.times = max(1, round(-math.log2(rate)))
        self.bits = np.zeros(self.size, dtype=bool)

    def _places(self, key: str) -> list[int]:
        data = key.encode("utf-8", "surrogatepass")
        a, b = xxhash.xxh3_64_intdigest(data, self.level), xxhash.xxh3_64_intdigest(data, self.level + 1000) | 1
        return [(a + i * b) % self.size for i in range(self.times)]

    def add(self, key: str) -> None:
        self.bits[self._places(key)] = True

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p] for p in self._places(key))


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1

    @staticmethod
    def first(listed: set[str], universe: int) -> Bloom:
        """Level 1, loose enough that it wrongly holds about as many keys as are listed."""
        out = Bloom(len(listed), min(0.5, len(listed) / math.sqrt(2) / max(1, universe)), 0)
        for key in listed:
            out.add(key)
        return out

    @classmethod
    def build(cls, first: Bloom, listed: set[str], wrong: set[str]) -> "Cascade":
        """wrong: the unlisted keys of the universe that level 1 holds."""
        levels, inside, outside = [first], set(listed), set(wrong)
        while outside:
            level = Bloom(len(outside), 0.5, len(levels))
            for key in outside:
                level.add(key)
            levels.append(level)
            inside, outside = outside, {key for key in inside if key in level}
        return cls(levels)


def judge_urls(pages: DataFrame, rules: Mapping[str, str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_rules: int = 2_000_000) -> DataFrame:
    """page_id, host, path, rule, verdict of every url.

    ``rules`` maps ``host/path`` to ``allow`` or ``block``; a rule fits its
    host, all subdomains and every path that starts with its path. The longest
    fitting rule wins; without one the url is in no listed set and gets
    ``default``. Null urls and those without ``://`` have an empty host and
    path and no rule. Repeated rows are judged alike; an empty table gives no
    rows; other columns are ignored.

    The filters' size grows with the rules, not with the pages; more than
    ``most_rules`` rules are refused (a join is the way then). The keys that
    level 1 wrongly holds are about as many as the rules; the number is
    checked before they are fetched.
    """
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; filters are broadcast for at most {most_rules}")
    bad = {k: v for k, v in rules.items() if v not in ("allow", "block") or "/" not in k}
    if bad:
        raise ValueError(f"not rules: {bad}")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["page_id"].dataType.simpleString()
    cuts = sorted({len(k) - k.index("/") for k in rules})
    context = rows.sparkSession.sparkContext
    lists = {v: {k for k, w in rules.items() if w == v} for v in sorted(set(rules.values()))}

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            found = set()
            for url in b.column(0).to_pylist():
                for key in keys_of(*split_url(url), cuts):
                    found.update((v, key) for v, level in firsts.value.items() if key in level and key not in lists[v])
            found -= seen
            if len(seen) < 100_000:
                seen |= found
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["list", "key"])

    n_keys = rows.count() * max(1, len(cuts)) * 4
    for _ in range(20):
        level_1 = {v: Cascade.first(keys, n_keys) for v, keys in lists.items()}
        firsts = context.broadcast(level_1)
        wrong = rows.select("url").mapInArrow(held, "list string, key string").distinct()
        limit = 10_000 + 10 * len(rules)
        found = wrong.limit(limit + 1).collect()
        if len(found) <= limit:
            break
        n_keys *= 4  # more keys than thought: a tighter level 1
    else:
        raise ValueError("level 1 holds too many unlisted keys")
    cascades = context.broadcast({v: Cascade.build(level_1[v], lists[v], {k for w, k in found if w == v}) for v in lists})

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = next(((key, v) for key in keys_of(host, path, cuts) for v, c in cascades.value.items() if key in c), (None, default))
                out.append((host, path, rule, verdict))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in cols]], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
