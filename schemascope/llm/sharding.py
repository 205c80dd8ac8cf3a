"""Sharding by balanced label propagation.

Documents with the same link key (equal texts by default) should share a shard.
Interchangeable documents are counted together: a unit is a link key and a
salt, so that a key with very many documents is many units. Keys of more than
an eighth of a shard are seated first, on as few shards as they need. Then each
round is a Spark join that moves the units of a cut key to one shard, as far as
quotas between shards allow; the quotas come from an 8 x 8 table of wishes. In
one round that is the shard of a leading unit, which lets full shards swap, as
about as much wishes to leave a shard as to enter it; in the next it is the
shard with most units among those with room for the rest. Documents without a neighbour fill
the shards up in the end, so counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stage, text_or_empty


def quotas(wish: np.ndarray, load: np.ndarray, cap: np.ndarray, rounds: int = 200) -> np.ndarray:
    """How much may move from each shard to each so that no load passes its cap:
    wishes, with a shard's inflow scaled down until it fits."""
    x = wish.astype(float)
    for _ in range(rounds):
        after = load + x.sum(axis=0) - x.sum(axis=1)
        over = np.maximum(0, after - cap)
        if (over < 0.5).all():
            break
        inflow = x.sum(axis=0)
        x *= np.where(inflow > 0, np.clip(1 - over / np.maximum(inflow, 1e-9), 0, 1), 1)
    return np.floor(x)


def seats(units: list[tuple], cap: np.ndarray) -> list[tuple]:
    """(key, salt, shard) for the units (key, salt, n) of the large keys: a key
    goes where it just fits, or else fills the roomiest shards one by one."""
    room, by, out = cap.astype(np.int64), {}, []
    for key, salt, n in sorted(units):
        by.setdefault(key, []).append((salt, n))
    for key, parts in sorted(by.items(), key=lambda x: (-sum(n for _, n in x[1]), x[0])):
        rest, to = sum(n for _, n in parts), None
        for salt, n in parts:
            if to is None or room[to] < n:
                fits = np.flatnonzero(room >= rest)
                to = int(fits[room[fits].argmin()] if len(fits) else room.argmax())
            room[to] -= n
            rest -= n
            out.append((key, salt, to))
    return out


def admit(wanted: list[tuple], load: np.ndarray, cap: np.ndarray) -> list[tuple]:
    """The (to, part) of the wishes (from, to, part, n) that are granted, each for
    all shards that its units come from: by quotas, then by the room left, up to a
    hundredth beyond the cap (what is too much is taken off in one run of keys)."""
    wish, lumps, load = np.zeros((len(cap), len(cap))), {}, load.astype(np.int64)
    for a, b, p, n in sorted(wanted):
        wish[a, b] += n
        lumps.setdefault((b, p), []).append((a, n))
    left, granted = quotas(wish, load, cap), []
    for by_quota in (True, False):
        for (b, p), parts in list(lumps.items()):
            n = sum(n for _, n in parts)
            if all(n <= left[a, b] for a, n in parts) if by_quota else load[b] + n <= cap[b] + cap[b] // 100:
                for a, m in parts:
                    left[a, b] -= m
                    load[a] -= m
                load[b] += n
                granted.append((b, p))
                del lumps[b, p]
    return granted


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", link_key=None, rounds: int = 12, salts: int = 256, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot for every row, under the law ``rows``.

    ``link_key``: a column expression; rows with equal keys are linked, by
    default those with equal texts (null text: empty). Repeated rows are
    linked. Groups larger than a shard are spread over as few shards as hold
    them. Rounds end when no cut group finds room as a whole, or at ``rounds``.
    With fewer rows than shards some shards stay empty; an empty
    table gives no rows. Very long texts are read whole. Other columns, of any
    name, are ignored.

    The driver sees counts by shard and hash bucket (bounded by
    ``shards ** 2 * buckets``) and the units of large keys (by ``8 * shards *
    salts``) only; ranks are found within buckets. ``buckets`` is 1024, or one
    for each million rows if that is more.
    """
    text = text_or_empty(text_col)
    key = F.unhex(F.md5(text.cast("binary"))) if link_key is None else link_key
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"))
    rows = stage(rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int")), "rows")
    total = rows.count()
    buckets = buckets or max(1024, total >> 20)
    cap = np.array([total // shards + (s < total % shards) for s in range(shards)])

    units = rows.groupBy("key", "salt").agg(F.count("*").alias("n"))
    units = stage(units, "units")
    sizes = units.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1")
    # a large group is seated unit by unit, a small one moves as a whole
    large = max(2, total // (shards * 8))
    half = buckets // 2
    # large ones come first in a shard, so that a surplus is taken off the others
    part = F.when(F.col("all") > large, F.pmod(F.xxhash64("key", "salt"), F.lit(half))).otherwise(half + F.pmod(F.xxhash64("key"), F.lit(buckets - half))).cast("int")
    linked = stage(units.join(sizes, "key").select("key", "salt", "n", "all", part.alias("part")), "linked")
    release(units)
    spark = linked.sparkSession
    at = lambda values, i: F.element_at(F.array(*[F.lit(int(v)) for v in values]), i + 1)
    big = linked.where(F.col("all") > large)
    seated = seats([tuple(r) for r in big.select("key", "salt", "n").collect()], cap)
    places = spark.createDataFrame(seated, big.select("key", "salt", F.lit(0).alias("shard")).schema)
    big = stage(big.join(F.broadcast(places), ["key", "salt"]).select("key", "salt", "n", "part", "shard"), "seated")
    taken = np.zeros(shards, dtype=np.int64)
    for s, n in big.groupBy("shard").agg(F.sum("n")).collect():
        taken[s] = n
    # the others start by hash where the large ones left room
    ends = np.cumsum(np.maximum(0, cap - taken))
    dice = F.pmod(F.xxhash64("key", "salt"), F.lit(int(max(1, ends[-1]))))
    begin = F.coalesce(*[F.when(dice < int(e), F.lit(s)) for s, e in enumerate(ends)], F.lit(shards - 1))
    labels = stage(linked.where(F.col("all") <= large).select("key", "salt", "n", "all", "part", begin.alias("shard")), "labels")
    release(linked)

    still = 0
    for k in range(rounds):
        load = taken.copy()
        for s, n in labels.groupBy("shard").agg(F.sum("n")).collect():
            load[s] += n
        room = cap - load
        held = labels.groupBy("key", "shard").agg(F.sum("n").alias("n"), F.first("all").alias("all"), F.max(F.xxhash64("key", "salt", F.lit(k))).alias("lead"))
        tie = F.pmod(F.col("shard") + F.xxhash64("key"), F.lit(shards))
        fits = at(room, F.col("shard")) >= F.col("all") - F.col("n")
        best = F.max(F.when(fits, F.struct("n", tie.alias("tie"), F.col("shard").alias("to")))) if k % 2 else F.max(F.struct("lead", F.col("shard").alias("to")))
        cut = held.groupBy("key").agg(best["to"].alias("to"), F.count("*").alias("pieces"), F.first("all").alias("all")).where("pieces > 1")
        others = F.filter(F.array(*[F.lit(s) for s in range(shards)]), lambda s: at(room, s) >= F.col("all"))
        other = F.when(F.size(others) > 0, F.element_at(others, (F.pmod(F.xxhash64("key", F.lit(k)), F.greatest(F.size(others), F.lit(1))) + 1).cast("int")))
        lump = F.pmod(F.xxhash64("key", F.lit(k)), F.lit(buckets)).cast("int").alias("lump")
        goals = cut.select("key", F.coalesce("to", other).alias("to"), lump).where("to is not null")
        wishes = stage(labels.join(goals, "key", "left"), "wishes")
        wanted = wishes.where("shard != to").groupBy("shard", "to", "lump").agg(F.sum("n").alias("n")).collect()
        moved = admit([tuple(r) for r in wanted], load, cap)
        still = 0 if moved else still + 1
        if not moved:
            release(wishes)
            if still == 2 or not wanted and k % 2 == 0:
                break
            continue
        allowed = spark.createDataFrame(moved, "to int, lump int").withColumn("go", F.lit(True))
        after = wishes.join(F.broadcast(allowed), ["to", "lump"], "left").select("key", "salt", "n", "all", "part", F.when(F.col("go"), F.col("to")).otherwise(F.col("shard")).alias("shard"))
        after = stage(after, "labels")
        release(labels, wishes)
        labels = after
    homes = labels.select("key", "salt", "shard", "part").unionByName(big.select("key", "salt", "shard", "part"))

    # fill up: surplus of full shards and documents without a neighbour go where room is left
    own = F.coalesce(F.col("shard"), F.lit(shards))
    spread = F.coalesce(F.col("part"), F.pmod(F.xxhash64("uid"), F.lit(buckets)).cast("int"))
    placed = stage(rows.join(homes, ["key", "salt"], "left").select("uid", "doc_id", "size", "text_crc32", "key", own.alias("own"), spread.alias("part")), "placed")
    release(rows, labels, big)
    counts = np.zeros((shards + 1, buckets), dtype=np.int64)
    for s, p, n in placed.groupBy("own", "part").count().collect():
        counts[s, p] = n
    load = counts.sum(axis=1)
    before = (np.cumsum(counts, axis=1) - counts).ravel()
    offsets = docs.sparkSession.createDataFrame([(int(i // buckets), int(i % buckets), int(before[i])) for i in np.flatnonzero(counts.ravel())], "own int, part int, before long")
    room = np.minimum(load[:shards], cap)
    over = np.append(load[:shards] - room, load[shards])
    over_at = np.cumsum(over) - over
    lack = cap - room
    lack_at = np.cumsum(lack) - lack

    rank = F.col("before") + F.row_number().over(Window.partitionBy("own", "part").orderBy("key", "uid")) - 1
    ranked = placed.join(F.broadcast(offsets), ["own", "part"]).withColumn("rank", rank)
    stays = (F.col("own") < shards) & (F.col("rank") < at([*room, 0], F.col("own")))
    spare = at(over_at, F.col("own")) + F.col("rank") - at([*room, 0], F.col("own"))
    to = F.coalesce(*[F.when((spare >= int(lack_at[s])) & (spare < int(lack_at[s] + lack[s])), F.lit(s)) for s in range(shards)])
    x = ranked.withColumn("spare", spare).withColumn("stays", stays).withColumn("shard", F.when(stays, F.col("own")).otherwise(to))
    slot = F.when(F.col("stays"), F.col("rank")).otherwise(F.col("spare") - at(lack_at, F.col("shard")) + at(room, F.col("shard")))
    return x.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
