"""Exact dedup by deterministic block naming.

A document's normalised text is cut into blocks of fixed size. Equal blocks get
one integer name, by sorting them; then adjacent pairs of names are named in
the same way, level by level, until each document has a single name. No hash
stands for content: two documents of as many blocks have the same last name if
and only if their texts are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, keep_rows, release, row_key, stage

_DELETE = str.maketrans("", "", ASCII_SPACE)
_SCHEMA = "batch string, local int, block string, doc_id {kind}, n_chars long, text_sha256 string, locals array<int>"


def _blocks(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents as lists of batch-local block numbers, and each batch's distinct blocks.

    A block that many documents share is sent on once a batch, not once a copy.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, b in enumerate(batches):
        local: dict[str, int] = {}
        ids, chars, shas, lists = [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            plain = text.translate(_DELETE)
            ids.append(key)
            chars.append(len(text))
            shas.append(hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest())
            lists.append([local.setdefault(plain[at : at + size], len(local)) for at in range(0, max(1, len(plain)), size)])
        name, n, m = f"{part}.{k}", len(local), len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * (n + m)), pa.array([*range(n), *[None] * m], pa.int32()), pa.array([*local, *[None] * m], pa.string()), pa.array([*[None] * n, *ids], b.schema.field(0).type), pa.array([*[None] * n, *chars], pa.int64()), pa.array([*[None] * n, *shas], pa.string()), pa.array([*[None] * n, *lists], pa.list_(pa.int32()))],
            ["batch", "local", "block", "doc_id", "n_chars", "text_sha256", "locals"],
        )


def _named(values: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Distinct ``keys`` with an integer ``name`` each, increasing in a sorted order within partitions."""
    return stage(values.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), label)


def name_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """uid, doc_id, n_chars, text_sha256, n_blocks, name: (n_blocks, name) is the text's identity.

    Each level is a distinct sort of pairs of integers and a join; the number
    of levels is the logarithm of the longest document's blocks.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = stage(rows.mapInArrow(lambda it: _blocks(it, block), _SCHEMA.format(kind=kind)), "blocks")
    listed = cut.where("locals is not null").select("batch", "doc_id", "n_chars", "text_sha256", "locals").withColumn("uid", F.monotonically_increasing_id())
    listed = stage(listed, "listed")

    # sort the blocks into names where they meet, and send back the names only
    def sorted_names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, last = TaskContext.get().partitionId() << 40, None
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                if x != last:
                    name, last = name + 1, x
                out.append(name)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64())], ["batch", "local", "name"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dictionary = cut.where("local is not null").select("batch", "local", "block")
    names = stage(dictionary.repartition(n, "block").sortWithinPartitions("block").mapInArrow(sorted_names, "batch string, local int, name long"), "names")
    release(cut)
    level = stage(listed.select("uid", "batch", F.posexplode("locals").alias("at", "local")).join(names, ["batch", "local"]).select("uid", "at", "name"), "level")
    release(names)
    sizes = listed.select("uid", F.size("locals").alias("n_blocks"))
    longest = sizes.agg(F.max("n_blocks")).first()[0] or 0
    done = [level.join(sizes.where("n_blocks = 1").select("uid"), "uid", "left_semi").select("uid", "name")] if longest > 1 else [level.select("uid", "name")]
    steps = 1
    open_docs = level.join(sizes.where("n_blocks > 1"), "uid") if longest > 1 else None
    while open_docs is not None:
        half = (F.col("at") / 2).cast("int")
        pairs = open_docs.groupBy("uid", "n_blocks", half.alias("at")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("b"))
        pairs = stage(pairs, "pairs")
        named = _named(pairs.select("a", "b"), ["a", "b"], "named")
        level = stage(pairs.join(named, ["a", "b"]).select("uid", "n_blocks", "at", "name"), "level")
        release(pairs, named)
        steps *= 2
        done.append(level.where(F.col("n_blocks") <= steps).select("uid", "name"))
        open_docs = level.where(F.col("n_blocks") > steps) if longest > steps else None
    final = done[0]
    for x in done[1:]:
        final = final.unionByName(x)
    return listed.select("uid", "doc_id", "n_chars", "text_sha256", F.size("locals").alias("n_blocks")).join(final, "uid")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; null
    counts as empty. Of a group the longest original text stays, then the
    smallest doc_id. Of repeated rows (same doc_id and text) one is kept. A
    null doc_id is the largest. Other columns are ignored; empty in, empty out.
    """
    named = stage(name_blocks(docs, id_col, text_col, block), "identity")
    order = F.struct((-F.col("n_chars")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    out = named.join(groups, ["n_blocks", "name"])
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of docs, with all their columns.

    Rows are told apart by doc_id and text; of repeated rows one stays.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kept = exact_groups(keyed, "key", "text").where("kept")
    return keep_rows(docs, row_key(id_col, text_col), kept.select("doc_id"))
