"""Vector and lexical search."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SYNONYMS, jaccard, log_score, normalised, variants
from ..functions.vectors import cosine
from ..plans.staging import bounded


def synonyms(spark) -> DataFrame:
    """apiName, word of the table of business words."""
    return spark.createDataFrame([(o, w) for o, ws in SYNONYMS.items() for w in ws], "apiName string, word string")


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", most_queries: int = 100_000) -> DataFrame:
    """query, key, score, rank: the k nearest rows by cosine to each query
    (query, embedding), ties by key; scores are rounded to nine digits.

    Queries go in blocks to every part of the rows, which gives each query's k
    best of that part; only those are shuffled. A block of queries is a matrix
    of bounded size; the rows are never collected.
    """
    import numpy as np
    import pandas as pd

    n = queries.count()
    kind, width = queries.schema["query"].dataType.simpleString(), 2048
    own = vectors.schema[key].dataType.simpleString()
    schema = f"query {kind}, {key} {own}, score double"

    def block_best(ids: list, matrix):
        def best(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                rows = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                norms = np.linalg.norm(rows, axis=1)
                scores = np.round(np.divide(matrix @ rows.T, norms, out=np.zeros((len(matrix), len(rows))), where=norms > 0), 9)
                names, out = pdf[key].to_numpy(), []
                for q, s in zip(ids, scores, strict=True):
                    at = np.lexsort((names, -s))[:k]
                    out.append(pd.DataFrame({"query": q, key: names[at], "score": s[at]}))
                yield pd.concat(out)

        return best

    if n > most_queries:
        raise ValueError(f"{n} queries; split them into parts of at most {most_queries}")
    found = None
    asked = queries.select("query", vector).orderBy("query").toLocalIterator()
    while block := list(itertools.islice(asked, width)):
        matrix = np.array([r[vector] for r in block], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
        part = vectors.select(key, vector).mapInPandas(block_best([r["query"] for r in block], matrix), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def _matrix(column) -> tuple:
    """Rows of an Arrow list column as doubles, shorter ones padded with zeros; their sizes, -1 for null."""
    import numpy as np

    sizes = np.array([-1 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out, sizes


class _Asked:
    """All queries with their vectors; ``scores`` compares a block of them with a batch of rows."""

    def __init__(self, queries: DataFrame, vector: str, most: int):
        import numpy as np
        import pyarrow as pa

        held = queries.select("query", vector).limit(most + 1).toArrow().combine_chunks()
        if held.num_rows > most:
            raise ValueError(f"more than {most} queries; split them into parts")
        self.ids = held["query"].combine_chunks() if held.num_rows else pa.array([], held.schema.field("query").type)
        self.matrix, self.sizes = _matrix(held[vector].combine_chunks()) if held.num_rows else (np.zeros((0, 0)), np.zeros(0, dtype=np.int64))
        self.norms = np.sqrt((self.matrix**2).sum(axis=1))
        self.matrix = self.matrix.astype(np.float32) if queries.schema[vector].dataType.simpleString() == "array<float>" else self.matrix

    def scores(self, at: int, width: int, rows, sizes, norms):
        """Cosines, as ``vectors.cosine`` has them: NaN for null vectors, 0 for unequal sizes and zero norms."""
        import numpy as np

        block, n = self.matrix[at : at + width].astype(np.float64), self.sizes[at : at + width]
        shared = min(block.shape[1], rows.shape[1])
        out, by = block[:, :shared] @ rows[:, :shared].T, self.norms[at : at + width, None] * norms
        out = np.divide(out, by, out=np.zeros_like(out), where=by != 0)
        if (n != n[0]).any() or (sizes != n[0]).any():
            out[n[:, None] != sizes] = 0.0
            out[(n[:, None] < 0) | (sizes < 0)] = np.nan
        elif n[0] < 0:
            out[:] = np.nan
        return out


def _over_rows(vectors: DataFrame, queries: DataFrame, columns: list[str], vector: str, most: int, schema: str, task) -> DataFrame:
    """``task(asked, batches)`` over all rows, read once; batches are (Arrow columns, rows, sizes, norms)."""
    asked = vectors.sparkSession.sparkContext.broadcast(_Asked(queries, vector, most))

    def run(batches):
        import numpy as np

        def parts():
            for b in batches:
                if b.num_rows and len(asked.value.ids):
                    rows, sizes = _matrix(b.column(len(columns)))
                    yield b.columns[:-1], rows, sizes, np.sqrt((rows**2).sum(axis=1))

        return task(asked.value, parts())

    return vectors.select(*columns, vector).mapInArrow(run, schema)


def pair_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", digits: int = 6, none: float | None = None, most_queries: int = 100_000) -> DataFrame:
    """query, key, score of every row and query (query, embedding), rounded
    half away from zero; ``none`` for null vectors. Blocks of both are
    multiplied where the rows are read; nothing is shuffled."""
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, {key} {vectors.schema[key].dataType.simpleString()}, score double"

    def task(asked, parts):
        import numpy as np
        import pyarrow as pa

        width = 64
        for (names,), rows, sizes, norms in parts:
            for at in range(0, len(asked.ids), width):
                s = asked.scores(at, width, rows, sizes, norms)
                s = np.copysign(np.floor(np.abs(s) * 10.0**digits + 0.5), s) / 10.0**digits + 0.0
                n, m = s.shape
                empty = np.isnan(s).ravel()
                score = pa.array(np.where(empty, none, s.ravel()) if none is not None else s.ravel(), mask=empty if none is None else None)
                yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(np.repeat(np.arange(at, at + n), m))), names.take(pa.array(np.tile(np.arange(m), n))), score], ["query", key, "score"])

    return _over_rows(vectors, queries, [key], vector, most_queries, kinds, task)


def best_scores(vectors: DataFrame, queries: DataFrame, key: str, vector: str = "embedding", most_queries: int = 100_000) -> DataFrame:
    """query, score: for each query and part of the rows, the greatest cosine of rows whose key isn't the query."""
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, score double"

    def task(asked, parts):
        import numpy as np
        import pyarrow as pa

        best, width = np.full(len(asked.ids), -np.inf), 256
        places: dict = {}
        for i, q in enumerate(asked.ids.to_pylist()):
            places.setdefault(q, []).append(i)
        for (names,), rows, sizes, norms in parts:
            keys = names.to_pylist()
            own = [(i, j) for j, x in enumerate(keys) for i in (places.get(x, ()) if x is not None else range(len(asked.ids)))]
            own = np.array(own, dtype=np.int64).reshape(-1, 2)
            for at in range(0, len(best), width):
                s = asked.scores(at, width, rows, sizes, norms)
                here = own[(own[:, 0] >= at) & (own[:, 0] < at + width)]
                s[here[:, 0] - at, here[:, 1]] = np.nan
                best[at : at + width] = np.fmax(best[at : at + width], np.fmax.reduce(s, axis=1))
        found = np.flatnonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(found)), pa.array(best[found])], ["query", "score"])

    return _over_rows(vectors, queries, [key], vector, most_queries, kinds, task).where("query is not null")


def scoped_top_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, by: str, vector: str = "embedding", least: float = -1.0, most_queries: int = 100_000) -> DataFrame:
    """query, by, key, score, rank: for each query and value of ``by`` the k nearest
    rows by cosine of at least ``least``, ties by key.

    Each task holds the best it has seen; only those are shuffled. Products of
    blocks only pick candidates: their cosines are then added up in the
    vector's order, so equal vectors have equal ones.
    """
    own = {c: vectors.schema[c].dataType.simpleString() for c in (key, by)}
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, {by} {own[by]}, {key} {own[key]}, score double"
    slack, width = 1e-9, 256

    def task(asked, parts):
        import numpy as np
        import pyarrow as pa

        n = len(asked.ids)
        bar: dict = {}
        held: dict = {}

        def pruned(label):
            q, s, names = (np.concatenate(x) for x in zip(*held[label], strict=True))
            order = np.lexsort((names, -s, q))
            q, s, names = q[order], s[order], names[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            last = rank == k - 1
            bar[label][q[last]] = np.maximum(bar[label][q[last]], s[last])
            keep = rank < k
            held[label] = [(q[keep], s[keep], names[keep])]

        for (names, labels), rows, sizes, norms in parts:
            keys = names.to_numpy(zero_copy_only=False)
            codes = labels.dictionary_encode(null_encoding="encode")
            code = codes.indices.to_numpy()
            for c, label in enumerate(codes.dictionary.to_pylist()):
                at_rows = np.flatnonzero(code == c)
                mine, own_sizes, own_norms = rows[at_rows], sizes[at_rows], norms[at_rows]
                limit = bar.setdefault(label, np.full(n, least))
                for at in range(0, n, width):
                    s = asked.scores(at, width, mine, own_sizes, own_norms)
                    near = s >= limit[at : at + width, None] - slack
                    if s.shape[1] > k and near.sum() > 4 * k * len(s):
                        kth = np.partition(np.nan_to_num(s, nan=-2.0), -k, axis=1)[:, -k]
                        near &= s >= kth[:, None] - slack
                    i, j = np.nonzero(near)
                    if not len(i):
                        continue
                    exact, block = np.zeros(len(i)), asked.matrix[at : at + width]
                    square_i, square_j = np.zeros(len(block)), np.zeros(len(mine))
                    for d in range(min(block.shape[1], mine.shape[1])):
                        x, y = block[:, d].astype(np.float64), mine[:, d]
                        exact += x[i] * y[j]
                        square_i += x * x
                        square_j += y * y
                    norm = np.sqrt(square_j)[j] * np.sqrt(square_i)[i]
                    exact = np.where(own_sizes[j] == asked.sizes[at + i], np.divide(exact, norm, out=np.zeros_like(exact), where=norm != 0), 0.0)
                    held.setdefault(label, []).append((at + i, exact, keys[at_rows[j]]))
                if label in held and sum(len(x[0]) for x in held[label]) > 3 * k * n:
                    pruned(label)
        for label in held:
            pruned(label)
            q, s, names = held[label][0]
            keep = s >= least
            out = pa.array([label] * int(keep.sum()), parted[by])
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(q[keep])), out, pa.array(names[keep], parted[key]), pa.array(s[keep])], ["query", by, key, "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    parted = {c: to_arrow_type(vectors.schema[c].dataType) for c in (key, by)}
    found = _over_rows(vectors, queries, [key, by], vector, most_queries, kinds, task)
    w = Window.partitionBy("query", by).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, query: Column, k: int, key: str, vector: str = "embedding", least: float | None = None, where: Column | None = None, post_filter: bool = False) -> DataFrame:
    """The k nearest by cosine, filter first; ``post_filter`` filters what the k nearest leave."""
    x = vectors if where is None or post_filter else vectors.where(where)
    x = x.withColumn("score", cosine(F.col(vector), query)).orderBy(F.desc("score"), key).limit(k)
    if where is not None and post_filter:
        x = x.where(where)
    return x if least is None else x.where(F.col("score") >= least)


def similarity(candidates: DataFrame, vectors: DataFrame, query: Column, key: str, vector: str = "embedding", also: list[str] = ()) -> DataFrame:
    """key, score of every candidate, and its columns ``also``; 0 without a vector."""
    x = candidates.join(vectors, key, "left")
    return x.select(key, *also, F.coalesce(cosine(F.col(vector), query), F.lit(0.0)).alias("score"))


def scoped_fields(vectors: DataFrame, query: Column, table: str | list[str], key: str, vector: str = "embedding", most: int = 500, least: float = 0.3, core: list[str] = (), cap: int = 15) -> DataFrame:
    """For each table its core fields and then the best ones, ``cap`` at most."""
    by = [table] if isinstance(table, str) else table
    x = vectors.withColumn("score", cosine(F.col(vector), query))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    best = x.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most) & (F.col("score") >= least))
    ranked = best.where(F.col("rank") <= cap).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", key))), lambda s: s[key].cast("string")).alias("found"))
    tables = vectors.select(*by).distinct().join(ranked, by, "left")
    return tables.select(*by, F.slice(F.array_union(F.array(*[F.lit(c) for c in core]).cast("array<string>"), F.coalesce("found", F.array().cast("array<string>"))), 1, cap).alias("fields"))


def max_scores(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(F.max("score").alias("score"))


def hybrid(signals: DataFrame, semantic: DataFrame, key: str = "apiName") -> DataFrame:
    """0.6 semantic + 0.4 graph + 0.15 for a junction, best first."""
    x = signals.join(semantic, key, "left").withColumn("semantic", F.coalesce("score", F.lit(0.0))).withColumn("graph", log_score(F.col("relationshipCount")))
    total = F.lit(0.6) * F.col("semantic") + F.lit(0.4) * F.col("graph") + F.when(F.col("isJunction"), 0.15).otherwise(0.0)
    return x.select(key, "semantic", "graph", "isJunction", total.alias("total")).orderBy(F.desc("total"), key)


def lexical_semantic(objects: DataFrame, query: str, key: str = "apiName") -> DataFrame:
    """key, score: word Jaccard of the query and the name with the label."""
    return objects.select(key, jaccard(F.lit(query), F.concat_ws(" ", key, "label")).alias("score"))


def first_tier(found: DataFrame) -> DataFrame:
    """Rows of the lowest tier that has any."""
    return found.join(F.broadcast(found.agg(F.min("tier").alias("tier"))), "tier")


def search(objects: DataFrame, words_of: DataFrame | None, terms: DataFrame, vector_hits: DataFrame | None = None, key: str = "apiName") -> DataFrame:
    """term, key, tier, confidence: exact label, exact name, variants and synonyms (0.85), vectors; the lowest tier of each term.

    words_of: key, word; the table of business words if none is given.
    vector_hits: term, key, score.
    """
    if words_of is None:
        words_of = synonyms(objects.sparkSession).withColumnRenamed("apiName", key)
    o = objects.select(key, normalised(F.col("label")).alias("l"), normalised(F.col(key)).alias("n"), normalised(F.regexp_replace(key, "__c$", "")).alias("b"))
    t = terms.select("term", normalised(F.col("term")).alias("t"))
    # terms are few, whatever the catalog holds
    t = bounded(t)
    hit = lambda on, tier, score: o.join(t, on).select("term", key, F.lit(tier).alias("tier"), F.lit(score).alias("confidence"))
    v = terms.select("term", F.explode(variants(F.col("term"))).alias("v")).distinct()
    near = o.join(bounded(v), (F.col("v") == F.col("l")) | (F.col("v") == F.col("n"))).select("term", key)
    words = v.join(bounded(words_of), F.col("v") == F.col("word")).select("term", key).join(o.select(key), key, "left_semi").select("term", key)
    found = hit(F.col("t") == F.col("l"), 0, 1.0).unionByName(hit((F.col("t") == F.col("n")) | (F.col("t") == F.col("b")), 1, 0.95)).unionByName(near.unionByName(words).distinct().select("term", key, F.lit(2).alias("tier"), F.lit(0.85).alias("confidence")))
    if vector_hits is not None:
        found = found.unionByName(vector_hits.where("score >= 0.5").select("term", key, F.lit(3).alias("tier"), F.col("score").alias("confidence")))
    best = found.withColumn("least", F.min("tier").over(Window.partitionBy("term"))).where("tier = least").drop("least")
    return best.groupBy("term", key).agg(F.min("tier").alias("tier"), F.max("confidence").alias("confidence"))


def exact_index(objects: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Normalised name -> key, the first wins."""
    both = objects.select(normalised(F.col("label")).alias("name"), key, ordinal).unionByName(objects.select(normalised(F.col(key)).alias("name"), key, ordinal))
    return both.groupBy("name").agg(F.min_by(key, ordinal).alias(key))


def hash_embedding(text: Column, width: int = 64) -> Column:
    """A deterministic embedding for tests: signed hashed word counts."""
    words = F.filter(F.split(F.lower(text), "\\W+"), lambda w: w != "")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when(F.pmod(F.xxhash64(w), F.lit(width)) == i, F.when(F.xxhash64(w, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)).cast("float"))


def format_examples(examples: DataFrame) -> DataFrame:
    """id and a numbered block of each example (id, question, soql); those that go into a prompt, so few."""
    w = Window.orderBy("id")
    return examples.select("id", F.format_string("Example %d:\nQuestion: %s\nSOQL: %s", F.row_number().over(w), "question", "soql").alias("block"))
