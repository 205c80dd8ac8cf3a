"""Vectors and examples kept as tables: indexes, upserts, searches, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, embedding_text, normalised, variants
from ..functions.vectors import cosine
from .merge import upsert
from .search import hash_embedding

INDEX_SCHEMA = "name string, label string, property string, dimensions int, similarity string"


def no_indexes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def create_index(indexes: DataFrame, name: str, label: str, vectors: DataFrame, vector: str = "embedding", similarity: str = "cosine") -> DataFrame:
    """The indexes with one more, unless the name is taken; its dimensions are
    those of the vectors, which must agree."""
    if index_exists(indexes, name):
        return indexes
    sizes = [r[0] for r in vectors.where(F.col(vector).isNotNull()).select(F.size(vector)).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError("vectors of one length are needed")
    return indexes.unionByName(indexes.sparkSession.createDataFrame([(name, label, vector, sizes[0], similarity)], INDEX_SCHEMA))


def index_exists(indexes: DataFrame, name: str) -> bool:
    return not indexes.where(F.col("name") == name).isEmpty()


def drop_index(indexes: DataFrame, name: str) -> DataFrame:
    return indexes.where(F.col("name") != name)


def upsert_vectors(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the vectors and hashes of new; of several new rows of one key the one with the greatest hash."""
    one = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), "contentHash").alias("x")).select(*keys, "x.*")
    return upsert(stored, one.select(*new.columns), keys)


def stored_hashes(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the stored hash, null without one."""
    return wanted.select(*keys).join(stored.select(*keys, "contentHash"), keys, "left")


def _prepared(x: DataFrame, kind: str, node: Column, text: Column) -> DataFrame:
    return x.select(F.lit(kind).alias("kind"), node.alias("id"), text.alias("text")).where("text is not null").withColumn("contentHash", content_hash(F.col("text")))


def prepare_objects(objects: DataFrame) -> DataFrame:
    """kind, id, text, contentHash; objects whose text is too short are left out."""
    none = F.lit(None).cast("string")
    return _prepared(objects, "Object", F.col("apiName"), embedding_text(F.col("apiName"), F.col("label"), none, none, none, none, F.array().cast("array<string>")))


def prepare_fields(fields: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return _prepared(fields, "Field", F.concat_ws(".", "sobjectType", "apiName"), embedding_text(F.col("apiName"), F.col("label"), F.col("sobjectType"), F.col("type"), none, none, F.array().cast("array<string>")))


def prepare_values(values: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return _prepared(values, "PicklistValue", F.concat_ws(".", "objectApiName", "fieldApiName", "value"), embedding_text(F.col("value"), F.col("label"), F.col("objectApiName"), none, none, none, F.array().cast("array<string>")))


def sync_vectors(prepared: DataFrame, stored: DataFrame, embed=hash_embedding, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the store afterwards, counts): texts whose hash isn't the stored one, or
    all if forced, are embedded and written; counts are processed, embedded, skipped.

    ``embed`` makes a vector column of a text column.
    """
    due = prepared if force else prepared.join(stored.select("kind", "id", "contentHash"), ["kind", "id", "contentHash"], "left_anti")
    new = due.select("kind", "id", embed(F.col("text")).alias("embedding"), "contentHash")
    counts = prepared.select("kind", "id").join(due.select("kind", "id", F.lit(1).alias("due")), ["kind", "id"], "left").agg(F.count("*").alias("processed"), F.count("due").alias("embedded"))
    return upsert_vectors(stored, new, ["kind", "id"]), counts.withColumn("skipped", F.col("processed") - F.col("embedded"))


def find_fields(fields: DataFrame, terms: DataFrame, vectors: DataFrame | None = None, least: float = 0.5, top: int = 10) -> DataFrame:
    """term, object, sobjectType, apiName, similarity, source of the fields that
    terms (term, object or null) mean: exact label or name, within the object
    the first by ordinal, else of every object; then the first variant that
    hits; then the nearest vectors (term, sobjectType, apiName, score).
    """
    names = fields.select("sobjectType", "apiName", "ordinal", F.explode(F.array_distinct(F.array(normalised(F.col("label")), normalised(F.col("apiName"))))).alias("name"))
    asked = terms.select("term", "object", normalised(F.col("term")).alias("t")).where("t != ''")
    words = asked.select("term", "object", F.lit(0).alias("tier"), F.col("t").alias("name")).unionByName(
        asked.select("term", "object", F.posexplode(variants(F.col("term"))).alias("tier", "name")).where("tier > 0")
    )
    hits = words.join(names, (words["name"] == names["name"]) & (F.col("object").isNull() | (F.col("object") == F.col("sobjectType"))))
    w = Window.partitionBy("term", "object")
    best = hits.withColumn("first", F.min("tier").over(w)).where("tier = first").withColumn("n", F.row_number().over(w.orderBy("ordinal"))).where("object is null or n = 1")
    exact = F.col("tier") == 0
    found = best.select("term", "object", "sobjectType", "apiName", F.when(exact, 1.0).otherwise(0.85).alias("similarity"), F.when(exact, "exact_match").otherwise("fuzzy_match").alias("source")).distinct()
    if vectors is None:
        return found
    near = asked.join(vectors.where(F.col("score") >= least), "term").where("object is null or object = sobjectType")
    near = near.withColumn("n", F.row_number().over(w.orderBy(F.desc("score"), "sobjectType", "apiName"))).where(F.col("n") <= top)
    known = found.select(F.col("term").alias("t2"), F.col("object").alias("o2")).distinct()
    rest = near.join(known, (F.col("term") == F.col("t2")) & F.col("object").eqNullSafe(F.col("o2")), "left_anti")
    return found.unionByName(rest.select("term", "object", "sobjectType", "apiName", F.col("score").alias("similarity"), F.lit("semantic").alias("source")))


# --- examples


def seed_examples(examples: DataFrame, model: str, embed=hash_embedding) -> DataFrame:
    """A new store of examples (id, question, soql, patterns): it replaces the
    old one, with each question's vector, the model's name and a content hash."""
    return examples.withColumn("embedding", embed(F.col("question"))).withColumn("embeddingModel", F.lit(model)).withColumn("contentHash", content_hash(F.col("question")))


def search_examples(store: DataFrame, query: Column, k: int, model: str) -> DataFrame:
    """id, score of the k nearest examples of the model, best first."""
    return store.where(F.col("embeddingModel") == model).select("id", cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def examples_with(store: DataFrame, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Examples by id, those of a pattern if one is named, ``limit`` at most."""
    x = store if pattern is None else store.where(F.array_contains("patterns", pattern))
    x = x.orderBy("id")
    return x if limit is None else x.limit(limit)


def without_examples(store: DataFrame) -> DataFrame:
    """The store emptied."""
    return store.where(F.lit(False))
