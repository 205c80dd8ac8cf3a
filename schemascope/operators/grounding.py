"""Grounding values of a question in the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..plans.staging import bounded


def by_pattern(terms: DataFrame) -> DataFrame:
    x = terms.withColumn("p", V.pattern(F.col("term"))).where("p is not null")
    return x.select("term", V.grounding_type(F.col("p")).alias("type"), F.col("p.confidence").alias("confidence"), V.suggested_filter(F.col("p")).alias("filter"))


def by_picklist(terms: DataFrame, picklists: DataFrame, categories: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Values equal (1.0), beginning with (0.9) or holding (0.7) the term; times the category's weight."""
    p = picklists.where("isActive").select("objectApiName", "fieldApiName", "value", F.lower("value").alias("v"))
    t = terms.select("term", F.lower(F.trim("term")).alias("t")).where("t != ''")
    score = F.when(F.col("v") == F.col("t"), 1.0).when(F.col("v").startswith(F.col("t")), 0.9).otherwise(0.7)
    # the values come from data columns, so the terms are the side to send
    x = p.join(bounded(t), F.col("v").contains(F.col("t"))).withColumn("score", score)
    if categories is not None:
        x = x.join(bounded(categories.select(F.col("apiName").alias("objectApiName"), "category")), "objectApiName", "left").withColumn("score", F.col("score") * V.category_weight(F.col("category")))
    w = Window.partitionBy("term").orderBy(F.desc("score"), "objectApiName", "fieldApiName", "value")
    x = x.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return x.select("term", F.lit("picklist_value").alias("type"), F.col("score").alias("confidence"), F.format_string("%s.%s = '%s'", "objectApiName", "fieldApiName", "value").alias("filter"))


def by_object(terms: DataFrame, objects: DataFrame) -> DataFrame:
    t = terms.select("term", F.lower(F.trim("term")).alias("t")).where("t != ''")
    o = objects.select("apiName", F.lower("apiName").alias("a"), F.lower("label").alias("l"))
    score = F.when((F.col("a") == F.col("t")) | (F.col("l") == F.col("t")), 0.95).when(F.col("a") == F.concat("t", F.lit("__c")), 0.9).when(F.col("a").startswith(F.col("t")), 0.85).when(F.col("a").contains(F.col("t")), 0.7)
    x = t.join(bounded(o), score.isNotNull()).withColumn("score", score)
    w = Window.partitionBy("term").orderBy(F.desc("score"), "apiName")
    return x.withColumn("n", F.row_number().over(w)).where("n = 1").select("term", F.lit("object_reference").alias("type"), F.col("score").alias("confidence"), F.concat(F.lit("FROM "), "apiName").alias("filter"))


def ground(terms: DataFrame, picklists: DataFrame, objects: DataFrame, categories: DataFrame | None = None, names: DataFrame | None = None, least: float = 0.5, top: int = 5) -> DataFrame:
    """term, rank, type, confidence, filter. ``names``: (term, filter, confidence) of a name search, used where nothing passes 0.85."""
    t = terms.select("term").distinct()
    found = by_pattern(t).unionByName(by_picklist(t, picklists, categories)).unionByName(by_object(t, objects).where("confidence > 0.7"))
    if names is not None:
        sure = found.where("confidence > 0.85").select("term").distinct()
        found = found.unionByName(names.join(sure, "term", "left_anti").select("term", F.lit("company_name").alias("type"), "confidence", "filter"))
    w = Window.partitionBy("term").orderBy(F.desc("confidence"), "type", "filter")
    return found.where(F.col("confidence") >= least).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= top)


def related_context(refs: DataFrame, categories: DataFrame, context: list[str]) -> DataFrame:
    """Objects relevant to a context: linked either way, or business like it."""
    linked = refs.where(F.col("targetObject").isin(*context)).select(F.col("sourceObject").alias("apiName")).unionByName(refs.where(F.col("sourceObject").isin(*context)).select(F.col("targetObject").alias("apiName")))
    return linked.unionByName(categories.where("category in ('business_core', 'business_extended')").select("apiName")).distinct()


# Kinds of entity for kinds of grounding.
ENTITY_OF = {
    "account_name": "company_name", "company_name": "company_name", "contact_name": "person_name", "person_name": "person_name", "picklist_value": "status_value",
    "priority_value": "priority_value", "status_value": "status_value", "object_reference": "object_reference", "date_reference": "date_reference",
    "numeric_value": "numeric_value", "id_reference": "object_reference", "field_reference": "unknown",
}


def entities(terms: DataFrame, grounded: DataFrame) -> DataFrame:
    """term, entity, confidence: the best grounding, else a company's name for a capitalised word (0.6), else unknown (0.3)."""
    best = grounded.where("rank = 1").select("term", F.coalesce(V.lookup(ENTITY_OF, F.col("type")), F.lit("unknown")).alias("entity"), "confidence")
    capital = F.col("term").rlike("^[A-Z][a-z]+")
    x = terms.select("term").distinct().join(best, "term", "left")
    return x.select("term", F.coalesce("entity", F.when(capital, "company_name").otherwise("unknown")).alias("entity"), F.coalesce("confidence", F.when(capital, 0.6).otherwise(0.3)).alias("confidence"))


def notes(grounded: DataFrame) -> DataFrame:
    return grounded.where("rank = 1").select("term", F.concat(F.lit('"'), "term", F.lit('" is a '), F.replace(F.col("type"), F.lit("_"), F.lit(" ")), F.lit(": "), "filter").alias("note"))


def name_search(tables: dict[str, tuple[DataFrame, str]], term: str, limit: int = 5) -> DataFrame:
    """object, name, exact: records whose name holds the term, ``limit`` of each object."""
    out = None
    for name, (df, col) in sorted(tables.items()):
        part = df.where(F.lower(col).contains(term.lower())).select(F.lit(name).alias("object"), F.col(col).alias("name"), (F.lower(col) == term.lower()).alias("exact")).orderBy(F.desc("exact"), "name").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out
