"""Upserts, soft deletion and rollups: each gives a new snapshot of a table.

Plain files have no row-level merge, so a snapshot is written to a new place
and swapped; nothing here writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: Column | None = None, stamp_col: str = "lastRefreshed") -> DataFrame:
    """Old rows with the new ones in place of those of equal keys, or added."""
    if stamp is not None:
        new = new.withColumn(stamp_col, stamp)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_stats(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """created, updated, total."""
    o = old.select(*keys, F.lit(True).alias("_old")).distinct()
    x = new.select(*keys).distinct().join(o, keys, "left")
    return x.agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("updated"), F.count("*").alias("total"))


def with_stubs(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """objects and a stub for each target that isn't one."""
    missing = refs.select(F.col("targetObject").alias("apiName"), "orgId").distinct().join(objects, ["apiName", "orgId"], "left_anti")
    return objects.unionByName(missing.withColumn("label", F.col("apiName")), allowMissingColumns=True)


def edge_type(kind: Column) -> Column:
    return F.when(kind == "MasterDetail", F.lit("MASTER_DETAIL")).otherwise(F.lit("LOOKS_UP"))


def rollup(refs: DataFrame) -> DataFrame:
    """Object to object: distinct fields, strongest type, number of fields, child names."""
    x = refs.groupBy("sourceObject", "targetObject", "orgId").agg(F.sort_array(F.collect_set("fieldName")).alias("fields"), F.max(F.when(edge_type(F.col("relationshipType")) == "MASTER_DETAIL", 1).otherwise(0)).alias("m"), F.sort_array(F.collect_set("childName")).alias("childRelationshipNames"))
    return x.select("sourceObject", "targetObject", "orgId", "fields", F.when(F.col("m") == 1, "MASTER_DETAIL").otherwise("LOOKS_UP").alias("relationshipType"), F.size("fields").alias("fieldCount"), "childRelationshipNames")


def derived_from(objects: DataFrame) -> DataFrame:
    parents = objects.select(F.col("apiName").alias("parent"), "orgId")
    return objects.where("parentObjectName is not null").select("apiName", "orgId", F.col("parentObjectName").alias("parent")).join(parents, ["parent", "orgId"])


def replace_picklists(old: DataFrame, new: DataFrame, fields: DataFrame) -> DataFrame:
    """Values of the new rows' orgs replaced; rows without a field dropped."""
    known = fields.select(F.col("sobjectType").alias("objectApiName"), F.col("apiName").alias("fieldApiName"), "orgId")
    kept = old.join(new.select("orgId").distinct(), "orgId", "left_anti")
    return kept.unionByName(new.join(known, ["objectApiName", "fieldApiName", "orgId"], "left_semi").select(*old.columns))


def controller_edges(dependencies: DataFrame, fields: DataFrame) -> DataFrame:
    f = fields.select(F.col("sobjectType").alias("objectName"), F.col("apiName").alias("controllerField"), "orgId")
    return dependencies.join(f, ["objectName", "controllerField", "orgId"], "left_semi")


def enrich_picklists(values: DataFrame, statuses: DataFrame) -> DataFrame:
    """statuses: objectApiName, fieldApiName, value and attributes."""
    return values.join(statuses, ["objectApiName", "fieldApiName", "value"], "left")


def soft_delete(table: DataFrame, current: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Rows that ``current`` lacks become deleted; those deleted before keep their time."""
    here = current.select(*keys, F.lit(True).alias("_here")).distinct()
    x = table.join(here, keys, "left")
    gone = F.col("_here").isNull() & ~F.coalesce(F.col("deleted"), F.lit(False))
    return x.withColumn("deletedAt", F.when(gone, at).otherwise(F.col("deletedAt"))).withColumn("deleted", gone | F.coalesce(F.col("deleted"), F.lit(False))).drop("_here")


def soft_delete_fields(fields: DataFrame, objects: DataFrame, at: Column) -> DataFrame:
    """Fields follow when no live object owns them."""
    live = objects.where("not deleted").select(F.col("apiName").alias("sobjectType"), "orgId")
    return soft_delete(fields, live, ["sobjectType", "orgId"], at)


def rebuild_rollup(refs: DataFrame, fields: DataFrame) -> DataFrame:
    live = fields.where("not deleted").select(F.col("sobjectType").alias("sourceObject"), F.col("apiName").alias("fieldName"), "orgId")
    return rollup(refs.join(live, ["sourceObject", "fieldName", "orgId"], "left_semi"))


def clear_org(table: DataFrame, org: str) -> DataFrame:
    return table.where(F.col("orgId") != org)


def apply_documentation(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """docs: sobjectType, apiName, docText, properties. Fills empty descriptions and sets flags."""
    x = fields.join(docs, ["sobjectType", "apiName"], "left")
    flag = lambda c, p: F.when(F.col("properties").isNotNull(), F.array_contains("properties", p)).otherwise(F.col(c)).alias(c)
    others = [c for c in fields.columns if c not in ("description", "filterable", "sortable", "groupable")]
    return x.select(*others, F.coalesce(F.nullif("description", F.lit("")), "docText").alias("description"), flag("filterable", "Filter"), flag("sortable", "Sort"), flag("groupable", "Group"))


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that aren't unique: the check behind a uniqueness constraint."""
    return table.groupBy(*keys).count().where("count > 1")


def global_summary(objects: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """apiName and degree of the objects with most edges, both directions."""
    ends = edges.select(F.col("sourceObject").alias("apiName")).unionByName(edges.select(F.col("targetObject").alias("apiName")))
    total = objects.agg(F.count("*").alias("objectCount"))
    return ends.groupBy("apiName").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "apiName").limit(top).crossJoin(F.broadcast(total))


def changed_vectors(texts: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose text's hash isn't the stored one: those to embed again."""
    x = texts.where("text is not null").withColumn("hash", F.sha2("text", 256))
    return x.join(stored.select(*keys, "hash"), [*keys, "hash"], "left_anti")


def latest(table: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return table.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
