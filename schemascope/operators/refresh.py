"""Bringing a catalog up to date from describe results: one object or all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ingest, merge

OBJECT_KEYS = ["apiName", "orgId"]
FIELD_KEYS = ["apiName", "sobjectType", "orgId"]


def ownership(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """object, field, orgId edges, each once; fields without their object have none."""
    owner = objects.select(F.col("apiName").alias("sobjectType"), "orgId").distinct()
    return fields.join(owner, ["sobjectType", "orgId"]).select(F.col("sobjectType").alias("object"), F.col("apiName").alias("field"), "orgId").distinct()


def one_object(describes: DataFrame, name: str) -> DataFrame:
    return describes.where(F.lower("objectName") == name.lower())


def refresh_object(objects: DataFrame, fields: DataFrame, picklists: DataFrame, describes: DataFrame, name: str, org: str, stamp: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(objects, fields, picklists, counts) after one object is described anew.

    Its row and its fields are upserted and its picklist values replaced; other
    objects stay. counts: created, updated, fields, values, dependencies.
    """
    own = one_object(describes, name)
    rows, parts, values = ingest.object_rows(own, org), ingest.field_rows(own, org), ingest.picklist_rows(own, org)
    known = not objects.where((F.lower("apiName") == name.lower()) & (F.col("orgId") == org)).isEmpty()
    kept = picklists.where(~((F.lower("objectApiName") == name.lower()) & (F.col("orgId") == org)))
    counts = rows.agg(F.lit(not known).alias("created"), F.lit(known).alias("updated")).crossJoin(parts.agg(F.count("*").alias("fields"))).crossJoin(values.agg(F.count("*").alias("values"))).crossJoin(ingest.dependency_rows(own, org).agg(F.count("*").alias("dependencies")))
    return merge.upsert(objects, rows, OBJECT_KEYS, stamp), merge.upsert(fields, parts, FIELD_KEYS, stamp), kept.unionByName(values, allowMissingColumns=True), counts


def sync_relationships(objects: DataFrame, refs: DataFrame, describes: DataFrame, children: DataFrame, name: str, org: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(objects with stubs for unknown targets, field edges, rollup) after one
    object's references are read anew; the rollup has the child relationship
    names that its targets' describes give (objectName, childObject,
    fieldApiName, relationshipName)."""
    new = ingest.reference_rows(one_object(describes, name), org)
    named = children.select(F.col("objectName").alias("targetObject"), F.col("childObject").alias("sourceObject"), F.col("fieldApiName").alias("fieldName"), F.col("relationshipName").alias("childName"))
    new = new.join(named, ["targetObject", "sourceObject", "fieldName"], "left").select("sourceObject", "fieldName", "targetObject", "relationshipName", "childName", "relationshipType", "orgId")
    edges = refs.where(~((F.lower("sourceObject") == name.lower()) & (F.col("orgId") == org))).select(*new.columns).unionByName(new)
    return merge.with_stubs(objects, edges), edges, merge.rollup(edges)


def assign_categories(assigned: DataFrame, new: DataFrame) -> DataFrame:
    """Category assignments (apiName, category, confidence, source, rule) upserted by object and category."""
    return merge.upsert(assigned, new.select(*assigned.columns), ["apiName", "category"])


def full_load(old: DataFrame, new: DataFrame) -> DataFrame:
    """The store wiped and filled anew: the new rows in the old columns, whatever was there before."""
    return old.where(F.lit(False)).unionByName(new, allowMissingColumns=True)


def describe_report(listing: DataFrame, describes: DataFrame, failed: DataFrame) -> DataFrame:
    """name, state of every listed object: described, failed (failed: name, reason) or missing. The rest goes on."""
    done = describes.select(F.col("objectName").alias("name"), F.lit("described").alias("done")).distinct()
    x = listing.select("name").join(done, "name", "left").join(failed.select("name", "reason"), "name", "left")
    return x.select("name", F.coalesce("done", F.when(F.col("reason").isNotNull(), F.lit("failed")), F.lit("missing")).alias("state"), "reason")


def node_keys(kind: str) -> tuple[str, list[str]]:
    """Node name and identifying columns of a metadata type, from the registry."""
    from ..sources.catalog import HANDLERS

    if kind not in HANDLERS:
        raise LookupError(f"no handler for {kind}")
    name, keys = HANDLERS[kind]
    return name, list(keys)


def not_unique(kind: str, table: DataFrame) -> DataFrame:
    """Rows of a metadata type that its identifying columns don't tell apart."""
    return merge.duplicate_keys(table, node_keys(kind)[1])
