"""Described metadata -> catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import naming


def object_rows(describes: DataFrame, org: str) -> DataFrame:
    n = F.col("objectName")
    return describes.select(n.alias("apiName"), F.lit(org).alias("orgId"), F.coalesce("describe.label", n).alias("label"), naming.category(n).alias("category"), naming.subtype(n).alias("subtype"), naming.namespace(n).alias("namespace"), naming.parent_name(n).alias("parentObjectName"), F.col("describe.keyPrefix").alias("keyPrefix"))


def _fields(describes: DataFrame) -> DataFrame:
    return describes.select("objectName", F.posexplode("describe.fields").alias("ordinal", "f"))


def field_rows(describes: DataFrame, org: str) -> DataFrame:
    flag = lambda c, default: F.coalesce(f"f.{c}", F.lit(default)).alias(c)
    targets = F.when(F.size("f.referenceTo") > 0, F.col("f.referenceTo"))
    return _fields(describes).select(
        F.col("f.name").alias("apiName"), F.col("objectName").alias("sobjectType"), F.lit(org).alias("orgId"), F.coalesce("f.label", "f.name").alias("label"), F.col("f.type").alias("type"), flag("nillable", False), flag("unique", False),
        naming.field_category(F.col("f.name")).alias("category"), naming.namespace(F.col("f.name")).alias("namespace"), targets.alias("referenceTo"), F.col("f.relationshipName").alias("relationshipName"),
        naming.relationship_type(targets, F.col("objectName"), F.col("f.relationshipOrder"), F.col("f.cascadeDelete")).alias("relationshipType"), flag("calculated", False), flag("filterable", True), flag("sortable", True), flag("groupable", True),
        "f.length", "f.precision", "f.scale", F.col("f.controllerName").alias("controllerName"), F.coalesce("f.dependentPicklist", F.lit(False)).alias("isDependentPicklist"),
    )


def reference_rows(describes: DataFrame, org: str) -> DataFrame:
    """A row for each field and target."""
    x = field_rows(describes, org).select(F.col("sobjectType").alias("sourceObject"), F.col("apiName").alias("fieldName"), "relationshipName", "relationshipType", "orgId", F.explode("referenceTo").alias("targetObject"))
    t = F.col("targetObject")
    return x.withColumns({"targetCategory": naming.category(t), "targetSubtype": naming.subtype(t), "targetNamespace": naming.namespace(t), "targetParentObjectName": naming.parent_name(t)})


def picklist_rows(describes: DataFrame, org: str) -> DataFrame:
    """The first of equal values of a field."""
    x = _fields(describes).where(F.col("f.type").isin("picklist", "multipicklist")).select("objectName", "f.name", F.posexplode("f.picklistValues").alias("at", "v"))
    w = Window.partitionBy("objectName", "name", "v.value").orderBy("at")
    first = x.withColumn("n", F.row_number().over(w)).where("n = 1")
    return first.select(F.col("objectName").alias("objectApiName"), F.col("name").alias("fieldApiName"), F.col("v.value").alias("value"), F.coalesce("v.label", "v.value").alias("label"), F.coalesce("v.active", F.lit(True)).alias("isActive"), F.coalesce("v.defaultValue", F.lit(False)).alias("defaultValue"), F.col("v.validFor").alias("validFor"), F.lit(org).alias("orgId"))


def dependency_rows(describes: DataFrame, org: str) -> DataFrame:
    return _fields(describes).where("f.controllerName is not null").select(F.col("f.name").alias("sourceField"), F.col("f.controllerName").alias("controllerField"), F.col("objectName").alias("objectName"), F.lit(org).alias("orgId"))


def clean_xml(c):
    """An element's text without control characters and outer white space."""
    return F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), "^\\s+|\\s+$", "")


def validation_rule_rows(rules: DataFrame, org: str) -> DataFrame:
    return rules.select(F.col("fullName"), F.split_part("fullName", F.lit("."), F.lit(1)).alias("objectApiName"), F.split_part("fullName", F.lit("."), F.lit(2)).alias("name"), F.coalesce("active", F.lit(False)).alias("active"), clean_xml(F.col("errorConditionFormula")).alias("errorConditionFormula"), clean_xml(F.col("errorMessage")).alias("errorMessage"), F.lit(org).alias("orgId"))
