"""Comparing two orgs, scoring answers, making sample rows, listing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def compare_fields(a: DataFrame, b: DataFrame) -> DataFrame:
    """sobjectType, apiName, difference, sourceType, targetType of fields that differ; objects in both orgs only."""
    both = a.select("sobjectType").distinct().join(b.select("sobjectType").distinct(), "sobjectType")
    x = a.select("sobjectType", "apiName", F.col("type").alias("sourceType")).join(b.select("sobjectType", "apiName", F.col("type").alias("targetType")), ["sobjectType", "apiName"], "full_outer").join(both, "sobjectType", "left_semi")
    diff = F.when(F.col("targetType").isNull(), "only_in_source").when(F.col("sourceType").isNull(), "only_in_target").when(F.col("sourceType") != F.col("targetType"), "type_mismatch")
    return x.withColumn("difference", diff).where("difference is not null").select("sobjectType", "apiName", "difference", "sourceType", "targetType")


def compare_objects(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("apiName", F.lit(True).alias("s")).join(b.select("apiName", F.lit(True).alias("t")), "apiName", "full_outer")
    return x.select("apiName", F.when(F.col("t").isNull(), "only_in_source").when(F.col("s").isNull(), "only_in_target").otherwise("both").alias("status"))


def drift(a: DataFrame, a_fields: DataFrame, b: DataFrame, b_fields: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Objects whose label or number of fields differ, or that one org lacks."""
    def side(o: DataFrame, f: DataFrame, name: str) -> DataFrame:
        n = f.groupBy(F.col("sobjectType").alias("apiName")).agg(F.countDistinct(F.col("apiName")).alias("n"))
        return o.join(n, "apiName", "left").select("apiName", F.col("label").alias(f"{name}Label"), F.coalesce("n", F.lit(0)).alias(f"{name}FieldCount"))

    x = side(a, a_fields, "source").join(side(b, b_fields, "target"), "apiName", "full_outer")
    x = x.withColumn("onlyInSource", F.col("targetFieldCount").isNull()).withColumn("onlyInTarget", F.col("sourceFieldCount").isNull())
    differs = F.col("onlyInSource") | F.col("onlyInTarget") | (F.col("sourceLabel") != F.col("targetLabel")) | (F.col("sourceFieldCount") != F.col("targetFieldCount"))
    return x.where(differs if only is None else differs & F.col("apiName").isin(*only))


def org_flags(objects: DataFrame, source: str, target: str) -> DataFrame:
    has = lambda o: F.coalesce(F.max(F.col("orgId") == o), F.lit(False))
    return objects.agg(has(source).alias("sourceHasData"), has(target).alias("targetHasData"))


# --- evaluation


def case_scores(cases: DataFrame) -> DataFrame:
    """cases: id, expectedObject, object, expectedFields, fields, ok, and any other columns."""
    low = lambda c: F.transform(c, lambda x: F.lower(x))
    hits = F.size(F.filter(low("fields"), lambda f: F.array_contains(low("expectedFields"), f)))
    precision = F.when(F.size("fields") > 0, hits / F.size("fields")).otherwise(0.0)
    recall = F.when(F.size("expectedFields") > 0, hits / F.size("expectedFields")).otherwise(1.0)
    x = cases.withColumns({"objectScore": (F.lower("object") == F.lower("expectedObject")).cast("double"), "precision": precision, "recall": recall})
    x = x.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return x.withColumn("overall", (F.coalesce("objectScore", F.lit(0.0)) + F.col("f1") + F.col("ok").cast("double")) / 3)


def summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Total, successful and mean score, for every column of ``by`` alone and overall, in one pass."""
    agg = [F.count("*").alias("total"), F.count_if(F.col("overall") > 0.5).alias("successful"), F.avg("overall").alias("mean")]
    sets = [[F.col(c)] for c in by] + [[]]
    return scored.groupingSets(sets, *[F.col(c) for c in by]).agg(*agg)


def component_rates(scored: DataFrame, stages: list[str]) -> DataFrame:
    return scored.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in stages])


# --- sample rows


def sample_value(kind: str, name: str, seed: int, values: list[str] | None = None) -> Column:
    r = F.rand(seed)
    if kind in ("picklist", "multipicklist") and values:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(r * len(values)) + 1).cast("int"))
    number = {"int": F.floor(r * 1000), "double": F.round(r * 1000, 2), "currency": F.round(r * 100000, 2), "percent": F.round(r * 100, 1)}
    if kind in number:
        return number[kind]
    if kind == "boolean":
        return r < 0.5
    if kind == "date":
        return F.date_add(F.lit("2024-01-01").cast("date"), F.floor(r * 365).cast("int"))
    if kind == "datetime":
        return F.timestamp_seconds(F.lit(1704067200) + F.floor(r * 31536000))
    n = F.floor(r * 10000).cast("string")
    text = {"email": F.concat(F.lit("user"), n, F.lit("@example.com")), "phone": F.concat(F.lit("555-"), F.lpad(n, 4, "0")), "url": F.concat(F.lit("https://example.com/"), n), "id": F.lpad(n, 18, "0"), "reference": F.lpad(n, 18, "0")}
    return text.get(kind, F.concat(F.lit(f"Sample {name} "), n))


def sample_rows(spark: SparkSession, fields: list[tuple[str, str, bool]], n: int, seed: int = 42, values: dict[str, list[str]] | None = None, nulls: float = 0.1) -> DataFrame:
    """n rows of (name, type, nullable) fields; the same seed gives the same rows."""
    out = []
    for k, (name, kind, nullable) in enumerate(fields):
        c = sample_value(kind, name, seed + 2 * k, (values or {}).get(name))
        out.append((F.when(F.rand(seed + 2 * k + 1) >= nulls, c) if nullable else c).alias(name))
    return spark.range(n).select(F.col("id").alias("row"), *out)


def related_samples(spark: SparkSession, fields: dict[str, list[tuple[str, str, bool]]], refs: list[tuple[str, str]], primary: str, n: int, seed: int = 42) -> dict[str, DataFrame]:
    """n rows of the primary object, half as many (one at least) of each object that it refers to."""
    out = {primary: sample_rows(spark, fields[primary], n, seed)}
    for k, target in enumerate(dict.fromkeys(t for o, t in refs if o == primary and t != primary)):
        out[target] = sample_rows(spark, fields[target], max(1, n // 2), seed + 1000 * (k + 1))
    return out


# --- listings


def field_listing(fields: DataFrame, view: str = "flat", text: str | None = None) -> DataFrame:
    """sobjectType, grp, apiName ordered by group and name: flat, by type, by origin, required first."""
    group = {"flat": F.lit(""), "type": F.col("type"), "origin": F.when(F.col("apiName").endswith("__c"), "custom").otherwise("standard")}
    if "nillable" in fields.columns:
        group["required"] = F.when(F.col("nillable"), "1 optional").otherwise("0 required")
    x = fields if text is None else fields.where(F.lower("apiName").contains(text.lower()) | F.lower("label").contains(text.lower()))
    return x.select("sobjectType", group[view].alias("grp"), "apiName").orderBy("sobjectType", "grp", "apiName")


def filter_hints(refs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Example filters on an object by parent and by picklist."""
    parent = refs.where(F.col("sourceObject") == name).select(F.format_string("%s.Name LIKE '...'", "relationshipName").alias("hint"))
    pick = values.where(F.col("objectApiName") == name).groupBy("fieldApiName").agg(F.min("value").alias("v")).select(F.format_string("%s = '%s'", "fieldApiName", "v").alias("hint"))
    return parent.unionByName(pick).distinct()
