"""Categories of objects and fields by rules; intent and anti-patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Core and administrative objects.
CORE_OBJECTS = ["Account", "Contact", "Lead", "Opportunity", "Case", "Task", "Event", "User", "Campaign", "Product2", "Pricebook2", "Contract", "Order", "Asset", "Quote", "ContentDocument", "ContentVersion"]
SETUP_OBJECTS = [
    "AuthProvider", "AuthSession", "LoginHistory", "LoginGeo", "SetupAuditTrail", "PermissionSet", "PermissionSetAssignment", "PermissionSetGroup", "PermissionSetLicense",
    "PermissionSetLicenseAssign", "Profile", "UserRole", "TwoFactorInfo", "SessionPermSetActivation", "ConnectedApplication", "OauthToken", "VerificationHistory", "ApexClass",
    "ApexTrigger", "ApexPage", "ApexComponent", "CustomField", "CustomObject", "CustomTab", "CustomPermission", "FieldPermissions", "ObjectPermissions", "SetupEntityAccess",
    "UserPackageLicense", "PackageLicense", "TenantSecret", "NamedCredential", "ExternalDataSource", "PlatformCachePartition",
]
SYSTEM_NAMESPACES = ["Tooling", "Metadata", "ApexLog", "AsyncApexJob", "CronTrigger", "CronJobDetail"]
# Fixed values: (id, type, target, category, confidence, priority).
OBJECT_RULES = [
    ("core_business_objects", "NAME", "^(" + "|".join(CORE_OBJECTS) + ")$", "business_core", 0.98, 100),
    ("setup_admin_objects", "NAME", "^(" + "|".join(SETUP_OBJECTS) + ")$", "system", 0.95, 98),
    ("system_derived_from_category", "CATEGORY", "system", "system_derived", 0.95, 95),
    ("custom_metadata_from_category", "CATEGORY", "metadata_type", "custom_metadata", 0.99, 95),
    ("platform_event_from_category", "CATEGORY", "platform_event", "platform_event", 0.99, 95),
    ("external_object_from_category", "CATEGORY", "external", "external_object", 0.99, 95),
    ("system_namespace", "NAMESPACE", "Tooling|Metadata", "system", 0.95, 85),
    ("managed_package", "NAMESPACE", ".+", "managed_package", 0.9, 80),
    ("business_extended_account", "LOOKUP", "Account", "business_extended", 0.85, 70),
    ("business_extended_contact", "LOOKUP", "Contact", "business_extended", 0.85, 70),
    ("business_extended_opportunity", "LOOKUP", "Opportunity", "business_extended", 0.85, 70),
    ("standard_business_objects", "CATEGORY", "standard", "business_core", 0.7, 50),
    ("custom_unlinked", "CATEGORY", "custom", "business_extended", 0.6, 40),
]
FIELD_RULES = [
    ("field_lifecycle_status", "CONTAINS", "Status", "lifecycle", 0.9, 75),
    ("field_lifecycle_stage", "CONTAINS", "Stage", "lifecycle", 0.9, 75),
    ("field_lifecycle_phase", "CONTAINS", "Phase", "lifecycle", 0.85, 74),
    ("field_financial_amount", "CONTAINS", "Amount", "financial", 0.9, 75),
    ("field_financial_revenue", "CONTAINS", "Revenue", "financial", 0.9, 75),
    ("field_financial_price", "CONTAINS", "Price", "financial", 0.85, 74),
    ("field_temporal_date", "TYPE", "date", "temporal", 0.95, 70),
    ("field_temporal_datetime", "TYPE", "datetime", "temporal", 0.95, 70),
]
# Words that show what a question is about.
BUSINESS_WORDS = ["customer", "client", "sale", "deal", "opportunity", "lead", "contact", "account", "revenue", "pipeline", "forecast", "quota"]
SYSTEM_WORDS = ["debug", "log", "error", "trace", "monitor", "audit", "system", "admin", "setup", "metadata"]

_SCHEMA = "rule string, kind string, target string, assigned string, confidence double, priority int"


def rules(spark: SparkSession, table: list[tuple]) -> DataFrame:
    return spark.createDataFrame(table, _SCHEMA)


def assignments(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident match of each category, ranked; rank 1 is the primary one."""
    one = matched.groupBy(*keys, "assigned").agg(F.max(F.struct("confidence", "priority", "rule")).alias("m"))
    w = Window.partitionBy(*keys).orderBy(F.desc("m.confidence"), F.desc("m.priority"), "assigned")
    return one.select(*keys, F.col("assigned").alias("category"), F.col("m.confidence").alias("confidence"), F.col("m.rule").alias("rule"), F.row_number().over(w).cast("int").alias("rank"))


def tag_objects(objects: DataFrame, refs: DataFrame, table: DataFrame) -> DataFrame:
    """objects: apiName, category, namespace, deleted flags ignored. table: rules, few by nature, broadcast."""
    lookups = refs.groupBy(F.col("sourceObject").alias("apiName")).agg(F.collect_set("targetObject").alias("lookups"))
    x = objects.select("apiName", F.col("category").alias("kindOf"), "namespace").join(lookups, "apiName", "left")
    fits = (
        F.when(F.col("kind") == "NAME", F.rlike("apiName", F.col("target")))
        .when(F.col("kind") == "CATEGORY", F.col("kindOf") == F.col("target"))
        .when(F.col("kind") == "NAMESPACE", F.when(F.col("target") == ".+", F.col("namespace").isNotNull() & ~F.col("namespace").isin(*SYSTEM_NAMESPACES)).otherwise(F.rlike("namespace", F.concat(F.lit("^("), "target", F.lit(")$")))))
        .when(F.col("kind") == "LOOKUP", F.array_contains("lookups", F.col("target")))
    )
    return assignments(x.join(F.broadcast(table), F.coalesce(fits, F.lit(False))), ["apiName"])


def tag_fields(fields: DataFrame, table: DataFrame) -> DataFrame:
    fits = F.when(F.col("kind") == "CONTAINS", F.lower("apiName").contains(F.lower("target"))).otherwise(F.col("type") == F.col("target"))
    x = fields.select("sobjectType", "apiName", "type").join(F.broadcast(table), fits)
    return assignments(x, ["sobjectType", "apiName"])


def _hits(text: Column, words: list[str]) -> Column:
    return F.aggregate(F.array(*[F.contains(text, F.lit(w)).cast("int") for w in words]), F.lit(0), lambda a, b: a + b)


def intent(text: Column) -> Column:
    low = F.lower(text)
    b, s = _hits(low, BUSINESS_WORDS), _hits(low, SYSTEM_WORDS)
    return F.when(b > s, "business").when(s > b, "system").otherwise("unknown")


def anti_patterns(objects: DataFrame, question: Column) -> DataFrame:
    """apiName, warning, severity for objects (apiName, category as assigned) in a question."""
    low, c = F.lower(question), F.col("category")
    settings = low.contains("metadata") | low.contains("configuration") | low.contains("setting")
    entry = lambda kind, severity: F.struct(F.lit(kind).alias("warning"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(
        F.when(c.isin("system", "system_derived") & (intent(question) == "business"), entry("system_object_query", "warning")),
        F.when((c == "custom_metadata") & ~settings, entry("metadata_type_data_query", "error")),
        F.when(c == "platform_event", entry("category_mismatch", "error")),
    ))
    return objects.select("apiName", "category", F.explode(found).alias("w")).select("apiName", "category", "w.warning", "w.severity")


# Query and filter templates by category.
TEMPLATES = {
    "business_core": "SELECT Id, Name, {fields} FROM {object} WHERE {filter}",
    "business_extended": "SELECT Id, Name, {lookupField} FROM {object} WHERE {lookupField} = '{lookupValue}'",
    "system": "SELECT Id, {fields} FROM {object} WHERE CreatedDate = TODAY",
    "system_derived": "SELECT Id, ParentId, {fields} FROM {object}Feed WHERE ParentId = '{parentId}'",
    "managed_package": "SELECT Id, Name, {namespace}__{field} FROM {namespace}__{object}",
    "custom_metadata": "SELECT Id, DeveloperName, MasterLabel, {fields} FROM {object}",
    "platform_event": "// Platform Events are published, not queried",
    "big_object": "SELECT Id, {fields} FROM {object} WHERE {indexedField} = '{value}'",
    "external_object": "SELECT Id, ExternalId, {fields} FROM {object}",
    "lifecycle": "{field} = '{value}'",
    "user_context": "OwnerId = '{userId}' OR OwnerId IN (SELECT Id FROM User WHERE {filter})",
    "temporal": "{field} {operator} {date_literal}",
    "financial": "{field} {operator} {value}",
    "identity": "Id = '{recordId}' OR Id IN ({subquery})",
    "content": "SELECT Id, Title, {fields} FROM ContentDocument WHERE {filter}",
}


def soql_pattern(category: Column, **values: Column) -> Column:
    """The category's template with its placeholders filled from ``values``;
    others stay. Null for an unknown category."""
    out = F.element_at(F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv]), category)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def tag_all(objects: DataFrame, refs: DataFrame, table: DataFrame) -> DataFrame:
    """category, objects, primaries, unassigned: what tagging all objects gave,
    one row for each category and one, with a null category, for objects without any."""
    tagged = tag_objects(objects, refs, table)
    by = tagged.groupBy("category").agg(F.count("*").alias("objects"), F.count_if(F.col("rank") == 1).alias("primaries"))
    rest = objects.join(tagged, "apiName", "left_anti").agg(F.count("*").alias("objects"))
    return by.unionByName(rest.select(F.lit(None).cast("string").alias("category"), "objects", F.lit(0).cast("long").alias("primaries")))
