"""The catalog: metadata tables of the supplied star schema, and readers of described metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compile import Object, Polymorphic, Records
from ..plans.staging import staged

#: name -> (table, key, label)
OBJECTS = {
    "Region": ("region", "r_regionkey", "Region"),
    "Nation": ("nation", "n_nationkey", "Nation"),
    "Customer": ("customer", "c_custkey", "Customer"),
    "Supplier": ("supplier", "s_suppkey", "Supplier"),
    "Part": ("part", "p_partkey", "Part"),
    "Order": ("orders", "o_orderkey", "Sales Order"),
    "Lineitem": ("lineitem", None, "Line Item"),
    "Event": ("events", "event_id", "Event"),
    "Document": ("documents", "doc_id", "Document"),
    "Label": ("labels", "doc_id", "Quality Label"),
}
#: (object, field, target, relationship, child relationship, kind)
REFERENCES = [
    ("Nation", "n_regionkey", "Region", "Region", "Nations", "Lookup"),
    ("Customer", "c_nationkey", "Nation", "Nation", "Customers", "Lookup"),
    ("Supplier", "s_nationkey", "Nation", "Nation", "Suppliers", "Lookup"),
    ("Order", "o_custkey", "Customer", "Customer", "Orders", "Lookup"),
    ("Lineitem", "l_orderkey", "Order", "Order", "Lineitems", "MasterDetail"),
    ("Lineitem", "l_partkey", "Part", "Part", "Lineitems", "Lookup"),
    ("Lineitem", "l_suppkey", "Supplier", "Supplier", "Lineitems", "Lookup"),
    ("Event", "user_id", "Customer", "Who", "Events", "Lookup"),
    ("Event", "user_id", "Supplier", "Who", "Events", "Lookup"),
    ("Label", "doc_id", "Document", "Document", "Labels", "Lookup"),
]
WHO_TAG = "CASE WHEN event_type IN ('purchase', 'signup') THEN 'Customer' ELSE 'Supplier' END"
PICKLISTS = [("Order", "o_orderstatus"), ("Order", "o_orderpriority"), ("Customer", "c_mktsegment"), ("Event", "event_type"), ("Lineitem", "l_returnflag")]
STATUS_LABELS = {"O": "Open", "F": "Fulfilled", "P": "Pending"}

#: (object, field, described type) in the order of the tables' columns
FIELDS = [
    ("Region", "r_regionkey", "int"), ("Region", "r_name", "string"),
    ("Nation", "n_nationkey", "int"), ("Nation", "n_name", "string"), ("Nation", "n_regionkey", "reference"),
    ("Customer", "c_custkey", "int"), ("Customer", "c_name", "string"), ("Customer", "c_nationkey", "reference"), ("Customer", "c_acctbal", "currency"), ("Customer", "c_mktsegment", "picklist"),
    ("Supplier", "s_suppkey", "int"), ("Supplier", "s_name", "string"), ("Supplier", "s_nationkey", "reference"), ("Supplier", "s_acctbal", "currency"),
    ("Part", "p_partkey", "int"), ("Part", "p_name", "string"), ("Part", "p_brand", "string"), ("Part", "p_type", "string"), ("Part", "p_size", "int"), ("Part", "p_retailprice", "currency"),
    ("Order", "o_orderkey", "int"), ("Order", "o_custkey", "reference"), ("Order", "o_orderstatus", "picklist"), ("Order", "o_totalprice", "currency"), ("Order", "o_orderdate", "datetime"), ("Order", "o_orderpriority", "picklist"),
    ("Lineitem", "l_orderkey", "reference"), ("Lineitem", "l_partkey", "reference"), ("Lineitem", "l_suppkey", "reference"), ("Lineitem", "l_linenumber", "int"), ("Lineitem", "l_quantity", "double"), ("Lineitem", "l_extendedprice", "currency"), ("Lineitem", "l_discount", "percent"), ("Lineitem", "l_tax", "percent"), ("Lineitem", "l_returnflag", "picklist"), ("Lineitem", "l_linestatus", "string"), ("Lineitem", "l_shipdate", "datetime"),
    ("Event", "event_id", "int"), ("Event", "ts", "datetime"), ("Event", "user_id", "reference"), ("Event", "event_type", "picklist"), ("Event", "value", "double"), ("Event", "props", "textarea"),
    ("Document", "doc_id", "int"), ("Document", "text", "textarea"), ("Document", "lang", "string"), ("Document", "source", "string"), ("Document", "n_chars", "int"),
    ("Label", "doc_id", "reference"), ("Label", "quality", "int"), ("Label", "toxic", "int"),
]

ORG = "main"

#: What a describe snapshot holds for each field.
FIELD_TYPE = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("name", "label", "type")],
    *[T.StructField(c, T.BooleanType()) for c in ("nillable", "unique")],
    T.StructField("referenceTo", T.ArrayType(T.StringType())), T.StructField("relationshipName", T.StringType()), T.StructField("relationshipOrder", T.IntegerType()),
    *[T.StructField(c, T.BooleanType()) for c in ("cascadeDelete", "calculated", "filterable", "sortable", "groupable")],
    *[T.StructField(c, T.IntegerType()) for c in ("length", "precision", "scale")],
    T.StructField("controllerName", T.StringType()), T.StructField("dependentPicklist", T.BooleanType()),
    T.StructField("picklistValues", T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("label", T.StringType()), T.StructField("active", T.BooleanType()), T.StructField("defaultValue", T.BooleanType()), T.StructField("validFor", T.StringType())]))),
])
CHILD_TYPE = T.StructType([T.StructField("childSObject", T.StringType()), T.StructField("field", T.StringType()), T.StructField("relationshipName", T.StringType()), T.StructField("cascadeDelete", T.BooleanType())])
DESCRIBE = T.StructType([
    T.StructField("objectName", T.StringType()),
    T.StructField("describe", T.StructType([*[T.StructField(c, T.StringType()) for c in ("name", "label", "keyPrefix")], T.StructField("queryable", T.BooleanType()), T.StructField("fields", T.ArrayType(FIELD_TYPE)), T.StructField("childRelationships", T.ArrayType(CHILD_TYPE))])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def records(spark: SparkSession, sf_dir: str) -> Records:
    """The supplied tables as objects of the SOQL compiler."""
    out = []
    for name, (table, key, _) in OBJECTS.items():
        parents = {rel: (f, t) for o, f, t, rel, _, _ in REFERENCES if o == name and rel != "Who"}
        children = {child: (o, f) for o, f, t, rel, child, _ in REFERENCES if t == name and rel != "Who"}
        poly = {"Who": Polymorphic("user_id", WHO_TAG, ("Customer", "Supplier"))} if name == "Event" else {}
        out.append(Object(name, read(spark, sf_dir, table), key, parents, children, poly, {"o_orderstatus": STATUS_LABELS} if name == "Order" else {}))
    return Records(out)


def objects(spark: SparkSession, org: str = ORG) -> DataFrame:
    return spark.createDataFrame([(n, org, label, "standard", False) for n, (_, _, label) in OBJECTS.items()], "apiName string, orgId string, label string, category string, deleted boolean")


def fields(spark: SparkSession, org: str = ORG) -> DataFrame:
    targets: dict[tuple[str, str], list[str]] = {}
    for o, f, t, *_ in REFERENCES:
        targets.setdefault((o, f), []).append(t)
    rows = [(f, o, org, f, k, targets.get((o, f)), i) for i, (o, f, k) in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "apiName string, sobjectType string, orgId string, label string, type string, referenceTo array<string>, ordinal int")


def field_refs(spark: SparkSession, org: str = ORG) -> DataFrame:
    return spark.createDataFrame([(o, f, t, rel, child, kind, org) for o, f, t, rel, child, kind in REFERENCES], "sourceObject string, fieldName string, targetObject string, relationshipName string, childName string, relationshipType string, orgId string")


def picklists(spark: SparkSession, sf_dir: str, org: str = ORG) -> DataFrame:
    """Distinct values of the picklist fields, all active."""
    out = None
    for o, f in PICKLISTS:
        part = read(spark, sf_dir, OBJECTS[o][0]).select(F.lit(o).alias("objectApiName"), F.lit(f).alias("fieldApiName"), F.col(f).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out.withColumn("label", F.col("value")).withColumn("isActive", F.lit(True)).withColumn("orgId", F.lit(org))


# --- described metadata


def list_objects(listing: DataFrame, names: list[str] | None = None, categories: list[str] | None = None, derived: bool = False) -> DataFrame:
    """Queryable objects of a listing (name, label, keyPrefix, queryable), by name and category."""
    from ..functions import naming

    x = listing.where("queryable").withColumn("category", naming.category(F.col("name")))
    if names:
        x = x.where(F.lower("name").isin(*[n.lower() for n in names]))
    if not derived:
        x = x.where("category != 'system'")
    return x.where(naming.matches_category(F.col("category"), categories))


def read_describes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(describe rows, records that could not be parsed) of JSON lines."""
    # written once: both parts are read from it, and the files are parsed once
    x = staged(spark.read.schema(DESCRIBE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path), "describes")
    return x.where("_corrupt_record is null").drop("_corrupt_record"), x.where("_corrupt_record is not null").select("_corrupt_record")


def described_fields(describes: DataFrame) -> DataFrame:
    from ..functions import naming

    x = describes.select("objectName", F.explode("describe.fields").alias("f"))
    return x.select("objectName", "f.*", naming.relationship_type(F.col("f.referenceTo"), F.col("objectName"), F.col("f.relationshipOrder"), F.col("f.cascadeDelete")).alias("relationshipType"))


def child_relationships(describes: DataFrame) -> DataFrame:
    x = describes.select("objectName", F.explode("describe.childRelationships").alias("c")).where("c.relationshipName is not null")
    return x.select("objectName", F.col("c.childSObject").alias("childObject"), F.col("c.field").alias("fieldApiName"), F.col("c.relationshipName").alias("relationshipName"), F.coalesce("c.cascadeDelete", F.lit(False)).alias("isMasterDetail"))


def record_types(table: DataFrame, owner: str) -> DataFrame:
    """Record types of an object by developer name; one without a business process is the default."""
    return table.where(F.col("SobjectType") == owner).select("DeveloperName", "Name", F.col("BusinessProcessId").isNull().alias("isDefault")).orderBy("DeveloperName")


def read_metadata_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_documentation(spark: SparkSession, *paths: str, key: str = "object") -> DataFrame:
    """Documentation of each object, from the first of the folders that has it."""
    out = None
    for k, p in enumerate(paths):
        part = spark.read.option("multiLine", True).json(p).withColumn("rank", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = out.groupBy(key).agg(F.min("rank").alias("rank"))
    return out.join(first, [key, "rank"])


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], text: str, args: dict | None = None) -> DataFrame:
    """A read-only SQL query over the named tables, with parameters (``:name``).
    The views live only as long as the call; the plan keeps what they stand for."""
    if not text.lstrip().upper().startswith(("SELECT", "WITH")):
        raise ValueError("only queries that read")
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=args or {})
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)


def orgs(known: DataFrame, synced: DataFrame) -> DataFrame:
    """Known orgs with whether they are in the catalog."""
    s = synced.select("orgId", F.lit(True).alias("_in")).distinct()
    return known.join(s, "orgId", "left").withColumn("syncedToGraph", F.col("_in").isNotNull()).drop("_in")


#: Metadata types: node name and identifying columns.
HANDLERS = {
    "CustomObject": ("Object", ("apiName", "orgId")),
    "CustomField": ("Field", ("apiName", "sobjectType", "orgId")),
    "PicklistValue": ("PicklistValue", ("objectApiName", "fieldApiName", "value", "orgId")),
    "RecordType": ("RecordType", ("apiName", "sobjectType", "orgId")),
    "ValidationRule": ("ValidationRule", ("fullName", "orgId")),
}


def _between(page, tag: str):
    """Text of the first element of a tag, without markup; empty if there is none."""
    inner = F.regexp_extract(page, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), "&amp;", "&"))


def page_documentation(pages: DataFrame) -> DataFrame:
    """url, title, heading and number of table rows with cells of documentation pages."""
    page = F.coalesce("html", F.lit(""))
    rows = F.filter(F.regexp_extract_all(page, F.lit("(?is)<tr(?:\\s[^>]*)?>(.*?)</tr\\s*>"), 1), lambda r: F.length(F.trim(F.regexp_replace(r, "<[^>]*>", ""))) > 0)
    return pages.select("url", _between(page, "title").alias("title"), _between(page, "h1").alias("heading"), F.size(rows).cast("long").alias("n_rows"))


def object_describe(describes: DataFrame, name: str) -> DataFrame:
    """name, label, keyPrefix, queryable of one object."""
    return describes.where(F.lower("objectName") == name.lower()).select(F.col("objectName").alias("name"), F.coalesce("describe.label", "objectName").alias("label"), F.col("describe.keyPrefix").alias("keyPrefix"), F.coalesce("describe.queryable", F.lit(False)).alias("queryable"))


def described(spark: SparkSession) -> DataFrame:
    """The supplied tables' catalog as describe results."""
    targets: dict[tuple[str, str], list[str]] = {}
    for o, f, t, *_ in REFERENCES:
        targets.setdefault((o, f), []).append(t)
    relation = {(o, f): (rel, kind) for o, f, _, rel, _, kind in REFERENCES}
    rows = []
    for name, (_, key, label) in OBJECTS.items():
        fields_ = []
        for o, f, kind in FIELDS:
            if o != name:
                continue
            rel, how = relation.get((o, f), (None, None))
            picks = [{"value": v, "label": t, "active": v != "P"} for v, t in STATUS_LABELS.items()] + [{"value": "O", "label": "again"}] if f == "o_orderstatus" else None
            fields_.append({"name": f, "label": None, "type": kind, "nillable": f != key, "unique": f == key, "referenceTo": targets.get((o, f), []), "relationshipName": rel, "relationshipOrder": 0 if how == "MasterDetail" else None, "picklistValues": picks, "controllerName": "o_orderstatus" if f == "o_orderpriority" else None})
        children = [{"childSObject": o, "field": f, "relationshipName": child if o != "Label" else None, "cascadeDelete": True if kind == "MasterDetail" else None} for o, f, t, _, child, kind in REFERENCES if t == name]
        rows.append({"objectName": name, "describe": {"name": name, "label": label, "keyPrefix": name[:3].lower(), "queryable": True, "fields": fields_, "childRelationships": children}, "_corrupt_record": None})
    return spark.createDataFrame(rows, DESCRIBE).drop("_corrupt_record")
