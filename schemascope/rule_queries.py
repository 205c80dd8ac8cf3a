"""Queries for validation, syntax edits, ingest, refresh, stores and text rules.

The SQL sides list what each case must give, written from the rules and not
from this library's tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import calls, naming, text, values
from .operators import context, graph, grounding, ingest, merge, questions, refresh, search, store, tagging
from .plans import edit, validate
from .plans.compile import Compiler, Object, Records
from .plans.parser import find, is_valid, parse
from .plans.staging import scratch_dir
from .queries import _COS, _FIELDS, _OBJECTS, _PICKS, _REFS, AS_OF, _query_vectors, _sql_rows, query
from .sources import catalog as C


def _values(columns: str, rows: list[tuple], casts: str = "*") -> str:
    return f"SELECT {casts} FROM (VALUES {_sql_rows(rows)}) t({columns})"


# --- validation (V): queries; whether each is valid and corrected, what is left of it, the kinds of its messages

RULES = {
    "v00_orchestrator": [
        ("SELECT c_nme FROM Custmer WHERE OwnerId LIKE 'A%'", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_custkey = '001A' AND zzz = 1", False, False, None, "error"),
        ("SELECT FROM", False, False, None, "error"),
        ("SELECT event_id, TYPEOF Who WHEN Customer THEN c_name WHEN Zzz THEN x END FROM Event LIMIT 1", False, False, None, "error"),
        ("SELECT c_nme, zzzzzzzzzzzz FROM Customer", False, True, "SELECT c_name, zzzzzzzzzzzz FROM Customer LIMIT 1000", "correction,error,correction"),
    ],
    "v01_syntax_bans": [
        ("SELECT c_name FROM Customer WHERE Orders IS NOT EMPTY", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE EXISTS (SELECT o_orderkey FROM Orders)", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_custkey > 1 AND (SELECT o_orderkey FROM Order)", False, False, None, "error"),
        ("SELECT c_name FROM Customer UNION SELECT s_name FROM Supplier", False, False, None, "error"),
        ("SELECT COUNT(c_custkey) FROM Customer HAVING COUNT(c_custkey) > 1", False, False, None, "error"),
        ("SELECT c_name AS label FROM Customer", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_name = :wanted", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_name = 'IS NOT EMPTY AS UNION' LIMIT 5", True, False, None, ""),
    ],
    "v02_like_on_ids": [
        ("SELECT c_name FROM Customer WHERE OwnerId LIKE 'Ann%'", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE RegionId LIKE 'Asia%'", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_name LIKE 'Ann%' LIMIT 1", True, False, None, ""),
    ],
    "v03_id_literals": [
        ("SELECT c_name FROM Customer WHERE c_custkey = '001ABC'", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_custkey IN ('003x', '006y')", False, False, None, "error,error"),
        ("SELECT c_name FROM Customer WHERE c_name = '002abc' LIMIT 1", True, False, None, ""),
    ],
    "v04_object_match": [
        ("SELECT n_name FROM nation LIMIT 1", True, False, "SELECT n_name FROM Nation LIMIT 1", ""),
        ("SELECT c_name FROM Custmer LIMIT 1", True, True, "SELECT c_name FROM Customer LIMIT 1", "correction"),
        ("SELECT c_name FROM Cust LIMIT 1", True, True, "SELECT c_name FROM Customer LIMIT 1", "correction"),
        ("SELECT x FROM Zzzzzzzzzz LIMIT 1", False, False, None, "error"),
    ],
    "v05_field_match": [
        ("SELECT C_NAME FROM Customer LIMIT 1", True, False, None, ""),
        ("SELECT c_nme FROM Customer LIMIT 1", True, True, "SELECT c_name FROM Customer LIMIT 1", "correction"),
        ("SELECT mktsegment FROM Customer LIMIT 1", True, True, "SELECT c_mktsegment FROM Customer LIMIT 1", "correction"),
        ("SELECT Id, zzzzzzzzzzzz FROM Customer LIMIT 1", False, False, None, "error"),
        ("SELECT c_acctball, c_name FROM Customer WHERE c_mktsegmen = 'BUILDING' LIMIT 1", True, True, "SELECT c_acctbal, c_name FROM Customer WHERE c_mktsegment = 'BUILDING' LIMIT 1", "correction,correction"),
    ],
    "v06_relationship_match": [
        ("SELECT Nation.n_name FROM Customer LIMIT 1", True, False, None, ""),
        ("SELECT Natoin.n_name FROM Customer LIMIT 1", True, True, "SELECT Nation.n_name FROM Customer LIMIT 1", "correction"),
        ("SELECT Cust.c_name FROM Order LIMIT 1", True, True, "SELECT Customer.c_name FROM Order LIMIT 1", "correction"),
        ("SELECT Zzzzzzzzzz.n_name FROM Customer LIMIT 1", False, False, None, "error"),
    ],
    "v08_parent_walk": [
        ("SELECT Customer.Nation.Region.r_name FROM Order LIMIT 1", True, False, None, ""),
        ("SELECT Customer.Nation.Regin.r_nam FROM Order LIMIT 1", True, True, "SELECT Customer.Nation.Region.r_name FROM Order LIMIT 1", "correction,correction"),
        ("SELECT o_orderkey FROM Order WHERE Customer.Nation.n_nam = 'X' LIMIT 1", True, True, "SELECT o_orderkey FROM Order WHERE Customer.Nation.n_name = 'X' LIMIT 1", "correction"),
        ("SELECT Customer.Zzzzzzzzzz.r_name FROM Order LIMIT 1", False, False, None, "error"),
    ],
    "v09_child_subquery": [
        ("SELECT n_name, (SELECT c_name FROM Customers) FROM Nation LIMIT 1", True, False, None, ""),
        ("SELECT n_name, (SELECT c_name FROM Custmers) FROM Nation LIMIT 1", False, False, None, "error"),
        ("SELECT n_name, (SELECT zzz FROM Customers) FROM Nation LIMIT 1", True, False, None, "warning"),
        ("SELECT n_name, (SELECT x FROM Qqqqqqqqqq) FROM Nation LIMIT 1", False, False, None, "error"),
    ],
    "v10_semi_joins": [
        ("SELECT c_name FROM Customer WHERE c_custkey IN (SELECT o_custkey FROM Order) LIMIT 1", True, False, None, ""),
        ("SELECT c_name FROM Customer WHERE c_custkey IN (SELECT zzz FROM Order) LIMIT 1", False, False, None, "error"),
        ("SELECT c_name FROM Customer WHERE c_custkey NOT IN (SELECT x FROM Qqqqqqqqqq) LIMIT 1", False, False, None, "error"),
    ],
    "v11_picklist_values": [
        ("SELECT c_name FROM Customer WHERE c_mktsegment = 'building' LIMIT 1", True, False, None, ""),
        ("SELECT c_name FROM Customer WHERE c_mktsegment IN ('BUILDIN', 'MACHINERY') LIMIT 1", False, False, None, "error"),
        ("SELECT o_orderkey FROM Order WHERE o_orderstatus != 'QQQQ' AND o_orderstatus != null LIMIT 1", False, False, None, "error"),
    ],
    "v12_group_by": [
        ("SELECT c_mktsegment, COUNT(c_custkey) FROM Customer GROUP BY c_mktsegment", True, False, None, ""),
        ("SELECT c_mktsegment, COUNT(c_custkey) FROM Customer", False, False, None, "error"),
        ("SELECT toLabel(o_orderstatus), COUNT(o_orderkey) FROM Order GROUP BY o_orderstatus", True, False, None, ""),
        ("SELECT c_name, MAX(c_acctbal) FROM Customer GROUP BY c_mktsegment", False, False, None, "error"),
    ],
    "v13_tooling": [
        ("SELECT COUNT() FROM EntityParticle", False, False, None, "error"),
        ("SELECT Name FROM FieldDefinition LIMIT 5", False, False, None, "error"),
        ("SELECT Name FROM EntityDefinition WHERE A = 1 OR B != 2", False, False, None, "error,error"),
        ("SELECT A, COUNT(B) FROM SearchLayout GROUP BY A OFFSET 3", False, False, None, "error,error,error"),
        ("SELECT DurableId FROM UserFieldAccess", True, False, None, ""),
        ("SELECT Name FROM ApexClass LIMIT 5", True, False, None, ""),
    ],
    "v14_limits": [
        ("SELECT c_name FROM Customer", True, True, "SELECT c_name FROM Customer LIMIT 1000", "correction"),
        ("SELECT c_name FROM Customer WHERE c_name LIKE '%x' LIMIT 3", True, False, None, "warning"),
        ("SELECT COUNT() FROM Customer", True, False, None, ""),
        ("SELECT c_mktsegment, COUNT(c_custkey) n FROM Customer GROUP BY c_mktsegment", True, False, None, ""),
    ],
    "v15_lookup_correction": [
        ("SELECT Nation.n_nme FROM Customer LIMIT 1", True, True, "SELECT Nation.n_name FROM Customer LIMIT 1", "correction"),
        ("SELECT c_name FROM Customer WHERE Natoin.n_name = 'X' LIMIT 1", True, True, "SELECT c_name FROM Customer WHERE Nation.n_name = 'X' LIMIT 1", "correction"),
        ("SELECT Natoin.n_nme FROM Customer WHERE Natoin.n_nme = 'X' LIMIT 1", True, True, "SELECT Nation.n_name FROM Customer WHERE Nation.n_name = 'X' LIMIT 1", "correction,correction,correction"),
    ],
}


def rule_catalog(spark, sf_dir) -> validate.Catalog:
    """The supplied tables' catalog, with two objects of the tooling interface."""
    extra = spark.createDataFrame([(n, C.ORG, n, "standard", False) for n in ("ApexClass", "UserFieldAccess")], C.objects(spark).schema)
    more = spark.createDataFrame([("Name", "ApexClass", C.ORG, "Name", "string", None, 0), ("DurableId", "UserFieldAccess", C.ORG, "Durable ID", "string", None, 0)], C.fields(spark).schema)
    return validate.Catalog.of(C.objects(spark).unionByName(extra), C.fields(spark).unionByName(more), C.field_refs(spark), C.picklists(spark, sf_dir))


def _rule_query(name: str, cases: list[tuple]) -> None:
    want = [(i, ok, changed, left or soql, kinds) for i, (soql, ok, changed, left, kinds) in enumerate(cases, 1)]

    @query(name, _values("id, valid, corrected, soql, kinds", want))
    def run(spark, sf_dir):
        asked = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases, 1)], "id int, soql string")
        got = validate.validate_rows(asked, rule_catalog(spark, sf_dir))
        return got.select("id", "valid", "corrected", "soql", F.array_join("kinds", ",").alias("kinds"))


for _name, _cases in RULES.items():
    _rule_query(_name, _cases)


@query("v07_picklist_suggestions", f"WITH {_PICKS}, t(term, value) AS (VALUES ('build', 'BUILDING'), ('URNIT', 'FURNITURE'), ('MACHNERY', 'MACHINERY'), ('qqqqqqqq', NULL)) SELECT term, (SELECT min(p.value) FROM picks p WHERE p.value = t.value) AS value FROM t")
def v07(spark, sf_dir):
    known = [r.value for r in graph.picklist_values(C.picklists(spark, sf_dir), "Customer", "c_mktsegment").collect()]
    return spark.createDataFrame([(t, validate.closest(t, known)) for t in ("build", "URNIT", "MACHNERY", "qqqqqqqq")], "term string, value string")


@query("v16_findings", _values("id, path, kind, hint, suggestion", [
    (1, "Customer.Microsoft", "hallucinated_entity", "Customer.Name LIKE 'Microsoft%'", "Account.Name LIKE 'Microsoft%'"), (2, "Customer.zzzzzzzzzzzz", "invalid_field", None, None),
    (3, "Custmer", "invalid_object", None, "Customer"), (4, "Nation.Custmers", "invalid_relationship", None, "Customers"),
]))
def v16(spark, sf_dir):
    known = rule_catalog(spark, sf_dir)
    asked = ["SELECT Microsoft FROM Customer LIMIT 1", "SELECT zzzzzzzzzzzz FROM Customer LIMIT 1", "SELECT c_name FROM Customer WHERE c_custkey IN (SELECT o FROM Custmer) LIMIT 1", "SELECT n_name, (SELECT c_name FROM Custmers) FROM Nation LIMIT 1"]
    found = [(i, x) for i, q in enumerate(asked, 1) for x in validate.analyse(validate.validate(q, known), {"Microsoft"}.__contains__)]
    return spark.createDataFrame([(i, x.path, x.kind, x.hint, x.suggestions[0] if x.suggestions else None) for i, x in found], "id int, path string, kind string, hint string, suggestion string")


_ERRORS = [
    ('Object "Accountt" not found in the metadata graph', "object", "Accountt", None), ('Object "Accountt" not found, using "Account"', "object", "Accountt", "Account"), ('Relationship "Acct" not found on Contact', "relationship", "Acct", "Contact"),
    ('Child relationship "Cons" not found on Account. Did you mean "Contacts"?', "relationship", "Cons", "Account"), ('Field "Nam" not found on Account - check spelling or use available fields', "field", "Nam", "Account"),
    ('Field "Nam" not found on Account, using "Name"', "field", "Nam", "Account"), ('Unknown object type "Acct" in TYPEOF clause', "object", "Acct", None), ('Field "Nam" not found on subtype "Account" in TYPEOF clause', "field", "Nam", "Account"), ("something else", None, None, None),
]


@query("v17_error_patterns", _values("message, kind, name, context", _ERRORS))
def v17(spark, sf_dir):
    return spark.createDataFrame([(m, *(validate.read_error(m) or (None, None, None))) for m, *_ in _ERRORS], "message string, kind string, name string, context string")


@query("v18_missing_names", _values("name, resolved", [("customer", "Customer"), ("Who", "Supplier"), ("Nations", "Nation"), ("Lineitems", "Lineitem"), ("Parts", "Part"), ("qqqq", None)]))
def v18(spark, sf_dir):
    known = rule_catalog(spark, sf_dir)
    return spark.createDataFrame([(n, validate.resolve_missing(n, known)) for n in ("customer", "Who", "Nations", "Lineitems", "Parts", "qqqq")], "name string, resolved string")


# --- the query language: reading and editing (Q)


@query("q01_parsed_parts", _values("part, n", [("fields", 2), ("parents", 1), ("subqueries", 1), ("aggregates", 0), ("typeof", 0), ("conditions", 3), ("orders", 1), ("limit", 7), ("offset", 2)]))
def q01(spark, sf_dir):
    q = parse("SELECT Id, Name, Owner.Name, (SELECT Id FROM Contacts) FROM Account WHERE (A = 1 OR B LIKE 'x%') AND C IN ('u') ORDER BY Name DESC LIMIT 7 OFFSET 2")
    paths = [i for i in q.items if isinstance(i, edit.Path)]
    parts = [
        ("fields", sum(len(p.parts) == 1 for p in paths)), ("parents", sum(len(p.parts) > 1 for p in paths)), ("subqueries", sum(isinstance(i, edit.Query) for i in q.items)), ("aggregates", sum(map(edit.is_aggregate, q.items))),
        ("typeof", sum(isinstance(i, validate.TypeOf) for i in q.items)), ("conditions", len(edit.comparisons(q))), ("orders", len(q.order)), ("limit", q.limit), ("offset", q.offset),
    ]
    return spark.createDataFrame(parts, "part string, n int")


@query("q22_currency", "SELECT o_orderkey, round(o_totalprice * CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 2.0 END, 4) AS price FROM orders")
def q22_currency(spark, sf_dir):
    r = Records([Object("Order", C.read(spark, sf_dir, "orders"), "o_orderkey", currency="o_orderstatus")])
    return Compiler(spark, r, AS_OF, rates={"F": 1.0, "O": 0.5, "P": 2.0}).run("SELECT o_orderkey, CONVERTCURRENCY(o_totalprice) price FROM Order").withColumn("price", F.round("price", 4))


@query("q22_timezone", "SELECT CAST(hour(ts + INTERVAL 2 HOUR) AS INTEGER) AS h, count(*) AS n FROM events GROUP BY 1")
def q22_timezone(spark, sf_dir):
    return Compiler(spark, C.records(spark, sf_dir), AS_OF, timezone="+02:00").run("SELECT HOUR_IN_DAY(CONVERTTIMEZONE(ts)) h, COUNT(event_id) n FROM Event GROUP BY HOUR_IN_DAY(CONVERTTIMEZONE(ts))")


@query("q25_extraction", _values("id, valid, found", [(1, True, "SELECT Id FROM Account"), (2, False, "SELECT Id FROM Contact LIMIT 3"), (3, False, None), (4, False, "SELECT Name FROM Lead WHERE A = 'b'")]))
def q25(spark, sf_dir):
    prose = ["SELECT Id FROM Account", "Try this:\n```sql\nSELECT Id FROM Contact LIMIT 3\n```\nIt works.", "No query here.", "```soql\nSELECT Name FROM Lead WHERE A = 'b'\n```"]
    return spark.createDataFrame([(i, is_valid(p), find(p)) for i, p in enumerate(prose, 1)], "id int, valid boolean, found string")


@query("q25_formatted", _values("id, soql", [(1, "SELECT Id, Name FROM Account WHERE A = 1 AND (B = 2 OR C = null) ORDER BY Name DESC NULLS LAST LIMIT 3")]))
def q25_formatted(spark, sf_dir):
    return spark.createDataFrame([(1, str(parse("select Id,Name\nfrom Account where A=1 and (B=2 or C=null) order by Name desc nulls last limit 3")))], "id int, soql string")


@query("q26_comparisons", _values("field, op, value, sub", [("A", "=", "x", False), ("B", "IN", "1", False), ("B", "IN", "2", False), ("C.D", "LIKE", "y%", False), ("Id", "NOT IN", "SELECT F FROM G", True)]))
def q26(spark, sf_dir):
    q = parse("SELECT Id FROM T WHERE A = 'x' AND (B IN (1, 2) OR NOT C.D LIKE 'y%') AND Id NOT IN (SELECT F FROM G)")
    return spark.createDataFrame([(f, op, str(v), s) for f, op, v, s in edit.comparisons(q)], "field string, op string, value string, sub boolean")


@query("q27_field_names", _values("name", [("Id",), ("Owner.Name",), ("CreatedDate",), ("Amount",)]))
def q27(spark, sf_dir):
    q = parse("SELECT Id, Owner.Name, CALENDAR_YEAR(CreatedDate), SUM(Amount) total, (SELECT X FROM Ys) FROM T WHERE Z = 'Literal' GROUP BY Id, Owner.Name, CALENDAR_YEAR(CreatedDate)")
    return spark.createDataFrame([(n,) for n in edit.field_names(q)], "name string")


@query("q28_built", _values("id, soql", [(1, "SELECT Id, Name FROM Account WHERE A = 1 ORDER BY Name ASC LIMIT 5"), (2, "SELECT a, b FROM T"), (3, "SELECT Id FROM T")]))
def q28(spark, sf_dir):
    made = [edit.build("Account", ["Id", "Name"], "A = 1", [("Name", False)], 5), edit.build("T", every=["a", "b"]), edit.build("T")]
    return spark.createDataFrame([(i, str(q)) for i, q in enumerate(made, 1)], "id int, soql string")


@query("q29_edits", _values("edit, soql", [
    ("object", "SELECT Id, Own.Name n, (SELECT A FROM Bs) FROM New WHERE Own.X = 1 AND A = 2"), ("select", "SELECT Key, Own.Name n, (SELECT A FROM Bs) FROM T WHERE Own.X = 1 AND A = 2"), ("parent", "SELECT Id, Owner.Name n, (SELECT A FROM Bs) FROM T WHERE Owner.X = 1 AND A = 2"),
    ("where", "SELECT Id, Own.Name n, (SELECT A FROM Bs) FROM T WHERE Own.X = 1 AND C = 2"), ("subquery", "SELECT Id, Own.Name n, (SELECT Z FROM Bs) FROM T WHERE Own.X = 1 AND A = 2"),
]))
def q29(spark, sf_dir):
    q = parse("SELECT Id, Own.Name n, (SELECT A FROM Bs) FROM T WHERE Own.X = 1 AND A = 2")
    made = {"object": edit.rename_object(q, "New"), "select": edit.rename_select_field(q, "Id", "Key"), "parent": edit.rename_parent(q, "Own", "Owner"), "where": edit.rename_where_field(q, "A", "C"), "subquery": edit.rename_subquery_field(q, "Bs", "A", "Z")}
    return spark.createDataFrame([(k, str(v)) for k, v in made.items()], "edit string, soql string")


# --- describe results (S, T)

_REFD = "refd AS (SELECT sobjectType, apiName, type, ordinal, list(dst ORDER BY dst) FILTER (WHERE dst IS NOT NULL) AS targets, max(rel) AS rel, max(kind) AS kind FROM flds LEFT JOIN refs ON src = sobjectType AND field = apiName GROUP BY 1, 2, 3, 4)"


@query("s02_describe_report", "SELECT apiName AS name, CASE apiName WHEN 'Part' THEN 'failed' WHEN 'Region' THEN 'missing' ELSE 'described' END AS state FROM (VALUES ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('Order'), ('Lineitem'), ('Event'), ('Document'), ('Label')) t(apiName)")
def s02(spark, sf_dir):
    done = C.described(spark).where("objectName not in ('Part', 'Region')")
    failed = spark.createDataFrame([("Part", "timeout")], "name string, reason string")
    return refresh.describe_report(C.objects(spark).select(F.col("apiName").alias("name")), done, failed).select("name", "state")


@query("s03_described_fields", f"WITH {_FIELDS}, {_REFS}, {_REFD} SELECT sobjectType, apiName, type, CASE WHEN targets IS NULL THEN NULL ELSE kind END AS relationshipType FROM refd")
def s03(spark, sf_dir):
    return C.described_fields(C.described(spark)).select(F.col("objectName").alias("sobjectType"), F.col("name").alias("apiName"), "type", "relationshipType")


@query("s04_child_relationships", f"WITH {_REFS} SELECT dst AS objectName, src AS childObject, field AS fieldApiName, child AS relationshipName, kind = 'MasterDetail' AS isMasterDetail FROM refs WHERE src <> 'Label'")
def s04(spark, sf_dir):
    return C.child_relationships(C.described(spark))


@query("s05_record_types", "SELECT n_name AS DeveloperName, n_name AS Name, n_nationkey < 12 AS isDefault FROM nation WHERE n_regionkey = 2")
def s05(spark, sf_dir):
    n = C.read(spark, sf_dir, "nation")
    t = n.select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("SobjectType"), F.col("n_name").alias("DeveloperName"), F.col("n_name").alias("Name"), F.when(F.col("n_nationkey") >= 12, "p").alias("BusinessProcessId"))
    return C.record_types(t, "R2")


def _written(spark, label: str) -> str:
    """A place for a query's own files in the shared folder."""
    return f"{scratch_dir(spark)}/schemascope/{label}-{uuid.uuid4().hex}"


@query("s02_describe_scan", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'described' ELSE 'corrupt' END AS state FROM supplier")
def s02_scan(spark, sf_dir):
    path = _written(spark, "describes")
    key = F.col("s_suppkey").cast("string")
    good = F.to_json(F.struct(key.alias("objectName"), F.struct(key.alias("name")).alias("describe")))
    C.read(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, good).otherwise(F.concat(key, F.lit(" {broken")))).write.text(path)
    done, bad = C.read_describes(spark, path)
    return done.select(F.col("objectName").cast("long").alias("id"), F.lit("described").alias("state")).unionByName(bad.select(F.split_part("_corrupt_record", F.lit(" "), F.lit(1)).cast("long").alias("id"), F.lit("corrupt").alias("state")))


@query("s06_metadata_xml", "SELECT s_suppkey, s_name FROM supplier")
def s06(spark, sf_dir):
    path = _written(spark, "metadata")
    C.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name").write.format("xml").option("rowTag", "rule").save(path)
    return C.read_metadata_xml(spark, path, "rule", "s_suppkey long, s_name string")


@query("s08_execution", "SELECT count(*) AS totalSize, true AS done, sum(c_custkey) :: BIGINT AS keys FROM customer WHERE c_acctbal > 0")
def s08(spark, sf_dir):
    found = Compiler(spark, C.records(spark, sf_dir), AS_OF).run("SELECT c_custkey FROM Customer WHERE c_acctbal > 0")
    return found.agg(F.count("*").alias("totalSize"), F.lit(True).alias("done"), F.sum("c_custkey").alias("keys"))


@query("s09_passthrough", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def s09(spark, sf_dir):
    return C.run_sql(spark, {"nations": C.read(spark, sf_dir, "nation")}, "SELECT n_name, n_regionkey FROM nations WHERE n_regionkey = :region", {"region": 2})


@query("s11_documentation", "SELECT n_name AS object, CASE WHEN n_regionkey = 1 THEN 'own' ELSE 'bundled' END AS text FROM nation")
def s11(spark, sf_dir):
    n = C.read(spark, sf_dir, "nation")
    paths = {"own": n.where("n_regionkey = 1"), "bundled": n}
    places = []
    for text_, rows in paths.items():
        places.append(_written(spark, text_))
        rows.select(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("object"), F.lit(text_).alias("text")))))).write.text(places[-1])
    return C.read_documentation(spark, *places).select("object", "text")


@query("s12_examples", "SELECT n_nationkey AS id, 'customers of ' || n_name AS question FROM nation")
def s12(spark, sf_dir):
    path = _written(spark, "examples")
    n = C.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("customers of "), "n_name").alias("question"))
    n.select(F.to_json(F.collect_list(F.struct("id", "question")))).write.text(path)
    return C.read_examples(spark, path).select(F.col("id").cast("int").alias("id"), "question")


@query("s07_object_describe", _values("name, label, keyPrefix, queryable", [("Order", "Sales Order", "ord", True)]))
def s07(spark, sf_dir):
    return C.object_describe(C.described(spark), "ORDER")


@query("s13_registry", _values("kind, node, keys, repeated", [("CustomField", "Field", "apiName,sobjectType,orgId", 0), ("CustomObject", "Object", "apiName,orgId", 0), ("PicklistValue", "PicklistValue", "objectApiName,fieldApiName,value,orgId", 0)], "kind, node, keys, repeated :: BIGINT AS repeated"))
def s13(spark, sf_dir):
    tables = {"CustomField": C.fields(spark), "CustomObject": C.objects(spark), "PicklistValue": C.picklists(spark, sf_dir)}
    out = None
    for kind, table in tables.items():
        node, keys = refresh.node_keys(kind)
        part = refresh.not_unique(kind, table).agg(F.count("*").alias("repeated")).select(F.lit(kind).alias("kind"), F.lit(node).alias("node"), F.lit(",".join(keys)).alias("keys"), "repeated")
        out = part if out is None else out.unionByName(part)
    return out


@query("s15_page_titles", r"""SELECT url, trim(replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS title,
trim(replace(regexp_replace(regexp_extract(html, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g'), '&amp;', '&')) AS heading, 0 :: BIGINT AS n_rows FROM pages""")
def s15(spark, sf_dir):
    return C.page_documentation(C.read(spark, sf_dir, "pages"))


@query("s16_compact_objects", f"WITH {_OBJECTS}, {_FIELDS}, {_REFS}, p AS (SELECT src, rel, rel || ' -> ' || string_agg(DISTINCT dst, ', ' ORDER BY dst) AS hint FROM refs GROUP BY 1, 2) SELECT o.apiName, o.label, count(*) AS fieldCount, coalesce((SELECT string_agg(hint, ';' ORDER BY hint) FROM p WHERE src = o.apiName), '') AS parents FROM objs o JOIN flds f ON f.sobjectType = o.apiName GROUP BY 1, 2")
def s16(spark, sf_dir):
    x = graph.compact(C.objects(spark), C.fields(spark), C.field_refs(spark))
    return x.select("apiName", "label", "fieldCount", F.array_join("parents", ";").alias("parents"))


_NAMES = ["Account", "Thing__c", "ns__Thing__c", "Thing__Share", "AccountHistory", "Conf__mdt", "Ping__e", "Ext__x"]


@query("t02_namespaces", _values("name, namespace, parent", [("Account", None, None), ("Thing__c", None, None), ("ns__Thing__c", "ns", None), ("Thing__Share", None, "Thing__c"), ("AccountHistory", None, "Account"), ("Conf__mdt", None, None), ("Ping__e", None, None), ("Ext__x", None, None)]))
def t02(spark, sf_dir):
    n = F.col("name")
    return spark.createDataFrame([(x,) for x in _NAMES], "name string").select(n, naming.namespace(n).alias("namespace"), naming.parent_name(n).alias("parent"))


@query("t03_parent_names", "SELECT p_partkey, p_brand AS parent FROM part")
def t03(spark, sf_dir):
    suffix = F.when(F.col("p_size") < 20, "Feed").when(F.col("p_size") < 35, "ChangeEvent").otherwise("Share")
    return C.read(spark, sf_dir, "part").select("p_partkey", naming.parent_name(F.concat("p_brand", suffix)).alias("parent"))


@query("t04_field_categories", f"WITH {_FIELDS}, n AS (SELECT DISTINCT apiName FROM flds UNION ALL SELECT * FROM (VALUES ('Amount__c'), ('ns__Amount__c'), ('Parent__r'))) SELECT apiName, CASE WHEN ends_with(apiName, '__c') THEN 'custom' ELSE 'standard' END AS category, CASE WHEN apiName = 'ns__Amount__c' THEN 'ns' END AS namespace FROM n")
def t04(spark, sf_dir):
    n = F.col("apiName")
    more = spark.createDataFrame([("Amount__c",), ("ns__Amount__c",), ("Parent__r",)], "apiName string")
    return C.fields(spark).select("apiName").distinct().unionByName(more).select(n, naming.field_category(n).alias("category"), naming.namespace(n).alias("namespace"))


@query("t05_system_derived", _values("name, derived, wanted", [("Account", False, True), ("Thing__c", False, True), ("ns__Thing__c", False, True), ("Thing__Share", True, False), ("AccountHistory", True, False), ("Conf__mdt", False, False), ("Ping__e", False, False), ("Ext__x", False, False)]))
def t05(spark, sf_dir):
    n = F.col("name")
    return spark.createDataFrame([(x,) for x in _NAMES], "name string").select(n, naming.subtype(n).isNotNull().alias("derived"), naming.matches_category(naming.category(n), ["standard", "custom"]).alias("wanted"))


@query("t06_relationship_types", _values("id, kind", [(1, None), (2, "Hierarchical"), (3, "MasterDetail"), (4, "Lookup"), (5, None)]))
def t06(spark, sf_dir):
    x = spark.createDataFrame([(1, None, "A", None), (2, ["A"], "A", 1), (3, ["B"], "A", 0), (4, ["B", "C"], "A", None), (5, [], "A", 0)], "id int, targets array<string>, owner string, ord int")
    return x.select("id", naming.relationship_type(F.col("targets"), F.col("owner"), F.col("ord"), F.lit(False)).alias("kind"))


@query("t07_object_rows", f"WITH {_OBJECTS} SELECT apiName, 'main' AS orgId, label, 'standard' AS category, lower(substr(apiName, 1, 3)) AS keyPrefix FROM objs")
def t07(spark, sf_dir):
    return ingest.object_rows(C.described(spark), C.ORG).select("apiName", "orgId", "label", "category", "keyPrefix")


@query("t08_field_rows", f"WITH {_FIELDS}, {_REFS}, {_REFD} SELECT sobjectType, apiName, apiName AS label, type, array_to_string(targets, ',') AS referenceTo, rel AS relationshipName, kind AS relationshipType, false AS calculated, true AS filterable, true AS sortable, true AS groupable FROM refd")
def t08(spark, sf_dir):
    x = ingest.field_rows(C.described(spark), C.ORG)
    return x.select("sobjectType", "apiName", "label", "type", F.array_join(F.sort_array("referenceTo"), ",").alias("referenceTo"), "relationshipName", "relationshipType", "calculated", "filterable", "sortable", "groupable")


@query("t09_reference_rows", f"WITH {_REFS} SELECT src AS sourceObject, field AS fieldName, dst AS targetObject, rel AS relationshipName, kind AS relationshipType, 'standard' AS targetCategory FROM refs")
def t09(spark, sf_dir):
    return ingest.reference_rows(C.described(spark), C.ORG).select("sourceObject", "fieldName", "targetObject", "relationshipName", "relationshipType", "targetCategory")


@query("t10_picklist_rows", _values("objectApiName, fieldApiName, value, label, isActive", [("Order", "o_orderstatus", "O", "Open", True), ("Order", "o_orderstatus", "F", "Fulfilled", True), ("Order", "o_orderstatus", "P", "Pending", False)]))
def t10(spark, sf_dir):
    return ingest.picklist_rows(C.described(spark), C.ORG).select("objectApiName", "fieldApiName", "value", "label", "isActive")


@query("t11_dependencies", _values("sourceField, controllerField, objectName", [("o_orderpriority", "o_orderstatus", "Order")]))
def t11(spark, sf_dir):
    return ingest.dependency_rows(C.described(spark), C.ORG).select("sourceField", "controllerField", "objectName")


@query("t12_clean_text", "SELECT p_partkey, p_name AS name FROM part")
def t12(spark, sf_dir):
    return C.read(spark, sf_dir, "part").select("p_partkey", ingest.clean_xml(F.concat(F.lit(" \x01"), "p_name", F.lit("\x1f\n"))).alias("name"))


@query("t13_validation_rules", "SELECT 'Obj' || s_nationkey || '__c.R' || s_suppkey AS fullName, 'Obj' || s_nationkey || '__c' AS objectApiName, 'R' || s_suppkey AS name, s_acctbal > 0 AS active, 'x > ' || s_suppkey AS formula FROM supplier")
def t13(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    r = C.read(spark, sf_dir, "supplier").select(F.concat(F.lit("Obj"), F.col("s_nationkey").cast("string"), F.lit("__c.R"), key).alias("fullName"), F.when(F.col("s_acctbal") > 0, True).alias("active"), F.concat(F.lit(" x > "), key).alias("errorConditionFormula"), F.lit("no").alias("errorMessage"), F.lit(None).cast("string").alias("errorDisplayField"), F.lit("d").alias("description"))
    return ingest.validation_rule_rows(r, C.ORG).select("fullName", "objectApiName", "name", "active", F.col("errorConditionFormula").alias("formula"))


# --- refresh (M)


@query("m02_upsert_fields", f"WITH {_FIELDS} SELECT sobjectType, apiName, CASE WHEN sobjectType = 'Customer' THEN 'new ' || type ELSE type END AS type FROM flds UNION ALL SELECT 'Customer', 'extra', 'new string'")
def m02(spark, sf_dir):
    f = C.fields(spark)
    new = f.where("sobjectType = 'Customer'").unionByName(spark.createDataFrame([("extra", "Customer", C.ORG, "extra", "string", None, 9)], f.schema)).withColumn("type", F.concat(F.lit("new "), "type"))
    return merge.upsert(f, new, refresh.FIELD_KEYS).select("sobjectType", "apiName", "type")


@query("m03_ownership", f"WITH {_FIELDS} SELECT sobjectType AS object, apiName AS field FROM flds WHERE sobjectType <> 'Event'")
def m03(spark, sf_dir):
    f = C.fields(spark)
    return refresh.ownership(f.unionByName(f), C.objects(spark).where("apiName != 'Event'")).select("object", "field")


@query("m06_derived_from", _values("child, parent", [("AccountShare", "Account"), ("Thing__History", "Thing__c")]))
def m06(spark, sf_dir):
    o = spark.createDataFrame([(n, "o") for n in ("Account", "AccountShare", "Thing__c", "Thing__History", "LostFeed")], "apiName string, orgId string")
    return merge.derived_from(o.withColumn("parentObjectName", naming.parent_name(F.col("apiName")))).select(F.col("apiName").alias("child"), "parent")


@query("m08_controllers", _values("sourceField, controllerField", [("o_orderpriority", "o_orderstatus")]))
def m08(spark, sf_dir):
    lost = spark.createDataFrame([("a", "nowhere", "Order", C.ORG)], "sourceField string, controllerField string, objectName string, orgId string")
    return merge.controller_edges(ingest.dependency_rows(C.described(spark), C.ORG).unionByName(lost), C.fields(spark)).select("sourceField", "controllerField")


@query("m10_soft_delete", "SELECT c_custkey, c_acctbal < 0 OR c_mktsegment <> 'BUILDING' AS deleted, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2023-01-01' WHEN c_mktsegment <> 'BUILDING' THEN TIMESTAMP '2024-01-31' END AS deletedAt FROM customer")
def m10(spark, sf_dir):
    before = F.col("c_acctbal") < 0
    c = C.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", before.alias("deleted"), F.when(before, F.lit("2023-01-01").cast("timestamp_ntz")).alias("deletedAt"))
    return merge.soft_delete(c, c.where("c_mktsegment = 'BUILDING'"), ["c_custkey"], F.lit("2024-01-31").cast("timestamp_ntz")).drop("c_mktsegment")


@query("m10_soft_delete_fields", f"WITH {_FIELDS} SELECT sobjectType, apiName, sobjectType IN ('Event', 'Part') AS deleted FROM flds")
def m10_fields(spark, sf_dir):
    f = C.fields(spark).withColumn("deleted", F.lit(False)).withColumn("deletedAt", F.lit(None).cast("timestamp"))
    o = C.objects(spark).withColumn("deleted", F.col("apiName") == "Part").where("apiName != 'Event'")
    return merge.soft_delete_fields(f, o, F.lit("2024-01-31").cast("timestamp")).select("sobjectType", "apiName", "deleted")


@query("m11_rebuilt_rollup", f"WITH {_REFS} SELECT src AS sourceObject, dst AS targetObject, CAST(count(DISTINCT field) AS INTEGER) AS fieldCount FROM refs WHERE field <> 'l_partkey' GROUP BY 1, 2")
def m11(spark, sf_dir):
    f = C.fields(spark).withColumn("deleted", F.col("apiName") == "l_partkey")
    return merge.rebuild_rollup(C.field_refs(spark), f).select("sourceObject", "targetObject", "fieldCount")


@query("m13_refresh_object", f"WITH {_FIELDS}, o(what, created, n) AS (VALUES ('Order', false, 3), ('Region', true, 0)) SELECT what, created, NOT created AS updated, (SELECT count(*) FROM flds WHERE sobjectType = what) AS fields, n :: BIGINT AS pickValues FROM o")
def m13(spark, sf_dir):
    known = C.objects(spark).where("apiName != 'Region'")
    out = None
    for name in ("Order", "Region"):
        o, f, p, counts = refresh.refresh_object(known, C.fields(spark), C.picklists(spark, sf_dir), C.described(spark), name, C.ORG, F.lit("2024-01-31").cast("timestamp"))
        assert o.where(F.col("apiName") == name).count() == 1
        part = counts.select(F.lit(name).alias("what"), "created", "updated", "fields", F.col("values").alias("pickValues"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m14_sync_relationships", f"WITH {_REFS} SELECT src AS sourceObject, dst AS targetObject, string_agg(DISTINCT field, ',') AS fields, string_agg(DISTINCT child, ',') AS children, CASE WHEN bool_or(kind = 'MasterDetail') THEN 'MASTER_DETAIL' ELSE 'LOOKS_UP' END AS relationshipType FROM refs GROUP BY 1, 2")
def m14(spark, sf_dir):
    refs = C.field_refs(spark)
    old = refs.where("fieldName != 'l_partkey'").withColumn("relationshipType", F.when(F.col("sourceObject") == "Lineitem", "Lookup").otherwise(F.col("relationshipType")))
    _, _, rolled = refresh.sync_relationships(C.objects(spark), old, C.described(spark), C.child_relationships(C.described(spark)), "Lineitem", C.ORG)
    return rolled.select("sourceObject", "targetObject", F.array_join("fields", ",").alias("fields"), F.array_join("childRelationshipNames", ",").alias("children"), "relationshipType")


@query("m16_documentation", _values("apiName, description, filterable, sortable", [("a", "own text", True, False), ("b", "from the page", False, True), ("c", None, True, True)]))
def m16(spark, sf_dir):
    f = spark.createDataFrame([("T", "a", "own text", False, False, False), ("T", "b", "", True, True, False), ("T", "c", None, True, True, False)], "sobjectType string, apiName string, description string, filterable boolean, sortable boolean, groupable boolean")
    d = spark.createDataFrame([("T", "a", "unused", ["Filter"]), ("T", "b", "from the page", ["Sort", "Group"])], "sobjectType string, apiName string, docText string, properties array<string>")
    return merge.apply_documentation(f, d).select("apiName", "description", "filterable", "sortable")


@query("m18_category_upsert", _values("apiName, category, confidence", [("A", "core", 0.9), ("A", "extra", 0.5), ("B", "core", 0.4)], "apiName, category, confidence :: DOUBLE AS confidence"))
def m18(spark, sf_dir):
    kind = "apiName string, category string, confidence double, source string, rule string"
    old = spark.createDataFrame([("A", "core", 0.1, "rule", "r1"), ("B", "core", 0.4, "rule", "r1")], kind)
    return refresh.assign_categories(old, spark.createDataFrame([("A", "core", 0.9, "rule", "r2"), ("A", "extra", 0.5, "rule", "r3")], kind)).select("apiName", "category", "confidence")


@query("m20_full_load", "SELECT s_suppkey, s_name, NULL :: DOUBLE AS s_acctbal FROM supplier WHERE s_acctbal > 0")
def m20(spark, sf_dir):
    s = C.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return refresh.full_load(s, s.where("s_acctbal > 0").drop("s_acctbal"))


@query("m22_seeded_examples", "SELECT conv_id AS id, sha256(text) AS contentHash, 'hash' AS model, 64 AS width FROM conversations WHERE turn = 0 AND text IS NOT NULL")
def m22(spark, sf_dir):
    return _examples(spark, sf_dir).select("id", "contentHash", F.col("embeddingModel").alias("model"), F.size("embedding").alias("width"))


def _examples(spark, sf_dir):
    c = C.read(spark, sf_dir, "conversations").where("turn = 0 and text is not null")
    rows = c.select(F.col("conv_id").alias("id"), F.col("text").alias("question"), F.lit("SELECT Id FROM Account").alias("soql"), F.split(F.lower(F.substring("text", 1, 40)), "\\s+").alias("patterns"))
    return store.seed_examples(rows, "hash")


# --- reads (G), paths (P)


@query("g03_object_fields", f"WITH {_FIELDS} SELECT apiName, type FROM flds WHERE sobjectType = 'Customer'")
def g03(spark, sf_dir):
    f = C.fields(spark)
    older = f.withColumn("type", F.lit("old")).withColumn("lastRefreshed", F.lit("2020-01-01").cast("timestamp"))
    newer = f.withColumn("lastRefreshed", F.lit("2024-01-01").cast("timestamp"))
    return graph.object_fields(older.unionByName(newer), "CUSTOMER").select("apiName", "type")


@query("g11_objects_in_category", f"WITH {_OBJECTS} SELECT apiName, label, CAST(0.98 AS DOUBLE) AS confidence FROM objs WHERE apiName IN ('Order', 'Event')")
def g11(spark, sf_dir):
    o = C.objects(spark)
    tagged = tagging.tag_objects(o.withColumn("namespace", F.lit(None).cast("string")), C.field_refs(spark), tagging.rules(spark, [r for r in tagging.OBJECT_RULES if r[0] == "core_business_objects"]))
    return graph.in_category(tagged, o, "business_core")


@query("g12_properties", f"WITH {_FIELDS}, {_REFS}, {_REFD} SELECT apiName, sobjectType, type, 'standard' AS category, array_to_string(targets, ',') AS referenceTo FROM refd WHERE apiName IN ('user_id', 'c_name')")
def g12(spark, sf_dir):
    f = C.fields(spark)
    return graph.field_properties(f, "Event", "user_id").unionByName(graph.field_properties(f, "Customer", "c_name")).select("apiName", "sobjectType", "type", "category", "referenceTo")


@query("g12_lookup_test", f"WITH {_OBJECTS}, {_REFS} SELECT apiName, apiName IN (SELECT src FROM refs WHERE dst = 'Nation') AS hasLookup FROM objs")
def g12_lookup(spark, sf_dir):
    return graph.lookups_to(C.objects(spark), C.field_refs(spark), "Nation")


@query("g12_object_properties", _values("apiName, label, namespace, category, subtype", [("Order", "Sales Order", None, "standard", None), ("ns__Thing__Share", "Thing Share", "ns", "system", "share")]))
def g12_object(spark, sf_dir):
    o = C.objects(spark).unionByName(spark.createDataFrame([("ns__Thing__Share", C.ORG, "Thing Share", "system", False)], C.objects(spark).schema))
    return graph.object_properties(o, "Order").unionByName(graph.object_properties(o, "ns__Thing__Share"))


@query("g12_custom_objects", _values("apiName", [("A__c",), ("B__c",)]))
def g12_custom(spark, sf_dir):
    o = C.objects(spark).unionByName(spark.createDataFrame([(n, C.ORG, n, "custom", False) for n in ("B__c", "A__c")], C.objects(spark).schema))
    return graph.custom_objects(o)


@query("g13_summary_read", f"WITH {_OBJECTS}, {_REFS}, r AS (SELECT DISTINCT src, dst FROM refs), e AS (SELECT src AS n FROM r UNION ALL SELECT dst FROM r) SELECT (SELECT count(*) FROM objs) AS objectCount, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY n)) AS mostEdges, 5 :: BIGINT AS listed")
def g13(spark, sf_dir):
    x = merge.global_summary(C.objects(spark), merge.rollup(C.field_refs(spark)))
    return x.agg(F.max("objectCount").alias("objectCount"), F.max("degree").alias("mostEdges"), F.count("*").alias("listed"))


@query("g16_status", f"WITH {_OBJECTS} SELECT count(*) > 0 AS populated, count(*) AS objectCount FROM objs WHERE apiName <> 'Part'")
def g16(spark, sf_dir):
    return graph.status(C.objects(spark).withColumn("deleted", F.col("apiName") == "Part"))


@query("g18_unembedded", f"WITH {_OBJECTS}, {_FIELDS} SELECT 'Object' AS kind, apiName AS id FROM objs WHERE apiName <> 'Order' UNION ALL SELECT 'Field', sobjectType || '.' || apiName FROM flds WHERE type <> 'reference'")
def g18(spark, sf_dir):
    have = C.fields(spark).where("type = 'reference'").select(F.lit("Field").alias("kind"), F.concat_ws(".", "sobjectType", "apiName").alias("id")).unionByName(spark.createDataFrame([("Object", "Order")], "kind string, id string"))
    return graph.unembedded(C.objects(spark), C.fields(spark), have)


@query("g19_fields_with_owner", f"WITH {_OBJECTS}, {_FIELDS} SELECT sobjectType, f.apiName, type, label AS objectLabel FROM flds f JOIN objs o ON sobjectType = o.apiName")
def g19(spark, sf_dir):
    return graph.fields_with_owner(C.fields(spark), C.objects(spark), org=C.ORG).select("sobjectType", "apiName", "type", "objectLabel")


@query("p05_consolidated", _values("path, hop, a, b, direction, fields", [("X>Y", 0, "X", "Y", "up", "f,g,h")]))
def p05(spark, sf_dir):
    hops = spark.createDataFrame([("X>Y", 0, "X", "Y", "down", "f,g"), ("X>Y", 0, "X", "Y", "up", "g,h")], "path string, hop int, from string, to string, direction string, fields string")
    return graph.consolidate(hops).select("path", "hop", F.col("from").alias("a"), F.col("to").alias("b"), "direction", "fields")


@query("p06_query_paths", f"""WITH RECURSIVE {_REFS}, w(nodes, ids, ups, node) AS (SELECT ['Lineitem'], [] :: VARCHAR[], [] :: VARCHAR[], 'Lineitem' UNION ALL
SELECT list_append(nodes, dst), list_append(ids, src || field || dst), list_append(ups, rel), dst FROM w JOIN refs ON src = node WHERE len(ids) < 5 AND NOT list_contains(ids, src || field || dst))
SELECT array_to_string(nodes, '>') AS path, CAST(len(ids) AS INTEGER) AS hops, array_to_string(ups, '.') AS dot, len(ids) > 5 AS tooDeep, row_number() OVER (ORDER BY len(ids), array_to_string(nodes, '>')) = 1 AS recommended FROM w WHERE node = 'Nation'""")
def p06(spark, sf_dir):
    return graph.query_paths(C.field_refs(spark), "Lineitem", "Nation").select("path", "hops", "dot", "tooDeep", "recommended")


@query("p06_down_paths", _values("path, hops, subquery", [("Region>Nation>Supplier", 2, "Nations.Suppliers")]))
def p06_down(spark, sf_dir):
    return graph.query_paths(C.field_refs(spark), "Region", "Supplier").where("dot is null").select("path", "hops", "subquery")


@query("p07_path_tree", _values("line, text", [(1, "Lineitem"), (2, "  -> Order (via l_orderkey)"), (3, "    -> Customer"), (4, "  -> Supplier")]))
def p07(spark, sf_dir):
    tree = graph.path_tree([["Lineitem", "Order", "Customer"], ["Lineitem", "Supplier"]], {("Lineitem", "Order"): "l_orderkey"})
    return spark.createDataFrame(list(enumerate(tree.split("\n"), 1)), "line int, text string")


@query("p09_search_nodes", f"WITH {_OBJECTS}, {_FIELDS} SELECT o.apiName AS id, o.label, 'standard' AS category, count(f.apiName) AS fieldCount, false AS isCenter FROM objs o LEFT JOIN flds f ON sobjectType = o.apiName WHERE contains(lower(o.apiName), 'er') GROUP BY 1, 2")
def p09(spark, sf_dir):
    return graph.search_nodes(graph.search_objects(C.objects(spark), "er"), C.fields(spark))


# --- text, vectors (F, E)


@query("f03_escaped", "SELECT p_partkey, true AS same FROM part")
def f03(spark, sf_dir):
    odd = "a.b*c[d]"
    return C.read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(odd), "p_name").rlike("^" + text.regex_escape(odd)).alias("same"))


@query("f06_synonym_objects", _values("word, apiName", [("deal", "Opportunity"), ("ticket", "Case"), ("file", "Attachment"), ("file", "ContentDocument"), ("file", "ContentVersion"), ("line item", "OpportunityLineItem"), ("line item", "OrderItem"), ("team", "Group")]))
def f06(spark, sf_dir):
    return search.synonyms(spark).where(F.col("word").isin("deal", "ticket", "file", "line item", "team")).select("word", "apiName")


@query("f11_cache_jaccard", _values("a, b, s", [("show all accounts", "list the accounts", 1.0), ("the", "a", 1.0), ("open deals", "me", 0.0), ("open deals owned", "deals owned", 2 / 3)], "a, b, CAST(round(s, 6) AS DOUBLE) AS s"))
def f11(spark, sf_dir):
    x = spark.createDataFrame([("show all accounts", "list the accounts"), ("the", "a"), ("open deals", "me"), ("open deals owned", "deals owned")], "a string, b string")
    return x.select("a", "b", F.round(text.cache_jaccard(F.col("a"), F.col("b")), 6).alias("s"))


@query("f13_embedding_parts", _values("id, t", [(1, "Deal size. (Amount). on Opportunity. Type: currency. How much. Shown above. Related to: Account, Lead"), (2, None), (3, "Amount")]))
def f13(spark, sf_dir):
    kind = "id int, name string, label string, owner string, type string, d string, h string, r array<string>"
    x = spark.createDataFrame([(1, "Amount", "Deal size", "Opportunity", "currency", "How much", "Shown above", ["Account", "Lead"]), (2, "Abc", "", None, None, None, None, []), (3, "Amount", "Amount", "", "", "", None, None)], kind)
    return x.select("id", text.embedding_text(*[F.col(c) for c in ("name", "label", "owner", "type", "d", "h", "r")]).alias("t"))


@query("f16_search_text", _values("id, t", [(1, "FIND {acme} IN NAME FIELDS RETURNING Account(Id, Name LIMIT 5), Contact(Id LIMIT 5)")]))
def f16(spark, sf_dir):
    return spark.createDataFrame([(1, text.search_query("acme", {"Account": ["Id", "Name"], "Contact": ["Id"]}))], "id int, t string")


@query("f19_core_fields", _values("id, object, columns", [(1, "Account", "Id,Name,CreatedDate,LastModifiedDate,Phone"), (2, None, "Id,Name,CreatedDate,LastModifiedDate")]))
def f19(spark, sf_dir):
    x = spark.createDataFrame([(1, "select Phone from  Account where A = 1", ["Phone", "Name"]), (2, "nothing", [])], "id int, soql string, c array<string>")
    return x.select("id", text.main_object(F.col("soql")).alias("object"), F.array_join(text.with_core(F.col("c")), ",").alias("columns"))


@query("f20_model_flags", _values("flag, provider, model", [("openai:gpt-x", "openai", "gpt-x"), ("ollama:llama:8b", "ollama", "llama:8b"), ("plain", "ollama", "small"), ("other:x", "ollama", "small"), (None, "ollama", "small")], "flag, provider, CASE WHEN model = 'small' THEN coalesce(flag, 'small') ELSE model END AS model"))
def f20(spark, sf_dir):
    x = spark.createDataFrame([("openai:gpt-x",), ("ollama:llama:8b",), ("plain",), ("other:x",), (None,)], "flag string")
    return x.select("flag", calls.model_flag(F.col("flag"), "ollama", "small").alias("m")).select("flag", "m.*")


@query("f21_display_names", _values("kind, name", [("standard", "Standard Objects"), ("custom", "Custom Objects"), ("external", "External Objects"), ("metadata_type", "Custom Metadata Types"), ("platform_event", "Platform Events"), ("system", "System Objects"), ("none", None)]))
def f21(spark, sf_dir):
    x = spark.createDataFrame([(k,) for k in ("standard", "custom", "external", "metadata_type", "platform_event", "system", "none")], "kind string")
    return x.select("kind", naming.display_name(F.col("kind")).alias("name"))


@query("f22_lookup_names", "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM supplier")
def f22(spark, sf_dir):
    return C.read(spark, sf_dir, "supplier").select("s_suppkey", text.normalised(F.col("s_name")).alias("n"))


@query("e04_indexes", _values("name, label, dimensions, similarity", [("fields", "Field", 64, "cosine"), ("objects", "Object", 64, "cosine")]))
def e04(spark, sf_dir):
    v = store.prepare_objects(C.objects(spark)).select(search.hash_embedding(F.col("text")).alias("embedding"))
    x = store.no_indexes(spark)
    for name, label in (("objects", "Object"), ("fields", "Field"), ("old", "Old"), ("objects", "Again")):
        x = store.create_index(x, name, label, v)
    return store.drop_index(x, "old").select("name", "label", "dimensions", "similarity")


@query("e05_vector_upsert", "SELECT vec_id, CASE WHEN label = 3 THEN 'new' ELSE 'old' END AS contentHash FROM embeddings")
def e05(spark, sf_dir):
    v = C.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    old = v.select("vec_id", "embedding", F.lit("old").alias("contentHash"))
    after = store.upsert_vectors(old, v.where("label = 3").select("vec_id", "embedding", F.lit("new").alias("contentHash")), ["vec_id"])
    return store.stored_hashes(after, v, ["vec_id"])


@query("e07_max_score", f"SELECT q.vec_id AS query, round(max({_COS}), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id GROUP BY 1")
def e07(spark, sf_dir):
    v, q = _query_vectors(spark, sf_dir)
    scored = search.best_scores(v, q.withColumnRenamed("q", "embedding"), "vec_id")
    return search.max_scores(scored, "query").select("query", F.round("score", 6).alias("score"))


@query("e09_lexical_hybrid", f"WITH {_OBJECTS}, w AS (SELECT apiName, list_distinct(list_filter(regexp_split_to_array(lower(apiName || ' ' || label), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, ['sales', 'order', 'item'] AS b FROM objs) SELECT apiName, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS score FROM w")
def e09(spark, sf_dir):
    return search.lexical_semantic(C.objects(spark), "sales order item").select("apiName", F.round("score", 6).alias("score"))


@query("e10_object_search", _values("term, apiName, tier, confidence", [("Sales Order", "Order", 0, 1.0), ("nation", "Nation", 0, 1.0), ("parts", "Part", 2, 0.85), ("purchases", "Order", 2, 0.85), ("meeting", "Event", 2, 0.85), ("Thing", "Thing__c", 1, 0.95)], "term, apiName, tier, confidence :: DOUBLE AS confidence"))
def e10(spark, sf_dir):
    o = C.objects(spark).select("apiName", "label").unionByName(spark.createDataFrame([("Thing__c", "Great things")], "apiName string, label string"))
    terms = spark.createDataFrame([(t,) for t in ("Sales Order", "nation", "parts", "purchases", "meeting", "Thing", "nothing")], "term string")
    return search.search(o, None, terms)


@query("e11_field_search", _values("term, object, sobjectType, apiName, similarity, source", [
    ("c_name", None, "Customer", "c_name", 1.0, "exact_match"), ("doc_id", None, "Document", "doc_id", 1.0, "exact_match"), ("doc_id", None, "Label", "doc_id", 1.0, "exact_match"), ("doc_id", "Label", "Label", "doc_id", 1.0, "exact_match"),
    ("sources", "Document", "Document", "source", 0.85, "fuzzy_match"), ("meaning", None, "Document", "text", 0.75, "semantic"),
], "term, object, sobjectType, apiName, similarity :: DOUBLE AS similarity, source"))
def e11(spark, sf_dir):
    terms = spark.createDataFrame([("c_name", None), ("doc_id", None), ("doc_id", "Label"), ("sources", "Document"), ("meaning", None), ("qqq", None)], "term string, object string")
    near = spark.createDataFrame([("meaning", "Document", "text", 0.75), ("meaning", "Document", "lang", 0.2), ("c_name", "Part", "p_name", 0.9)], "term string, sobjectType string, apiName string, score double")
    return store.find_fields(C.fields(spark), terms, near)


@query("e13_vector_sync", f"WITH {_FIELDS} SELECT count(*) AS processed, count(*) FILTER (WHERE type <> 'reference') AS embedded, count(*) FILTER (WHERE type = 'reference') AS skipped FROM flds")
def e13(spark, sf_dir):
    every = store.prepare_fields(C.fields(spark))
    same = store.prepare_fields(C.fields(spark).where("type = 'reference'")).select("kind", "id", search.hash_embedding(F.col("text")).alias("embedding"), "contentHash")
    return store.sync_vectors(every, same)[1]


@query("e14_hash_embeddings", "SELECT conv_id, turn, 64 AS width, true AS same FROM conversations")
def e14(spark, sf_dir):
    c = C.read(spark, sf_dir, "conversations")
    e = search.hash_embedding(F.coalesce("text", F.lit("")))
    again = search.hash_embedding(F.upper(F.coalesce("text", F.lit(""))))
    return c.select("conv_id", "turn", F.size(e).alias("width"), (e == again).alias("same"))


@query("e14_provider", "SELECT conv_id, turn, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e FROM conversations")
def e14_provider(spark, sf_dir):
    asked = calls.embedder(lambda texts: [[len(t), t.count("e")] for t in texts], batch=16)
    v = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", asked(F.col("text")).alias("v"))
    return v.select("conv_id", "turn", F.col("v")[0].cast("long").alias("n"), F.col("v")[1].cast("long").alias("e"))


@query("e15_prepared", f"WITH {_PICKS} SELECT 'PicklistValue' AS kind, objectApiName || '.' || fieldApiName || '.' || value AS id, sha256(value || '. on ' || objectApiName) AS contentHash FROM picks")
def e15(spark, sf_dir):
    return store.prepare_values(C.picklists(spark, sf_dir)).select("kind", "id", "contentHash")


@query("e16_example_search", "SELECT id, CAST(1 AS DOUBLE) AS score FROM (SELECT min(conv_id) AS id FROM conversations WHERE turn = 0 AND text IS NOT NULL)")
def e16(spark, sf_dir):
    x = _examples(spark, sf_dir)
    first = x.orderBy("id").select("embedding").first()[0]
    found = store.search_examples(x, F.array(*[F.lit(float(v)) for v in first]), 50, "hash")
    return found.where(F.round("score", 6) == 1).agg(F.min("id").alias("id"), F.round(F.max("score"), 6).alias("score"))


@query("e17_examples_with", "SELECT conv_id AS id FROM conversations WHERE turn = 0 AND list_contains(regexp_split_to_array(lower(substr(text, 1, 40)), '\\s+'), 'the')")
def e17(spark, sf_dir):
    x = _examples(spark, sf_dir)
    assert store.without_examples(x).isEmpty()
    return store.examples_with(x, "the").select("id")


@query("e18_prompt_blocks", _values("id, block", [(1, "Example 1:\nQuestion: all accounts\nSOQL: SELECT Id FROM Account"), (5, "Example 2:\nQuestion: all leads\nSOQL: SELECT Id FROM Lead")]))
def e18(spark, sf_dir):
    return search.format_examples(spark.createDataFrame([(5, "all leads", "SELECT Id FROM Lead"), (1, "all accounts", "SELECT Id FROM Account")], "id int, question string, soql string"))


# --- categories, grounding (C, N)


@query("c01_rules", "SELECT kind, count(*) AS n, max(priority) AS most FROM (VALUES ('NAME', 100), ('NAME', 98), ('CATEGORY', 95), ('CATEGORY', 95), ('CATEGORY', 95), ('CATEGORY', 95), ('NAMESPACE', 85), ('NAMESPACE', 80), ('LOOKUP', 70), ('LOOKUP', 70), ('LOOKUP', 70), ('CATEGORY', 50), ('CATEGORY', 40)) t(kind, priority) GROUP BY 1")
def c01(spark, sf_dir):
    return tagging.rules(spark, tagging.OBJECT_RULES).groupBy("kind").agg(F.count("*").alias("n"), F.max("priority").alias("most"))


_TAGGED = [
    ("Account", "business_core", 0.98, 1), ("Invoice__c", "business_extended", 0.85, 1), ("Account__Share", "system_derived", 0.95, 1), ("Setting__mdt", "custom_metadata", 0.99, 1), ("Ping__e", "platform_event", 0.99, 1),
    ("pkg__Thing__c", "managed_package", 0.9, 1), ("pkg__Thing__c", "business_extended", 0.6, 2), ("Profile", "system", 0.95, 1), ("Profile", "business_core", 0.7, 2), ("Note", "business_core", 0.7, 1),
]


def _tag_input(spark):
    n = F.col("apiName")
    o = spark.createDataFrame([(x,) for x in dict.fromkeys(t[0] for t in _TAGGED)], "apiName string").select(n, naming.category(n).alias("category"), naming.namespace(n).alias("namespace"))
    return o, spark.createDataFrame([("Invoice__c", "Account")], "sourceObject string, targetObject string"), tagging.rules(spark, tagging.OBJECT_RULES)


@query("c02_object_categories", _values("apiName, category, confidence, rank", _TAGGED, "apiName, category, confidence :: DOUBLE AS confidence, rank"))
def c02(spark, sf_dir):
    return tagging.tag_objects(*_tag_input(spark)).select("apiName", "category", "confidence", "rank")


@query("c04_primary_categories", _values("apiName, category", [t[:2] for t in _TAGGED if t[3] == 1]))
def c04(spark, sf_dir):
    return tagging.tag_objects(*_tag_input(spark)).where("rank = 1").select("apiName", "category")


@query("c05_bulk_run", _values("category, objects, primaries", [("business_core", 3, 2), ("business_extended", 2, 1), ("custom_metadata", 1, 1), ("managed_package", 1, 1), ("platform_event", 1, 1), ("system", 1, 1), ("system_derived", 1, 1), (None, 0, 0)], "category, objects :: BIGINT AS objects, primaries :: BIGINT AS primaries"))
def c05(spark, sf_dir):
    return tagging.tag_all(*_tag_input(spark))


@query("c08_soql_patterns", _values("category, soql", [
    ("business_core", "SELECT Id, Name, {fields} FROM T WHERE {filter}"), ("business_extended", "SELECT Id, Name, {lookupField} FROM T WHERE {lookupField} = '{lookupValue}'"), ("system", "SELECT Id, {fields} FROM T WHERE CreatedDate = TODAY"),
    ("system_derived", "SELECT Id, ParentId, {fields} FROM TFeed WHERE ParentId = '{parentId}'"), ("custom_metadata", "SELECT Id, DeveloperName, MasterLabel, {fields} FROM T"), ("platform_event", "// Platform Events are published, not queried"),
    ("managed_package", "SELECT Id, Name, {namespace}__{field} FROM {namespace}__T"), ("lifecycle", "{field} = 'v'"), ("big_object", "SELECT Id, {fields} FROM T WHERE {indexedField} = 'v'"), ("external_object", "SELECT Id, ExternalId, {fields} FROM T"),
    ("financial", "{field} {operator} v"), ("temporal", "{field} {operator} {date_literal}"), ("unheard", None),
]))
def c08(spark, sf_dir):
    x = spark.createDataFrame([(c,) for c in ("business_core", "business_extended", "system", "system_derived", "custom_metadata", "platform_event", "managed_package", "lifecycle", "big_object", "external_object", "financial", "temporal", "unheard")], "category string")
    return x.select("category", tagging.soql_pattern(F.col("category"), object=F.lit("T"), value=F.lit("v")).alias("soql"))


@query("n02_filter_kinds", _values("term, filter", [
    ("2024-01-15", "CreatedDate = 2024-01-15"), ("last month", "CreatedDate = LAST_MONTH"), ("$1,500.00", "Amount >= 1500"), ("2.5m", "Amount >= 2500000"), ("A@b.com", "Email = 'a@b.com'"), ("(555) 123-4567", "Phone LIKE '%5551234567%'"),
    ("https://x.org", "Website = 'https://x.org'"), ("high", "Priority = 'High'"), ("in progress", "Status = 'In Progress'"), ("00Q5e00001AbCdE", "Id = '00Q5e00001AbCdE'"), ("nonsense", None),
]))
def n02(spark, sf_dir):
    terms = ["2024-01-15", "last month", "$1,500.00", "2.5m", "A@b.com", "(555) 123-4567", "https://x.org", "high", "in progress", "00Q5e00001AbCdE", "nonsense"]
    return spark.createDataFrame([(t,) for t in terms], "term string").select("term", values.suggested_filter(values.pattern(F.col("term"))).alias("filter"))


_GROUNDED = [("BUILDING", 1, "picklist_value", 1.0, "Customer.c_mktsegment = 'BUILDING'"), ("customer", 1, "object_reference", 0.95, "FROM Customer"), ("TODAY", 1, "date_reference", 0.98, "CreatedDate = TODAY"), ("High", 1, "priority_value", 0.9, "Priority = 'High'"), ("build", 1, "picklist_value", 0.9, "Customer.c_mktsegment = 'BUILDING'"), ("Acme", 1, "company_name", 0.8, "Account.Name = 'Acme'")]


@query("n05_ground", f"WITH {_PICKS}, g AS ({_values('term, rank, type, confidence, filter', _GROUNDED)}) SELECT term, rank, type, confidence :: DOUBLE AS confidence, filter FROM g UNION ALL SELECT 'High', CAST(1 + row_number() OVER (ORDER BY fieldApiName, value) AS INTEGER), 'picklist_value', 0.7, objectApiName || '.' || fieldApiName || ' = ''' || value || '''' FROM picks WHERE contains(lower(value), 'high')")
def n05(spark, sf_dir):
    t = spark.createDataFrame([(g[0],) for g in _GROUNDED], "term string")
    names = spark.createDataFrame([("Acme", "Account.Name = 'Acme'", 0.8), ("customer", "unused", 0.8)], "term string, filter string, confidence double")
    return grounding.ground(t, C.picklists(spark, sf_dir), C.objects(spark), names=names).select("term", "rank", "type", "confidence", "filter")


@query("n07_related_context", f"WITH {_REFS} SELECT DISTINCT dst AS apiName FROM refs WHERE src = 'Customer' UNION SELECT src FROM refs WHERE dst = 'Customer' UNION SELECT 'Part'")
def n07(spark, sf_dir):
    categories = spark.createDataFrame([("Part", "business_core"), ("Label", "system")], "apiName string, category string")
    return grounding.related_context(C.field_refs(spark), categories, ["Customer"])


@query("n08_entity_types", _values("type, entity", [("account_name", "company_name"), ("contact_name", "person_name"), ("picklist_value", "status_value"), ("priority_value", "priority_value"), ("status_value", "status_value"), ("object_reference", "object_reference"), ("date_reference", "date_reference"), ("numeric_value", "numeric_value"), ("id_reference", "object_reference"), ("field_reference", "unknown")]))
def n08(spark, sf_dir):
    kinds = ["account_name", "contact_name", "picklist_value", "priority_value", "status_value", "object_reference", "date_reference", "numeric_value", "id_reference", "field_reference"]
    g = spark.createDataFrame([(k, k, 1, 0.9) for k in kinds], "term string, type string, rank int, confidence double")
    return grounding.entities(g.select("term"), g).select(F.col("term").alias("type"), "entity")


@query("n09_notes", _values("term, note", [("TODAY", '"TODAY" is a date reference: CreatedDate = TODAY'), ("High", '"High" is a priority value: Priority = \'High\'')]))
def n09(spark, sf_dir):
    t = spark.createDataFrame([("TODAY",), ("High",)], "term string")
    return grounding.notes(grounding.ground(t, C.picklists(spark, sf_dir), C.objects(spark)))


@query("n10_entities", _values("term, entity, confidence", [("BUILDING", "status_value", 1.0), ("Globex", "company_name", 0.6), ("qqq", "unknown", 0.3), ("today", "date_reference", 0.98), ("customer", "object_reference", 0.95)], "term, entity, confidence :: DOUBLE AS confidence"))
def n10(spark, sf_dir):
    t = spark.createDataFrame([("BUILDING",), ("Globex",), ("qqq",), ("today",), ("customer",), ("qqq",)], "term string")
    return grounding.entities(t, grounding.ground(t, C.picklists(spark, sf_dir), C.objects(spark)))


@query("n11_fallback", _values("term, kind, confidence", [("Last Month", "date_reference", 0.95), ("next year", "unknown", 0.3), ("$1,500.00", "numeric_value", 0.95), ("50k", "numeric_value", 0.95), ("001ABCDEFGHIJKL", "object_reference", 0.95), ("Ann Smith", "unknown", 0.5), ("nothing at all", "unknown", 0.3), ("2b", "unknown", 0.3)], "term, kind, confidence :: DOUBLE AS confidence"))
def n11(spark, sf_dir):
    terms = ["Last Month", "next year", "$1,500.00", "50k", "001ABCDEFGHIJKL", "Ann Smith", "nothing at all", "2b"]
    return spark.createDataFrame([(t,) for t in terms], "term string").select("term", values.fallback_entity(F.col("term")).alias("x")).select("term", "x.*")


@query("n12_classify_many", "SELECT DISTINCT c_mktsegment AS term, 'status_value' AS entity FROM customer")
def n12(spark, sf_dir):
    t = C.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("term"))
    return grounding.entities(t, grounding.ground(t, C.picklists(spark, sf_dir), C.objects(spark))).select("term", "entity")


# --- questions (L)

_ASKED = [(1, "accounts in California", "Account"), (2, "deals worth over 50k created last month", "Opportunity"), (3, "not active accounts with more than 100 employees", "Account"), (4, "cases created in the last 3 months", "Case"), (5, "contacts whose last name is Smith", "Contact")]


def _questions(spark, rows=_ASKED):
    return spark.createDataFrame(rows, "id int, question string, object string")


@query("l01_explicit", _values("id, field, operator, value", [(1, "BillingState", "=", "California"), (2, "Amount", ">", "50000"), (2, "CreatedDate", "=", "LAST_MONTH"), (3, "NumberOfEmployees", ">", "100"), (4, "CreatedDate", ">=", "LAST_N_MONTHS:3"), (5, "LastName", "=", "Smith")]))
def l01(spark, sf_dir):
    return questions.conditions(_questions(spark)).where("source = 'pattern'").select("id", "field", "operator", "value")


@query("l02_implied", _values("id, field, value", [(1, "IsWon", "true"), (2, "IsClosed", "false"), (3, "IsActive", "false")]))
def l02(spark, sf_dir):
    q = _questions(spark, [(1, "won deals", "Opportunity"), (2, "open cases", "Case"), (3, "inactive accounts", "Account")])
    return questions.conditions(q).where("source = 'implied'").select("id", "field", "value")


@query("l03_location", _values("id, field, value", [(1, "BillingState", "New York"), (2, "MailingState", "Texas"), (3, "State", "Ohio")]))
def l03(spark, sf_dir):
    q = _questions(spark, [(1, "accounts located in New York", "Account"), (2, "contacts from Texas", "Contact"), (3, "leads based in Ohio", "Lead"), (4, "cases in Ohio", "Case")])
    return questions.conditions(q).where("source = 'location'").select("id", "field", "value")


@query("l05_collected", _values("id, field, value", [(1, "BillingState", "California"), (3, "NumberOfEmployees", "100")]))
def l05(spark, sf_dir):
    f = spark.createDataFrame([("Account", "BillingState"), ("Account", "NumberOfEmployees")], "sobjectType string, apiName string")
    return questions.conditions(_questions(spark), f).select("id", "field", "value").distinct()


@query("l06_identified_objects", _values("id, apiName, confidence", [(1, "Customer", 0.95), (1, "Nation", 0.8), (2, "Order", 0.8), (2, "Part", 0.8)], "id, apiName, confidence :: DOUBLE AS confidence"))
def l06(spark, sf_dir):
    q = _questions(spark, [(1, "customers of a nation", ""), (2, "which order holds this part", "")]).drop("object")
    hits = spark.createDataFrame([(1, "Customer", 0.95)], "id int, apiName string, confidence double")
    return questions.identify_objects(q, C.objects(spark), hits)


@query("l07_identified_fields", _values("id, sobjectType, apiName", [(1, "Customer", "c_name"), (1, "Customer", "c_acctbal"), (2, "Document", "text"), (2, "Document", "lang")]))
def l07(spark, sf_dir):
    return questions.identify_fields(_questions(spark, [(1, "c_name and C_ACCTBAL please", "Customer"), (2, "text by lang", "Document")]), C.fields(spark))


@query("l08_order_limit", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'top|highest|largest|most') AND NOT regexp_matches(lower(text), 'order by|sort by') AND contains(lower(text), 'opportunities') THEN 'Amount DESC' END AS by, coalesce(try_cast(nullif(regexp_extract(lower(text), 'limit\\s+(\\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(lower(text), 'top\\s+(\\d+)', 1), '') AS INTEGER)) AS n FROM conversations")
def l08(spark, sf_dir):
    by, n = questions.order_and_limit(F.col("text"))
    return C.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", by["field"], by["direction"]).alias("by"), n.alias("n")).withColumn("by", F.nullif("by", F.lit("")))


@query("l08_ordered_questions", _values("id, field, n", [(1, "Amount", 5), (2, None, 10), (3, None, None), (4, "Amount", None), (5, None, 3)]))
def l08_cases(spark, sf_dir):
    q = _questions(spark, [(1, "Top 5 Opportunities", ""), (2, "highest accounts limit 10", ""), (3, "top opportunities order by name", ""), (4, "the largest opportunities", ""), (5, "first 9 leads, limit 3, top 4", "")])
    by, n = questions.order_and_limit(F.col("question"))
    return q.select("id", by["field"].alias("field"), n.alias("n"))


@query("l09_needed_fields", _values("id, apiName", [(1, "Id"), (1, "Phone"), (1, "CreatedDate"), (2, "Id"), (2, "Amount"), (2, "StageName"), (2, "Name"), (3, "Id"), (3, "Name"), (3, "LastName")]))
def l09(spark, sf_dir):
    f = spark.createDataFrame([("Account", n) for n in ("Id", "Name", "Phone", "CreatedDate", "Industry")] + [("Opportunity", n) for n in ("Id", "Amount", "StageName", "Name")] + [("Contact", n) for n in ("Id", "Name", "LastName", "FirstName")], "sobjectType string, apiName string")
    q = spark.createDataFrame([(1, "phone of accounts created this week", "Account", ["Industry", "Ghost"]), (2, "deals worth most", "Opportunity", ["StageName", "Name"]), (3, "contacts by last name", "Contact", ["FirstName"])], "id int, question string, object string, proposed array<string>")
    return questions.needed_fields(q.withColumn("question", F.when(F.col("id") == 2, "deals worth most by stagename").otherwise(F.col("question"))), f)


@query("l10_potential_entities", _values("id, entities, vals", [(1, "Invoice__c", "Open"), (2, "Globex", "Globex")]))
def l10(spark, sf_dir):
    e, v = questions.potential_entities(F.col("question"))
    q = _questions(spark, [(1, "open Invoice__c records", ""), (2, "deals of Globex", "")])
    return q.select("id", F.array_join(e, ",").alias("entities"), F.array_join(v, ",").alias("vals"))


@query("l11_relationship_intents", _values("id, kind, source, target", [(1, "parent_lookup", "Contacts", "Account"), (2, "child_subquery", "Accounts", "Contacts"), (2, "child_subquery", "Contacts", "Orders")]))
def l11(spark, sf_dir):
    q = spark.createDataFrame([(1, "contacts with their account name"), (2, "accounts that have contacts and their orders")], "id int, question string")
    return q.select("id", F.explode(questions.relationship_intents(F.col("question"))).alias("x")).select("id", "x.*")


@query("l12_global_intent", "SELECT conv_id, turn, len(list_filter(['overview', 'summarize', 'summary', 'structure', 'schema', 'how is my data', 'what objects', 'top objects', 'data model', 'big picture', 'all data', 'trends'], lambda x: contains(lower(text), x))) > 0 AS g FROM conversations")
def l12(spark, sf_dir):
    return C.read(spark, sf_dir, "conversations").select("conv_id", "turn", questions.is_global(F.col("text")).alias("g"))


@query("l12_global_questions", _values("id, g", [(1, True), (2, True), (3, True), (4, False), (5, True)]))
def l12_cases(spark, sf_dir):
    q = _questions(spark, [(1, "Give me the BIG PICTURE", ""), (2, "summarize everything", ""), (3, "what are the trends", ""), (4, "how many objects are in the architecture", ""), (5, "schemas of all", "")])
    return q.select("id", questions.is_global(F.col("question")).alias("g"))


@query("l13_processed", "SELECT conv_id, turn, trim(lower(text)) AS normalised FROM conversations")
def l13(spark, sf_dir):
    return C.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim(F.lower("text")).alias("normalised"))


@query("l14_sketches", _values("id, soql", [(1, "SELECT Id, Account.Name FROM Contact"), (2, "SELECT Id, Name, (SELECT Id FROM Opportunities) FROM Account"), (3, "SELECT Id, Name, (SELECT Id FROM Products) FROM Account"), (4, "SELECT Id, Name, (SELECT Id FROM Things) FROM Account")]))
def l14(spark, sf_dir):
    made = [questions.relationship_sketch("Contact", "Account", "parent_lookup"), *[questions.relationship_sketch("Account", c, "child_subquery") for c in ("Opportunity", "Product2", "Thing")]]
    return spark.createDataFrame(list(enumerate(made, 1)), "id int, soql string")


# --- context (X), samples (W)


@query("x03_object_schema", f"WITH {_OBJECTS}, {_FIELDS}, {_REFS}, {_PICKS} SELECT apiName, coalesce((SELECT string_agg(f.apiName || ':' || type, ';' ORDER BY f.apiName || ':' || type) FROM flds f WHERE sobjectType = o.apiName), '') AS fields, coalesce((SELECT string_agg(DISTINCT rel || '->' || dst, ';' ORDER BY rel || '->' || dst) FROM refs WHERE src = o.apiName), '') AS parents, coalesce((SELECT string_agg(DISTINCT child || '<-' || src, ';' ORDER BY child || '<-' || src) FROM refs WHERE dst = o.apiName), '') AS children, (SELECT count(*) FROM picks WHERE objectApiName = o.apiName) AS n FROM objs o")
def x03(spark, sf_dir):
    x = context.object_schema(C.objects(spark), C.fields(spark), C.field_refs(spark), C.picklists(spark, sf_dir))
    return x.select("apiName", *[F.array_join(c, ";").alias(c) for c in ("fields", "parents", "children")], F.size("values").cast("long").alias("n"))


@query("x05_skeleton", _values("apiName, line", [("B", "B (6): a, b, c, d, e"), ("A", "A (1): x")]))
def x05(spark, sf_dir):
    return context.skeleton(spark.createDataFrame([("A", 5, ["x"]), ("B", 20, ["a", "b", "c", "d", "e", "f"]), ("C", 1, ["z"])], "apiName string, score int, fields array<string>"), 2)


@query("x06_full_text", _values("apiName, text", [("Nation", "Object: Nation (Nation) [standard]\n  Fields:\n    - n_name (string)\n    - n_nationkey (int)\n    - n_regionkey (reference)\n  Parent lookups:\n    - Region.FieldName: fields of Region\n  Child relationships:\n    - (SELECT fields FROM Customers): records of Customer\n    - (SELECT fields FROM Suppliers): records of Supplier"), ("Label", "Object: Label (Quality Label) [standard]\n  Fields:\n    - doc_id (reference)\n    - quality (int)\n    - toxic (int)\n  Parent lookups:\n    - Document.FieldName: fields of Document")]))
def x06(spark, sf_dir):
    x = context.object_schema(C.objects(spark), C.fields(spark), C.field_refs(spark), C.picklists(spark, sf_dir))
    return context.full_text(x, C.objects(spark)).where("apiName in ('Nation', 'Label')")


@query("x07_fuzzy_cache", _values("step, answer", [(1, "one"), (2, None), (3, None), (4, "two"), (5, None)]))
def x07(spark, sf_dir):
    now = [0.0]
    cache = context.FuzzyCache(lambda: now[0], most=2)
    cache.put("o", "show open deals owned by sales", "one")
    out = [cache.get("o", "list open deals owned by sales"), cache.get("p", "list open deals owned by sales"), cache.get("o", "something else entirely")]
    cache.put("o", "count new leads", "two")
    now[0] = 299.0
    out.append(cache.get("o", "count new leads"))
    now[0] = 301.0
    out.append(cache.get("o", "count new leads"))
    return spark.createDataFrame(list(enumerate(out, 1)), "step int, answer string")


@query("x08_expansion", _values("apiName, total", [("B", 0.9), ("A", 0.4)], "apiName, total :: DOUBLE AS total"))
def x08(spark, sf_dir):
    near = spark.createDataFrame([("A",), ("B",), ("B",), ("C",), ("D",)], "apiName string")
    return context.expand(near, spark.createDataFrame([("A", 0.4), ("B", 0.9), ("C", 0.1)], "apiName string, total double"))


@query("x10_pruned_text", _values("apiName, fields", [("A", "x, y, z, w, v"), ("B", "p, a, b, c")]))
def x10(spark, sf_dir):
    merged = spark.createDataFrame([("A", n, k) for k, n in enumerate("xyzwv")] + [("B", "p", 0)], "sobjectType string, apiName string, rank int")
    return context.pruned_text(merged, spark.createDataFrame([("B", n) for n in "abcd"], "sobjectType string, apiName string"))


@query("x12_semantic_context", f"WITH {_FIELDS}, s AS (SELECT sobjectType, apiName, row_number() OVER (PARTITION BY sobjectType ORDER BY CASE WHEN contains(lower(apiName), 'name') THEN 5 ELSE 0 END + CASE WHEN type = 'reference' THEN 1 ELSE 0 END DESC, apiName) AS n FROM flds WHERE sobjectType IN ('Customer', 'Order')) SELECT sobjectType, apiName, CAST(n AS INTEGER) AS rank FROM s WHERE n <= 3")
def x12(spark, sf_dir):
    hits = spark.createDataFrame([("Customer", 0.9), ("Order", 0.8), ("Part", 0.7), ("Order", 0.95)], "apiName string, confidence double")
    return context.semantic_context(hits, C.objects(spark), C.fields(spark), F.array(F.lit("name")), F.lit("customer revenue"), most=2, cap=3)[0]


@query("w01_samples", "SELECT 100 :: BIGINT AS n, 100 :: BIGINT AS keys, true AS same, true AS some")
def w01(spark, sf_dir):
    from .operators import compare

    own = [(f, k, i > 0) for i, (o, f, k) in enumerate(x for x in C.FIELDS if x[0] == "Customer")]
    a, b = (compare.sample_rows(spark, own, 100) for _ in range(2))
    both = a.exceptAll(b).count()
    return a.agg(F.count("*").alias("n"), F.count("c_custkey").alias("keys"), F.lit(both == 0).alias("same"), F.count("c_name").between(60, 99).alias("some"))


@query("w02_related_samples", _values("object, n", [("Lineitem", 9), ("Order", 4), ("Part", 4), ("Supplier", 4)], "object, n :: BIGINT AS n"))
def w02(spark, sf_dir):
    from .operators import compare

    fields_of = {o: [(f, k, True) for x, f, k in C.FIELDS if x == o] for o in C.OBJECTS}
    made = compare.related_samples(spark, fields_of, [(o, t) for o, _, t, *_ in C.REFERENCES], "Lineitem", 9)
    out = None
    for name, df in made.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("object"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("h02_retries", _values("id, result, waits", [(1, "done", "1,2"), (2, "gave up", "1,2"), (3, "refused", "")]))
def h02(spark, sf_dir):
    def run(failures: list[str]) -> tuple[str, str]:
        left, waits = list(failures), []

        def call() -> str:
            if left:
                raise RuntimeError(left.pop(0))
            return "done"

        try:
            result = calls.retried(call, tries=3, first=1, sleep=waits.append)
        except RuntimeError as e:
            result = "gave up" if calls.may_retry(e) else "refused"
        return result, ",".join(map(str, waits))

    cases = [["ECONNRESET", "ECONNRESET"], ["ETIMEDOUT"] * 3, ["INVALID_FIELD"]]
    return spark.createDataFrame([(i, *run(c)) for i, c in enumerate(cases, 1)], "id int, result string, waits string")


@query("h04_retryable", _values("message, again", [("REQUEST_LIMIT_EXCEEDED: TotalRequests", True), ("read ECONNRESET", True), ("socket hang up", True), ("UNABLE_TO_LOCK_ROW", True), ("MALFORMED_QUERY", False), (None, False)]))
def h04(spark, sf_dir):
    x = spark.createDataFrame([("REQUEST_LIMIT_EXCEEDED: TotalRequests",), ("read ECONNRESET",), ("socket hang up",), ("UNABLE_TO_LOCK_ROW",), ("MALFORMED_QUERY",), (None,)], "message string")
    return x.select("message", calls.retryable(F.col("message")).alias("again"))


@query("st3_sliding", "WITH e AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), k AS (SELECT b - i * INTERVAL 6 HOUR AS start FROM e, range(0, 4) t(i)) SELECT start, count(*) AS n FROM k GROUP BY 1")
def st3(spark, sf_dir):
    from .streaming import sync

    return sync.sliding(C.read(spark, sf_dir, "events"))
