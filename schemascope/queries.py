"""Queries over the supplied tables, with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import naming, text, values
from .operators import compare, context, graph, grounding, ingest, merge, questions, search, tagging
from .plans.compile import Compiler
from .plans.staging import bounded
from .sources import catalog as C
from .streaming import sync

AS_OF = dt.date(2024, 1, 31)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLAGSHIP = "SELECT Nation.n_name, COUNT(c_custkey) cnt FROM Customer WHERE c_mktsegment = 'BUILDING' GROUP BY Nation.n_name ORDER BY Nation.n_name"


def soql(query: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Compiler(spark, C.records(spark, sf_dir), AS_OF, **options).run(query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soql(FLAGSHIP)(spark, sf_dir)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _sql_rows(rows: list[tuple]) -> str:
    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


#: The catalog's tables for the SQL side.
_OBJECTS = f"objs(apiName, label) AS (VALUES {_sql_rows([(n, label) for n, (_, _, label) in C.OBJECTS.items()])})"
_FIELDS = f"flds(sobjectType, apiName, type, ordinal) AS (VALUES {_sql_rows([(*f, i) for i, f in enumerate(C.FIELDS)])})"
_REFS = f"refs(src, field, dst, rel, child, kind) AS (VALUES {_sql_rows(C.REFERENCES)})"
_ROLL = "arcs AS (SELECT DISTINCT src, dst FROM refs)"
_BOTH = "both_ways AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs)"
_PICKS = "picks AS (" + " UNION ".join(f"SELECT '{o}' AS objectApiName, '{f}' AS fieldApiName, {f} AS value FROM {C.OBJECTS[o][0]}" for o, f in C.PICKLISTS) + ")"

# --- the query language (Q): SOQL text, and SQL

SOQL = {
    "q02_projection": ("SELECT c_custkey, c_name FROM Customer WHERE c_acctbal > 5000", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000"),
    "q03_parent_path": (
        "SELECT o_orderkey, Customer.c_name, Customer.Nation.n_name, Customer.Nation.Region.r_name FROM Order WHERE o_totalprice > 200000",
        "SELECT o_orderkey, c_name AS Customer_c_name, n_name AS Customer_Nation_n_name, r_name AS Customer_Nation_Region_r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 200000",
    ),
    "q05_aggregates": (
        "SELECT COUNT() n, COUNT(o_custkey) c, COUNT_DISTINCT(o_custkey) d, MIN(o_totalprice) lo, MAX(o_totalprice) hi FROM Order",
        "SELECT count(*) AS n, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders",
    ),
    "q07_group_by": (FLAGSHIP, "SELECT n_name AS Nation_n_name, count(c_custkey) AS cnt FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name"),
    "q08_having": (
        "SELECT o_custkey, COUNT(o_orderkey) n FROM Order GROUP BY o_custkey HAVING COUNT(o_orderkey) > 12 AND MAX(o_totalprice) > 100000",
        "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING count(o_orderkey) > 12 AND max(o_totalprice) > 100000",
    ),
    "q09_order_limit": ("SELECT o_orderkey, o_totalprice FROM Order ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "q10_offset": ("SELECT s_suppkey FROM Supplier ORDER BY s_suppkey LIMIT 10 OFFSET 5", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 5"),
    "q11_null_tests": ("SELECT c_custkey FROM Customer WHERE c_mktsegment != null AND c_acctbal > 9000 AND NOT Nation.n_name = null", "SELECT c_custkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IS NOT NULL AND c_acctbal > 9000 AND NOT n_name IS NULL"),
    "q12_like": ("SELECT c_custkey, c_name FROM Customer WHERE c_name LIKE '%1_7'", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_7'"),
    "q13_in_list": ("SELECT c_custkey FROM Customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)"),
    "q15_logic": ("SELECT p_partkey FROM Part WHERE NOT (p_size > 10 OR p_retailprice < 950) AND (p_brand = 'Brand#11' OR p_brand != 'Brand#12')", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_retailprice < 950) AND (p_brand = 'Brand#11' OR p_brand <> 'Brand#12')"),
    "q16_semi_join": ("SELECT c_custkey FROM Customer WHERE c_custkey IN (SELECT o_custkey FROM Order WHERE o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "q17_anti_join": ("SELECT c_custkey FROM Customer WHERE c_custkey NOT IN (SELECT o_custkey FROM Order WHERE o_totalprice > 100000)", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    "q18_parent_filter": ("SELECT o_orderkey FROM Order WHERE Customer.Nation.Region.r_name = 'ASIA' AND Customer.c_acctbal < 0", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal < 0"),
    "q19_polymorphic_type": ("SELECT event_id, event_type FROM Event WHERE Who.Type IN ('Customer') AND value > 50", f"SELECT event_id, event_type FROM events WHERE {C.WHO_TAG} IN ('Customer') AND value > 50"),
    "q20_date_literal": ("SELECT event_id FROM Event WHERE ts = LAST_N_DAYS:7 AND ts != YESTERDAY", "SELECT event_id FROM events WHERE ts >= DATE '2024-01-24' AND ts < DATE '2024-02-01' AND NOT (ts >= DATE '2024-01-30' AND ts < DATE '2024-01-31')"),
    "q20_date_literal_month": ("SELECT COUNT() n FROM Event WHERE ts = THIS_MONTH", "SELECT count(*) AS n FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01'"),
    "q21_date_functions": (
        "SELECT CALENDAR_YEAR(o_orderdate) y, CALENDAR_QUARTER(o_orderdate) q, COUNT(o_orderkey) n FROM Order GROUP BY CALENDAR_YEAR(o_orderdate), CALENDAR_QUARTER(o_orderdate)",
        "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, count(o_orderkey) AS n FROM orders GROUP BY ALL",
    ),
    "q22_wrappers": ("SELECT toLabel(o_orderstatus) status, COUNT(o_orderkey) n FROM Order GROUP BY toLabel(o_orderstatus)", "SELECT CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Fulfilled' WHEN 'P' THEN 'Pending' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1"),
    "q23_rollup": ("SELECT o_orderstatus, o_orderpriority, COUNT(o_orderkey) n FROM Order GROUP BY ROLLUP(o_orderstatus, o_orderpriority)", "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)"),
    "q23_cube": ("SELECT l_returnflag, l_linestatus, COUNT(l_orderkey) n FROM Lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(l_orderkey) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)"),
    "q24_junction": (
        "SELECT s_suppkey FROM Supplier WHERE s_suppkey IN (SELECT l_suppkey FROM Lineitem WHERE Part.p_size = 1 AND Order.o_orderstatus = 'F')",
        "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size = 1 AND o_orderstatus = 'F')",
    ),
    "q06_typeof": (
        "SELECT event_id, TYPEOF Who WHEN Customer THEN c_name, c_mktsegment WHEN Supplier THEN s_name END FROM Event WHERE value > 90",
        f"SELECT event_id, c_name AS Who_c_name, c_mktsegment AS Who_c_mktsegment, s_name AS Who_s_name FROM events LEFT JOIN customer ON {C.WHO_TAG} = 'Customer' AND user_id = c_custkey LEFT JOIN supplier ON {C.WHO_TAG} = 'Supplier' AND user_id = s_suppkey WHERE value > 90",
    ),
}
for _name, (_soql, _sql) in SOQL.items():
    QUERIES[_name], ORACLES[_name] = soql(_soql), _sql


@query(
    "q04_child_subquery",
    """SELECT n_nationkey, s_suppkey, s_acctbal FROM nation LEFT JOIN (SELECT * FROM (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier WHERE s_acctbal > 0) WHERE n <= 3) ON n_nationkey = s_nationkey""",
)
def q04(spark, sf_dir):
    nested = soql("SELECT n_nationkey, (SELECT s_suppkey, s_acctbal FROM Suppliers WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 3) FROM Nation")(spark, sf_dir)
    return nested.select("n_nationkey", F.explode_outer("Suppliers").alias("s")).select("n_nationkey", "s.s_suppkey", "s.s_acctbal")


@query("q14_includes", "SELECT lang, source FROM (SELECT DISTINCT lang, source FROM documents) WHERE (lang = 'en' AND source = 'src1') OR lang = 'de'")
def q14(spark, sf_dir):
    from .plans.compile import Object, Records

    tags = C.read(spark, sf_dir, "documents").select("lang", "source").distinct().withColumn("tags", F.concat_ws(";", "lang", "source"))
    return Compiler(spark, Records([Object("Tag", tags, None)]), AS_OF).run("SELECT lang, source FROM Tag WHERE tags INCLUDES ('en;src1', 'de')")


@query("q17_null_aware", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation WHERE n_regionkey = 1)")
def q17_null(spark, sf_dir):
    from .plans.compile import Object, Records

    maybe = C.read(spark, sf_dir, "nation").withColumn("n_nationkey", F.nullif("n_nationkey", F.lit(3)))
    r = Records([Object("Customer", C.read(spark, sf_dir, "customer"), "c_custkey"), Object("Nation", maybe, "n_nationkey")])
    return Compiler(spark, r, AS_OF).run("SELECT c_custkey FROM Customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM Nation WHERE n_regionkey = 1)")


# --- catalog and graph (S, G, P)




@query("g02_object_field_counts", f"WITH {_OBJECTS}, {_FIELDS} SELECT o.apiName, count(f.apiName) AS fieldCount FROM objs o LEFT JOIN flds f ON f.sobjectType = o.apiName WHERE lower(o.apiName) = 'lineitem' GROUP BY 1")
def g02(spark, sf_dir):
    return graph.object_by_name(C.objects(spark), C.fields(spark), "LINEITEM").select("apiName", "fieldCount")


@query("g03_latest_fields", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def g03(spark, sf_dir):
    return merge.latest(C.read(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id").select("event_type", "event_id", "value")


@query("g04_relationships", f"WITH {_REFS} SELECT 'outgoing' AS direction, field AS fieldName, src AS sourceObject, dst AS targetObject, rel AS relationshipName FROM refs WHERE src = 'Customer' UNION SELECT 'incoming', field, src, dst, rel FROM refs WHERE dst = 'Customer'")
def g04(spark, sf_dir):
    return graph.relationships(C.field_refs(spark), "customer").drop("relationshipType")


@query("g05_edges", f"WITH {_REFS} SELECT src || '.' || field AS source, CASE kind WHEN 'MasterDetail' THEN 'MASTER_DETAIL' ELSE 'LOOKS_UP' END AS type, dst AS target FROM refs UNION ALL SELECT DISTINCT src, 'REFERENCES', dst FROM refs")
def g05(spark, sf_dir):
    r = C.field_refs(spark)
    return graph.edges(r, merge.rollup(r))


@query("g06_neighbours", f"WITH {_REFS} SELECT dst AS apiName, 'outgoing' AS direction FROM refs WHERE src = 'Supplier' UNION SELECT src, 'incoming' FROM refs WHERE dst = 'Supplier'")
def g06(spark, sf_dir):
    return graph.neighbours(merge.rollup(C.field_refs(spark)), "Supplier")


@query("g07_children", f"WITH {_REFS} SELECT DISTINCT src AS childObject, child AS relationshipName, field AS fieldApiName, kind = 'MasterDetail' AS isMasterDetail FROM refs WHERE dst = 'Order'")
def g07(spark, sf_dir):
    return graph.child_relationships(merge.rollup(C.field_refs(spark)), "Order")


@query("g08_picklist_values", "SELECT DISTINCT o_orderpriority AS value FROM orders")
def g08(spark, sf_dir):
    return graph.picklist_values(C.picklists(spark, sf_dir), "Order", "o_orderpriority").select("value")


@query("g09_objects_by_value", f"WITH {_PICKS} SELECT objectApiName, fieldApiName, value FROM picks WHERE lower(value) = 'building'")
def g09(spark, sf_dir):
    return graph.objects_by_value(C.picklists(spark, sf_dir), "Building")


@query("g10_relationship_target", f"WITH {_REFS} SELECT DISTINCT src AS sourceObject, dst AS targetObject, 0 AS rank FROM refs WHERE lower(rel) = 'order' OR lower(field) = 'order'")
def g10(spark, sf_dir):
    return graph.relationship_target(C.field_refs(spark), "Order")


@query("g14_signals", f"WITH {_OBJECTS}, {_REFS} SELECT apiName, count(DISTINCT dst) AS relationshipCount, count(DISTINCT CASE WHEN dst IN ('Order', 'Part', 'Customer') THEN dst END) AS primaryCount, count(DISTINCT CASE WHEN dst IN ('Order', 'Part', 'Customer') THEN dst END) >= 2 AS isJunction FROM objs LEFT JOIN refs ON src = apiName GROUP BY 1")
def g14(spark, sf_dir):
    return graph.signals(C.field_refs(spark), C.objects(spark).select("apiName"), ["Order", "Part", "Customer"])


@query("g15_org_summary", "SELECT o_orderstatus AS orgId, count(*) AS objectCount, max(o_orderdate) AS lastSync FROM orders GROUP BY 1")
def g15(spark, sf_dir):
    return graph.org_summary(C.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("orgId"), F.col("o_orderdate").alias("lastRefreshed")))


@query("g17_search_objects", f"WITH {_OBJECTS} SELECT apiName FROM objs WHERE lower(apiName) LIKE '%er%' OR lower(label) LIKE '%er%'")
def g17(spark, sf_dir):
    return graph.search_objects(C.objects(spark), "er").select("apiName")


_WALK = "RECURSIVE {refs}, {arcs}, w(nodes, node, hops) AS (SELECT ['{a}'], '{a}', 0 UNION ALL SELECT list_append(nodes, dst), dst, hops + 1 FROM w JOIN {via} ON node = src WHERE hops < 5 AND NOT list_contains(nodes, dst))"


@query("p01_shortest_paths", f"WITH {_WALK.format(refs=_REFS, arcs=_ROLL, a='Event', via='arcs')} SELECT array_to_string(nodes, '>') AS path, CAST(hops AS INTEGER) AS hops FROM w WHERE node = 'Region' AND hops = (SELECT min(hops) FROM w WHERE node = 'Region')")
def p01(spark, sf_dir):
    return graph.shortest_paths(graph.arcs_of(merge.rollup(C.field_refs(spark))), "Event", "Region")


@query("p02_related", f"WITH {_WALK.format(refs=_REFS, arcs=_ROLL + ', ' + _BOTH, a='Part', via='both_ways')} SELECT node AS apiName, CAST(min(hops) AS INTEGER) AS distance FROM w WHERE hops BETWEEN 1 AND 3 GROUP BY 1")
def p02(spark, sf_dir):
    return graph.related(graph.arcs_of(merge.rollup(C.field_refs(spark))), "Part", 3)


@query("p03_neighbourhood", f"WITH {_WALK.format(refs=_REFS, arcs=_ROLL + ', ' + _BOTH, a='Nation', via='both_ways')}, n AS (SELECT DISTINCT node FROM w WHERE hops <= 1) SELECT src AS sourceObject, field AS fieldName, dst AS targetObject FROM refs WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def p03(spark, sf_dir):
    r = C.field_refs(spark)
    return graph.neighbourhood_edges(r, graph.arcs_of(merge.rollup(r)), "Nation", 1)


@query("p04_detailed_paths", f"""WITH {_WALK.format(refs=_REFS, arcs=_ROLL + ', ' + _BOTH, a='Part', via='both_ways')}, s AS (SELECT nodes FROM w WHERE node = 'Region' AND hops = (SELECT min(hops) FROM w WHERE node = 'Region')),
h AS (SELECT array_to_string(nodes, '>') AS path, i AS hop, nodes[i + 1] AS a, nodes[i + 2] AS b FROM s, range(0, 10) t(i) WHERE i < len(nodes) - 1)
SELECT path, CAST(hop AS INTEGER) AS hop, a AS "from", b AS "to", CASE WHEN EXISTS (SELECT 1 FROM refs WHERE src = a AND dst = b) THEN 'up' ELSE 'down' END AS direction,
coalesce((SELECT string_agg(DISTINCT field, ',') FROM refs WHERE src = a AND dst = b), (SELECT string_agg(DISTINCT field, ',') FROM refs WHERE src = b AND dst = a)) AS fields FROM h""")
def p04(spark, sf_dir):
    return graph.consolidate(graph.detailed_paths(C.field_refs(spark), "Part", "Region"))



# --- ingest and merge (T, M)


@query("t01_names", """WITH n AS (SELECT DISTINCT CASE CAST(p_partkey % 7 AS INTEGER) WHEN 0 THEN p_brand || '__c' WHEN 1 THEN p_brand || '__Share' WHEN 2 THEN p_brand || 'History' WHEN 3 THEN 'ns__' || p_brand || '__c' WHEN 4 THEN p_brand || '__mdt' WHEN 5 THEN p_brand || '__ChangeEvent' ELSE p_brand END AS name FROM part),
d AS (SELECT name, CASE WHEN ends_with(name, '__Share') THEN 'share' WHEN ends_with(name, '__ChangeEvent') THEN 'change_event' WHEN ends_with(name, 'History') THEN 'history' END AS subtype FROM n)
SELECT name, subtype, CASE WHEN subtype IS NOT NULL THEN 'system' WHEN ends_with(name, '__c') THEN 'custom' WHEN ends_with(name, '__mdt') THEN 'metadata_type' ELSE 'standard' END AS category,
CASE WHEN len(string_split(name, '__')) >= 3 THEN string_split(name, '__')[1] END AS namespace,
CASE subtype WHEN 'share' THEN replace(name, '__Share', '__c') WHEN 'change_event' THEN replace(name, '__ChangeEvent', '__c') WHEN 'history' THEN replace(name, 'History', '') END AS parent FROM d""")
def t01(spark, sf_dir):
    b, k = F.col("p_brand"), F.col("p_partkey") % 7
    name = F.when(k == 0, F.concat(b, F.lit("__c"))).when(k == 1, F.concat(b, F.lit("__Share"))).when(k == 2, F.concat(b, F.lit("History"))).when(k == 3, F.concat(F.lit("ns__"), b, F.lit("__c"))).when(k == 4, F.concat(b, F.lit("__mdt"))).when(k == 5, F.concat(b, F.lit("__ChangeEvent"))).otherwise(b)
    n = F.col("name")
    return C.read(spark, sf_dir, "part").select(name.alias("name")).distinct().select(n, naming.subtype(n).alias("subtype"), naming.category(n).alias("category"), naming.namespace(n).alias("namespace"), naming.parent_name(n).alias("parent"))




@query("m01_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def m01(spark, sf_dir):
    o = C.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return merge.upsert(o.where("o_orderstatus != 'O'"), o.where("o_orderstatus != 'P'").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "N").otherwise(F.col("o_orderstatus"))), ["o_orderkey"])


@query("m15_upsert_stats", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS created, count(*) FILTER (WHERE o_orderstatus <> 'O') AS updated, count(*) AS total FROM orders")
def m15(spark, sf_dir):
    o = C.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return merge.upsert_stats(o.where("o_orderstatus != 'O'"), o, ["o_orderkey"])


@query("m05_rollup", f"WITH {_REFS} SELECT src AS sourceObject, dst AS targetObject, string_agg(DISTINCT field, ',') AS fields, CASE WHEN bool_or(kind = 'MasterDetail') THEN 'MASTER_DETAIL' ELSE 'LOOKS_UP' END AS relationshipType, CAST(count(DISTINCT field) AS INTEGER) AS fieldCount FROM refs GROUP BY 1, 2")
def m05(spark, sf_dir):
    return merge.rollup(C.field_refs(spark)).select("sourceObject", "targetObject", F.array_join("fields", ",").alias("fields"), "relationshipType", "fieldCount")



@query("m19_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def m19(spark, sf_dir):
    return merge.duplicate_keys(C.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("m21_global_summary", f"WITH {_REFS}, r AS (SELECT DISTINCT src, dst FROM refs), e AS (SELECT src AS apiName FROM r UNION ALL SELECT dst FROM r) SELECT apiName, count(*) AS degree, {len(C.OBJECTS)} :: BIGINT AS objectCount FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def m21(spark, sf_dir):
    return merge.global_summary(C.objects(spark), merge.rollup(C.field_refs(spark)))


@query("m17_changed_vectors", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE lang = 'de'")
def m17(spark, sf_dir):
    d = C.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stored = d.select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return merge.changed_vectors(d, stored, ["doc_id"]).select("doc_id", "hash")


# --- text and vectors (F, E)


@query("f01_levenshtein", "SELECT n1.n_name AS a, n2.n_name AS b, CAST(levenshtein(n1.n_name, n2.n_name) AS INTEGER) AS d FROM nation n1, nation n2 WHERE n1.n_nationkey < n2.n_nationkey")
def f01(spark, sf_dir):
    n = C.read(spark, sf_dir, "nation")
    b = F.broadcast(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b")))
    return n.join(b, F.col("n_nationkey") < F.col("k")).select(F.col("n_name").alias("a"), "b", F.levenshtein("n_name", "b").alias("d"))


@query("f02_closest", f"""WITH t(term) AS (VALUES ('custmer'), ('line'), ('art'), ('Regoin'), ('zzzzzzzz')), {_OBJECTS}, o AS (SELECT apiName, row_number() OVER (ORDER BY apiName) AS k FROM objs),
c AS (SELECT term, apiName, k, CASE WHEN lower(apiName) = lower(term) THEN 0 WHEN starts_with(lower(apiName), lower(term)) THEN 1 WHEN contains(lower(apiName), lower(term)) THEN 2 WHEN levenshtein(lower(apiName), lower(term)) <= 3 THEN 3 END AS tier, levenshtein(lower(apiName), lower(term)) AS d FROM t, o)
SELECT term, apiName, CAST(tier AS INTEGER) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY tier, CASE WHEN tier = 3 THEN d ELSE 0 END, k) AS n FROM c WHERE tier IS NOT NULL) WHERE n = 1""")
def f02(spark, sf_dir):
    terms = spark.createDataFrame([("custmer",), ("line",), ("art",), ("Regoin",), ("zzzzzzzz",)], "term string")
    names = spark.createDataFrame([(n, i) for i, n in enumerate(sorted(C.OBJECTS))], "apiName string, k int")
    return text.closest(terms.crossJoin(F.broadcast(names)), "apiName", F.col("term"), ["term"], "k").select("term", "apiName", "tier")


@query("f04_normalised", "SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || ' -- ' || p_brand), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS n FROM part")
def f04(spark, sf_dir):
    return C.read(spark, sf_dir, "part").select("p_partkey", text.normalised(F.concat("p_type", F.lit(" -- "), "p_brand")).alias("n"))


@query("f08_lexical_score", f"""WITH {_FIELDS}, t(term) AS (VALUES ('price'), ('order'), ('c_name'), ('ab'))
SELECT sobjectType, apiName, CAST(sum(CASE WHEN length(term) < 3 THEN 0 WHEN lower(apiName) = term THEN 10 WHEN contains(lower(apiName), term) THEN 5 ELSE 0 END) + max(CASE WHEN type = 'reference' THEN 1 ELSE 0 END) AS INTEGER) AS score FROM flds, t GROUP BY 1, 2""")
def f08(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in ("price", "order", "c_name", "ab")])
    return C.fields(spark).select("sobjectType", "apiName", text.lexical_score(F.col("apiName"), F.col("label"), F.lit(None).cast("string"), F.col("type"), terms).alias("score"))



@query("f10_jaccard", """WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS a FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '')) AS b FROM benchmark WHERE item_id % 50 = 0)
SELECT item_id, doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS j FROM w, b""")
def f10(spark, sf_dir):
    # each side's words are split once: the queries' before they are broadcast, a document's before it meets them
    asked = bounded(C.read(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", text.word_set(F.col("text")).alias("b")))
    docs = C.read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(text.word_set(F.col("text")))).alias("a"))
    return docs.crossJoin(asked).select("item_id", "doc_id", F.round(text.set_jaccard(F.col("a"), F.col("b")), 6).alias("j"))


@query("f12_content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def f12(spark, sf_dir):
    return C.read(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("f13_embedding_text", f"WITH {_FIELDS} SELECT sobjectType, apiName, apiName || '. on ' || sobjectType || '. Type: ' || type AS t FROM flds")
def f13(spark, sf_dir):
    none = F.lit(None).cast("string")
    return C.fields(spark).select("sobjectType", "apiName", text.embedding_text(F.col("apiName"), F.col("label"), F.col("sobjectType"), F.col("type"), none, F.lit(""), F.array().cast("array<string>")).alias("t"))


@query("f14_log_score", "SELECT o_custkey, round(least(1, ln(1 + count(*)) / ln(51)), 6) AS s FROM orders GROUP BY 1")
def f14(spark, sf_dir):
    return C.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(text.log_score(F.count("*")), 6).alias("s"))


_COS = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / sqrt(list_sum(list_transform(v.embedding, lambda z: CAST(z AS DOUBLE) ** 2))) / sqrt(list_sum(list_transform(q.embedding, lambda z: CAST(z AS DOUBLE) ** 2)))"


def _query_vectors(spark, sf_dir):
    """Every vector whose id is divisible by 50 is a query."""
    v = C.read(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query("e01_cosine", f"SELECT q.vec_id AS query, v.vec_id, round({_COS}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0")
def e01(spark, sf_dir):
    v, q = _query_vectors(spark, sf_dir)
    return search.pair_scores(v, q.withColumnRenamed("q", "embedding"), "vec_id")


@query("e02_batch_similarity", f"SELECT q.vec_id AS query, v.vec_id, CASE WHEN v.label = 3 THEN 0 ELSE round({_COS}, 6) END AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0")
def e02(spark, sf_dir):
    v, q = _query_vectors(spark, sf_dir)
    # rows of label 3 are candidates without a vector
    known = v.select("vec_id", F.when(F.coalesce(F.col("label") != 3, F.lit(True)), F.col("embedding")).alias("embedding"))
    return search.pair_scores(known, q.withColumnRenamed("q", "embedding"), "vec_id", none=0.0)


@query("e03_top_k", f"SELECT query, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, round({_COS}, 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, v.vec_id) AS n FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 AND v.label <> 3) WHERE n <= 10")
def e03(spark, sf_dir):
    v, q = _query_vectors(spark, sf_dir)
    return search.top_k_each(v.where("label != 3"), q.withColumnRenamed("q", "embedding"), 10, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("e06_scoped_top", f"SELECT query, label, vec_id FROM (SELECT q.vec_id AS query, v.label, v.vec_id, row_number() OVER (PARTITION BY q.vec_id, v.label ORDER BY {_COS} DESC, v.vec_id) AS n, {_COS} AS s FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE n <= 5 AND s >= 0.1")
def e06(spark, sf_dir):
    v, q = _query_vectors(spark, sf_dir)
    return search.scoped_top_each(v, q.withColumnRenamed("q", "embedding"), 5, "vec_id", "label", least=0.1).select("query", "label", "vec_id")


@query("e08_hybrid", f"""WITH {_OBJECTS}, {_REFS}, s AS (SELECT apiName, count(DISTINCT dst) AS n, count(DISTINCT CASE WHEN dst IN ('Order', 'Part', 'Customer') THEN dst END) >= 2 AS j FROM objs LEFT JOIN refs ON src = apiName GROUP BY 1),
w AS (SELECT apiName, list_distinct(list_filter(regexp_split_to_array(lower(apiName || ' ' || label), '[^a-z0-9_]+'), lambda x: x <> '')) AS a, ['customer', 'order', 'line'] AS b FROM objs)
SELECT s.apiName, round(0.6 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.4 * least(1, ln(1 + n) / ln(51)) + CASE WHEN j THEN 0.15 ELSE 0 END, 6) AS total FROM s JOIN w ON s.apiName = w.apiName""")
def e08(spark, sf_dir):
    o = C.objects(spark)
    s = graph.signals(C.field_refs(spark), o.select("apiName"), ["Order", "Part", "Customer"])
    return search.hybrid(s, search.lexical_semantic(o, "customer order line")).select("apiName", F.round("total", 6).alias("total"))



# --- rules (C, N, L)


@query("c03_field_categories", f"""WITH {_FIELDS}, r(t, k, c, p) AS (VALUES ('date', 'T', 'temporal', 0.95), ('datetime', 'T', 'temporal', 0.95), ('status', 'N', 'lifecycle', 0.9), ('price', 'N', 'financial', 0.85), ('amount', 'N', 'financial', 0.9))
SELECT sobjectType, apiName, c AS category, CAST(max(p) AS DOUBLE) AS confidence FROM flds JOIN r ON (k = 'T' AND type = t) OR (k = 'N' AND contains(lower(apiName), t)) GROUP BY 1, 2, 3""")
def c03(spark, sf_dir):
    return tagging.tag_fields(C.fields(spark), tagging.rules(spark, tagging.FIELD_RULES)).select("sobjectType", "apiName", "category", "confidence")



@query("c06_intent", """WITH k AS (SELECT conv_id, turn, lower(text) AS t FROM conversations), s AS (SELECT conv_id, turn,
len(list_filter(['customer', 'client', 'sale', 'deal', 'opportunity', 'lead', 'contact', 'account', 'revenue', 'pipeline', 'forecast', 'quota'], lambda x: contains(t, x))) AS b,
len(list_filter(['debug', 'log', 'error', 'trace', 'monitor', 'audit', 'system', 'admin', 'setup', 'metadata'], lambda x: contains(t, x))) AS y FROM k)
SELECT conv_id, turn, CASE WHEN b > y THEN 'business' WHEN y > b THEN 'system' ELSE 'unknown' END AS intent FROM s""")
def c06(spark, sf_dir):
    return C.read(spark, sf_dir, "conversations").select("conv_id", "turn", tagging.intent(F.col("text")).alias("intent"))


_TERMS = ["2024-01-15", "TODAY", "last month", "$1,500.00", "2.5m", "a@b.com", "(555) 123-4567", "https://x.org", "High", "in progress", "001A0000002bCdE", "nonsense"]


@query("n01_value_patterns", f"""WITH t(term) AS (VALUES {_sql_rows([(t,) for t in _TERMS])}) SELECT term, CASE WHEN regexp_matches(term, '^[a-zA-Z0-9]{{15}}([a-zA-Z0-9]{{3}})?$') AND regexp_matches(term, '[0-9]') THEN 'salesforce_id'
WHEN upper(term) = 'TODAY' OR lower(term) = 'last month' THEN 'date_literal' WHEN regexp_matches(term, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date_value' WHEN regexp_matches(term, '^[$]?[0-9,]+([.][0-9]{{2}})?$') THEN 'currency_value'
WHEN regexp_matches(term, '^[0-9]+([.][0-9]+)?\\s*[kKmMbB]?$') THEN 'numeric_value' WHEN regexp_matches(term, '^[^\\s@]+@[^\\s@]+[.][^\\s@]+$') THEN 'email_address' WHEN regexp_matches(term, '^[0-9\\s()+.-]{{7,}}$') THEN 'phone_number'
WHEN regexp_matches(term, '^https?://.+') THEN 'url' WHEN lower(term) = 'high' THEN 'priority_value' WHEN lower(term) = 'in progress' THEN 'status_value' END AS kind FROM t""")
def n01(spark, sf_dir):
    t = spark.createDataFrame([(t,) for t in _TERMS], "term string")
    return t.select("term", values.pattern(F.col("term"))["kind"].alias("kind"))


@query("n03_picklist_grounding", f"""WITH {_PICKS}, t(term) AS (VALUES ('build'), ('HIGH'), ('purchase')), c AS (SELECT term, objectApiName || '.' || fieldApiName || ' = ''' || value || '''' AS filter,
CASE WHEN lower(value) = lower(term) THEN 1.0 WHEN starts_with(lower(value), lower(term)) THEN 0.9 ELSE 0.7 END AS confidence FROM t JOIN picks ON contains(lower(value), lower(term))) SELECT term, CAST(confidence AS DOUBLE) AS confidence, filter FROM c""")
def n03(spark, sf_dir):
    t = spark.createDataFrame([("build",), ("HIGH",), ("purchase",)], "term string")
    return grounding.by_picklist(t, C.picklists(spark, sf_dir)).select("term", "confidence", "filter")





# --- context, comparison, evaluation, samples (X, K, R, W, B)


@query("x02_important_fields", f"""WITH {_FIELDS}, s AS (SELECT sobjectType, apiName, CASE WHEN contains(lower(apiName), 'price') THEN 5 ELSE 0 END + CASE WHEN type = 'reference' THEN 1 ELSE 0 END AS score FROM flds)
SELECT sobjectType, apiName, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sobjectType ORDER BY score DESC, apiName) AS n FROM s) WHERE n <= 3""")
def x02(spark, sf_dir):
    return context.important_fields(C.fields(spark), F.array(F.lit("price")), cap=3).select("sobjectType", "apiName", "rank")



@query("x04_polymorphic", "SELECT 'Event' AS sobjectType, 'user_id' AS apiName, 'Who' AS relationshipName, 'Customer,Supplier' AS targets")
def x04(spark, sf_dir):
    return context.polymorphic(C.fields(spark))


def _other_org(spark) -> tuple[DataFrame, DataFrame]:
    o = C.objects(spark, "b").where("apiName != 'Label'").unionByName(spark.createDataFrame([("Extra", "b", "Extra", "standard", False)], C.objects(spark).schema)).withColumn("label", F.when(F.col("apiName") == "Part", "Product").otherwise(F.col("label")))
    f = C.fields(spark, "b").where("sobjectType != 'Label' and apiName != 'p_size'").withColumn("type", F.when(F.col("apiName") == "c_acctbal", "double").otherwise(F.col("type")))
    return o, f


@query("k01_compare_fields", f"WITH {_FIELDS} SELECT sobjectType, apiName, CASE apiName WHEN 'p_size' THEN 'only_in_source' ELSE 'type_mismatch' END AS difference FROM flds WHERE apiName IN ('p_size', 'c_acctbal')")
def k01(spark, sf_dir):
    return compare.compare_fields(C.fields(spark), _other_org(spark)[1]).select("sobjectType", "apiName", "difference")


@query("k02_compare_objects", f"WITH {_OBJECTS} SELECT apiName, CASE apiName WHEN 'Label' THEN 'only_in_source' ELSE 'both' END AS status FROM objs UNION ALL SELECT 'Extra', 'only_in_target'")
def k02(spark, sf_dir):
    return compare.compare_objects(C.objects(spark), _other_org(spark)[0])


@query("k03_drift", "SELECT * FROM (VALUES ('Part', false, false), ('Label', true, false), ('Extra', false, true)) t(apiName, onlyInSource, onlyInTarget)")
def k03(spark, sf_dir):
    o, f = _other_org(spark)
    return compare.drift(C.objects(spark), C.fields(spark), o, f).select("apiName", "onlyInSource", "onlyInTarget")


@query("r02_summary", """SELECT quality, toxic, count(*) AS total, count(*) FILTER (WHERE s > 0.5) AS successful, round(avg(s), 6) AS mean FROM (SELECT quality, toxic, (quality + (1 - toxic)) / 2.0 AS s FROM labels) GROUP BY GROUPING SETS ((quality), (toxic), ())""")
def r02(spark, sf_dir):
    x = C.read(spark, sf_dir, "labels").withColumn("overall", (F.col("quality") + (1 - F.col("toxic"))) / 2)
    return compare.summary(x, ["quality", "toxic"]).withColumn("mean", F.round("mean", 6))


@query("r03_component_rates", "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def r03(spark, sf_dir):
    return compare.component_rates(C.read(spark, sf_dir, "labels"), ["quality", "toxic"]).select(F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))



@query("b01_field_listing", f"WITH {_FIELDS} SELECT sobjectType, type AS grp, apiName FROM flds WHERE contains(lower(apiName), 'key')")
def b01(spark, sf_dir):
    return compare.field_listing(C.fields(spark), "type", "key")


# --- windows over events


@query("st1_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st1(spark, sf_dir):
    return sync.tumbling(C.read(spark, sf_dir, "events"))


@query("st2_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st2(spark, sf_dir):
    return sync.sessions(C.read(spark, sf_dir, "events"))
