"""Further queries over the supplied tables, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text, values
from .operators import compare, context, graph, grounding, merge, questions, search, tagging
from .queries import _FIELDS, _OBJECTS, _PICKS, _REFS, query
from .sources import catalog as C


@query("s01_object_listing", f"WITH {_OBJECTS} SELECT apiName FROM objs WHERE lower(apiName) IN ('customer', 'order')")
def s01(spark, sf_dir):
    listing = C.objects(spark).select(F.col("apiName").alias("name"), "label", F.lit(True).alias("queryable"))
    return C.list_objects(listing, ["CUSTOMER", "order"], ["standard"]).select(F.col("name").alias("apiName"))


@query("s14_org_listing", "SELECT r_name AS orgId, r_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3) AS syncedToGraph FROM region")
def s14(spark, sf_dir):
    n = C.read(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_regionkey").alias("orgId"))
    r = C.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("orgId"), "r_name")
    return C.orgs(r, n).select(F.col("r_name").alias("orgId"), "syncedToGraph")


@query("g01_all_objects", f"WITH {_OBJECTS} SELECT apiName, label, 'standard' AS category FROM objs")
def g01(spark, sf_dir):
    return graph.all_objects(C.objects(spark))



@query("p08_node_list", f"WITH {_REFS} SELECT lower(dst) AS id, min(CASE src WHEN 'Lineitem' THEN 1 ELSE 2 END) :: INTEGER AS depth FROM refs GROUP BY 1")
def p08(spark, sf_dir):
    r = C.field_refs(spark)
    nodes = r.select(F.col("targetObject").alias("apiName"), F.when(F.col("sourceObject") == "Lineitem", 1).otherwise(2).alias("depth"))
    return graph.node_list(nodes, r)[0].select("id", "depth")


@query("m04_stub_targets", f"WITH {_REFS}, {_OBJECTS} SELECT apiName FROM objs WHERE apiName <> 'Nation' UNION SELECT dst FROM refs")
def m04(spark, sf_dir):
    return merge.with_stubs(C.objects(spark).where("apiName != 'Nation'"), C.field_refs(spark)).select("apiName")


@query("m07_replace_picklists", f"WITH {_PICKS} SELECT objectApiName, fieldApiName, value FROM picks WHERE objectApiName <> 'Event'")
def m07(spark, sf_dir):
    p = C.picklists(spark, sf_dir)
    old = p.withColumn("value", F.concat("value", F.lit(" old")))
    return merge.replace_picklists(old, p, C.fields(spark).where("sobjectType != 'Event'")).select("objectApiName", "fieldApiName", "value")


@query("m09_enrich_picklists", f"WITH {_PICKS} SELECT objectApiName, value, CASE WHEN fieldApiName = 'o_orderstatus' AND value = 'F' THEN true END AS closed FROM picks")
def m09(spark, sf_dir):
    status = spark.createDataFrame([("Order", "o_orderstatus", "F", True)], "objectApiName string, fieldApiName string, value string, closed boolean")
    return merge.enrich_picklists(C.picklists(spark, sf_dir), status).select("objectApiName", "value", "closed")


@query("m12_clear_org", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'")
def m12(spark, sf_dir):
    c = C.read(spark, sf_dir, "customer").withColumn("orgId", F.col("c_mktsegment"))
    return merge.clear_org(c, "BUILDING").select("c_custkey")


@query("f05_variants", f"WITH {_OBJECTS} SELECT apiName, lower(apiName) || 's' AS plural FROM objs")
def f05(spark, sf_dir):
    return C.objects(spark).select("apiName", F.element_at(text.variants(F.col("apiName")), -1).alias("plural"))


@query("f07_tokens", "SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')) AS INTEGER) AS n FROM conversations")
def f07(spark, sf_dir):
    return C.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.tokens(F.col("text"))).alias("n"))


@query("f09_ranked_fields", f"WITH {_FIELDS} SELECT sobjectType, apiName FROM (SELECT *, CASE WHEN contains(lower(apiName), 'key') THEN 5 ELSE 0 END + CASE WHEN type = 'reference' THEN 1 ELSE 0 END AS s FROM flds) WHERE s > 0 ORDER BY s DESC, ordinal LIMIT 6")
def f09(spark, sf_dir):
    return context.ranked_fields(C.fields(spark), F.array(F.lit("key")), 6).select("sobjectType", "apiName")


@query("f15_search_terms", "SELECT p_partkey, trim(regexp_replace(replace(replace(replace(p_brand || ' AND (' || p_size || ')', '(', ''), ')', ''), 'AND', ''), '\\s+', ' ', 'g')) AS term FROM part")
def f15(spark, sf_dir):
    return C.read(spark, sf_dir, "part").select("p_partkey", text.search_term(F.concat("p_brand", F.lit(" AND ("), F.col("p_size").cast("string"), F.lit(")"))).alias("term"))


@query("f17_name_search", "SELECT * FROM (SELECT 'Nation' AS object, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY lower(n_name) = 'nation_1' DESC, n_name LIMIT 3) UNION ALL SELECT * FROM (SELECT 'Region', r_name FROM region WHERE contains(lower(r_name), 'nation_1') LIMIT 3)")
def f17(spark, sf_dir):
    return grounding.name_search({"Nation": (C.read(spark, sf_dir, "nation"), "n_name"), "Region": (C.read(spark, sf_dir, "region"), "r_name")}, "NATION_1", 3).select("object", "name")


@query("f18_draft_columns", f"WITH {_FIELDS} SELECT sobjectType, apiName FROM flds WHERE sobjectType = 'Customer' AND apiName IN ('c_name', 'c_acctbal')")
def f18(spark, sf_dir):
    draft = F.lit("SELECT C_NAME, Nation.c_acctbal FROM Customer WHERE c_name = 'c_mktsegment'")
    known = C.fields(spark).where("sobjectType = 'Customer'").groupBy("sobjectType").agg(F.sort_array(F.collect_list("apiName")).alias("k"))
    return known.select("sobjectType", F.explode(text.draft_columns(draft, F.col("k"))).alias("apiName"))




@query("e12_exact_index", f"WITH {_OBJECTS}, o AS (SELECT *, row_number() OVER (ORDER BY apiName) AS k FROM objs), n AS (SELECT lower(label) AS name, apiName, k FROM o UNION ALL SELECT lower(apiName), apiName, k FROM o) SELECT name, arg_min(apiName, k) AS apiName FROM n GROUP BY 1")
def e12(spark, sf_dir):
    o = spark.createDataFrame([(n, C.OBJECTS[n][2], i) for i, n in enumerate(sorted(C.OBJECTS))], "apiName string, label string, k int")
    return search.exact_index(o, "apiName", "k")


@query("c07_anti_patterns", "SELECT * FROM (VALUES ('A', 'system_object_query', 'warning'), ('B', 'category_mismatch', 'error'), ('D', 'metadata_type_data_query', 'error')) t(apiName, warning, severity)")
def c07(spark, sf_dir):
    o = spark.createDataFrame([("A", "system"), ("B", "platform_event"), ("C", "business_core"), ("D", "custom_metadata")], "apiName string, category string")
    return tagging.anti_patterns(o, F.lit("customer revenue")).select("apiName", "warning", "severity")




@query("n04_object_grounding", f"WITH {_OBJECTS}, t(term) AS (VALUES ('order'), ('cust'), ('item')) SELECT term, CAST(CASE WHEN lower(apiName) = term THEN 0.95 WHEN starts_with(lower(apiName), term) THEN 0.85 ELSE 0.7 END AS DOUBLE) AS confidence, 'FROM ' || apiName AS filter FROM t JOIN objs ON contains(lower(apiName), term)")
def n04(spark, sf_dir):
    t = spark.createDataFrame([("order",), ("cust",), ("item",)], "term string")
    return grounding.by_object(t, C.objects(spark)).select("term", "confidence", "filter")


@query("n06_category_weights", "SELECT category, CAST(w AS DOUBLE) AS w FROM (VALUES ('business_core', 1.0), ('business_extended', 0.9), ('system', 0.3), ('system_derived', 0.3), ('managed_package', 0.7), ('custom_metadata', 0.4), ('platform_event', 0.2), ('external_object', 0.6), ('big_object', 0.6), ('other', 0.8)) t(category, w)")
def n06(spark, sf_dir):
    c = spark.createDataFrame([(k,) for k in (*values.CATEGORY_WEIGHTS, "other")], "category string")
    return c.select("category", values.category_weight(F.col("category")).alias("w"))



@query("l04_value_types", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'number' WHEN 'O' THEN 'boolean' ELSE 'date' END AS t FROM orders")
def l04(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("string")).when(F.col("o_orderstatus") == "O", F.lit("TRUE")).otherwise(F.lit("LAST_N_DAYS:3"))
    return C.read(spark, sf_dir, "orders").select("o_orderkey", values.value_type(v).alias("t"))




@query("x01_matching_objects", f"WITH {_OBJECTS}, {_PICKS}, f AS (SELECT apiName, 'token' AS s FROM objs WHERE contains(lower(apiName), 'er') UNION SELECT objectApiName, 'picklist' FROM picks WHERE value = 'BUILDING') SELECT apiName, string_agg(s, ',' ORDER BY s) AS sources FROM f GROUP BY 1")
def x01(spark, sf_dir):
    hits = graph.objects_by_value(C.picklists(spark, sf_dir), "building").select(F.col("objectApiName").alias("apiName"))
    return context.without_system(context.matching_objects(token=graph.search_objects(C.objects(spark), "er"), picklist=hits), C.objects(spark))


@query("x09_merged_fields", f"WITH {_FIELDS}, p AS (SELECT sobjectType, apiName, ordinal, 0 AS k FROM flds WHERE type = 'reference' UNION ALL SELECT sobjectType, apiName, ordinal, 1 FROM flds), o AS (SELECT sobjectType, apiName, min(k) AS k, min(ordinal) AS ordinal FROM p GROUP BY 1, 2) SELECT sobjectType, apiName, CASE k WHEN 0 THEN 'core' ELSE 'fill' END AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY sobjectType ORDER BY k, ordinal) AS n FROM o) WHERE n <= 4")
def x09(spark, sf_dir):
    f = C.fields(spark)
    return context.merge_strategies([("core", f.where("type = 'reference'")), ("fill", f)], 4).select("sobjectType", "apiName", "strategy")


@query("x11_ensemble", "SELECT 'a,b,c' AS tables, 'x,y' AS columns")
def x11(spark, sf_dir):
    return context.ensemble(spark.createDataFrame([(True, ["a", "b"], ["x"]), (False, ["z"], ["z"]), (True, ["c", "b"], ["y"])], "ok boolean, tables array<string>, columns array<string>"))


@query("k04_org_flags", "SELECT bool_or(c_mktsegment = 'BUILDING') AS sourceHasData, bool_or(c_mktsegment = 'none') AS targetHasData FROM customer")
def k04(spark, sf_dir):
    return compare.org_flags(C.read(spark, sf_dir, "customer").withColumn("orgId", F.col("c_mktsegment")), "BUILDING", "none")


@query("r01_case_scores", "SELECT doc_id, round((quality + CASE WHEN toxic = 1 THEN 0.5 ELSE 1 END + 1) / 3, 6) AS overall FROM labels")
def r01(spark, sf_dir):
    want = F.array(F.lit("a"), F.lit("b"))
    x = C.read(spark, sf_dir, "labels").select("doc_id", F.lit("A").alias("expectedObject"), F.when(F.col("quality") == 1, "a").otherwise("b").alias("object"), want.alias("expectedFields"), F.when(F.col("toxic") == 1, F.array(F.lit("A"), F.lit("x"))).otherwise(want).alias("fields"), F.lit(True).alias("ok"))
    return compare.case_scores(x).select("doc_id", F.round("overall", 6).alias("overall"))


@query("b03_filter_hints", f"WITH {_REFS}, {_PICKS} SELECT rel || '.Name LIKE ''...''' AS hint FROM refs WHERE src = 'Order' UNION SELECT fieldApiName || ' = ''' || min(value) || '''' FROM picks WHERE objectApiName = 'Order' GROUP BY fieldApiName")
def b03(spark, sf_dir):
    return compare.filter_hints(C.field_refs(spark), C.picklists(spark, sf_dir), "Order")
