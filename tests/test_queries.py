"""Every query with SQL against DuckDB on the smallest tables; a few operators on small fixtures."""

import numbers

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from schemascope import more_queries, queries, rule_queries  # noqa: F401
from schemascope.functions import naming, text, values
from schemascope.operators import compare, context, graph, ingest, merge, questions, tagging
from schemascope.sources import catalog as C
from schemascope.streaming import sync

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if not isinstance(v, (list, dict)) and pd.isna(v):
            return "null"
        if str(v) in ("True", "False") or not isinstance(v, numbers.Number):
            return str(v)
        return str(round(float(v), 6))

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.toPandas()) == rows(want)
    else:
        assert got.count() > 0


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() > 0


def test_names(spark):
    cases = {
        "Account": ("standard", None, None, None), "Thing__c": ("custom", None, None, None), "ns__Thing__c": ("custom", None, "ns", None), "Thing__x": ("external", None, None, None), "Conf__mdt": ("metadata_type", None, None, None), "Ping__e": ("platform_event", None, None, None),
        "AccountShare": ("system", "share", None, "Account"), "Thing__Share": ("system", "share", None, "Thing__c"), "ns__Thing__History": ("system", "history", "ns", "ns__Thing__c"), "AccountChangeEvent": ("system", "change_event", None, "Account"), "Feed": ("standard", None, None, None),
    }
    n = F.col("n")
    got = spark.createDataFrame([(k,) for k in cases], "n string").select(n, naming.category(n), naming.subtype(n), naming.namespace(n), naming.parent_name(n)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == cases


def describe_rows(spark):
    pick = [{"value": "a", "label": "A", "active": True}, {"value": "a", "label": "again"}, {"value": "b"}]
    fields = [
        {"name": "Name", "label": "Name", "type": "string"}, {"name": "ParentId", "type": "reference", "referenceTo": ["Acct"], "relationshipName": "Parent"},
        {"name": "Who__c", "type": "reference", "referenceTo": ["Contact", "Lead"]}, {"name": "Kind__c", "type": "picklist", "picklistValues": pick, "controllerName": "Name"}, {"name": "Own__c", "type": "reference", "referenceTo": ["Deal"], "cascadeDelete": True},
    ]
    return spark.createDataFrame([("Acct", {"name": "Acct", "label": "Account", "fields": fields}), ("AcctShare", {"name": "AcctShare", "fields": []})], C.DESCRIBE.fields[0].name + " string, describe " + C.DESCRIBE["describe"].dataType.simpleString())


def test_ingest(spark):
    d = describe_rows(spark)
    assert {(r.apiName, r.category, r.parentObjectName) for r in ingest.object_rows(d, "o").collect()} == {("Acct", "standard", None), ("AcctShare", "system", "Acct")}
    f = {r.apiName: r for r in ingest.field_rows(d, "o").collect()}
    assert f["Name"].filterable and not f["Name"].calculated and f["Name"].referenceTo is None
    assert [f[x].relationshipType for x in ("ParentId", "Who__c", "Own__c")] == ["Hierarchical", "Lookup", "MasterDetail"]
    assert {(r.fieldName, r.targetObject) for r in ingest.reference_rows(d, "o").collect()} == {("ParentId", "Acct"), ("Who__c", "Contact"), ("Who__c", "Lead"), ("Own__c", "Deal")}
    assert {(r.value, r.label) for r in ingest.picklist_rows(d, "o").collect()} == {("a", "A"), ("b", "b")}
    assert [(r.sourceField, r.controllerField) for r in ingest.dependency_rows(d, "o").collect()] == [("Kind__c", "Name")]
    empty = d.limit(0)
    assert ingest.field_rows(empty, "o").count() == 0


def test_soft_delete_keeps_the_first_time(spark):
    t = spark.createDataFrame([("a", False, None), ("b", True, "2020-01-01"), ("c", False, None)], "apiName string, deleted boolean, deletedAt string")
    got = {r.apiName: (r.deleted, r.deletedAt) for r in merge.soft_delete(t, t.where("apiName = 'a'"), ["apiName"], F.lit("now")).collect()}
    assert got == {"a": (False, None), "b": (True, "2020-01-01"), "c": (True, "now")}


def test_paths_of_a_cycle(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "x"), ("x", "c")], "src string, dst string")
    assert [r.path for r in graph.shortest_paths(arcs, "a", "d").collect()] == ["a>b>c>d", "a>x>c>d"]
    assert graph.shortest_paths(arcs, "d", "a").count() == 0
    assert [tuple(r) for r in graph.related(arcs, "d", 2).collect()] == [("c", 1), ("a", 2), ("b", 2), ("x", 2)]
    assert graph.path_tree([["a", "b"], ["a", "c", "a"]]) == "a\n  -> b\n  -> c\n    -> a [cycle]"


def test_value_patterns(spark):
    want = {"12": ("currency_value", "12"), "1.25m": ("numeric_value", "1250000"), "$1,234.50": ("currency_value", "1234.5"), "abcdefghijklmno": None, "5551234567": ("currency_value", "5551234567"), " high ": ("priority_value", "High"), "": None, "A@B.co": ("email_address", "a@b.co")}
    got = spark.createDataFrame([(k,) for k in want], "v string").select("v", values.pattern(F.col("v")).alias("p")).collect()
    assert {r.v: (r.p.kind, r.p.normalised) if r.p else None for r in got} == want


def test_conditions(spark):
    qs = [(1, "not active accounts", "Account"), (2, "deals worth over 50k", "Opportunity"), (3, "created in the last 3 months", "Case"), (4, "accounts based in New York", "Account")]
    got = questions.conditions(spark.createDataFrame(qs, "id int, question string, object string")).collect()
    by = {(r.id, r.field, r.operator, r.value, r.valueType) for r in got}
    assert (1, "IsActive", "=", "false", "boolean") in by and (1, "IsActive", "=", "true", "boolean") not in by
    assert (2, "Amount", ">", "50000", "number") in by and (3, "CreatedDate", ">=", "LAST_N_MONTHS:3", "date") in by and (4, "BillingState", "=", "New York", "string") in by


def test_intents_and_entities(spark):
    q = F.col("q")
    df = spark.createDataFrame([("contacts with their account name",), ("accounts with their opportunities",), ("High value Acme deals for Globex accounts in Thing__c",)], "q string")
    got = [[(x.kind, x.source, x.target) for x in r[0]] for r in df.select(questions.relationship_intents(q)).collect()]
    assert ("parent_lookup", "Contacts", "Account") in got[0] and ("child_subquery", "Accounts", "Opportunities") in got[1]
    entities, found = df.select(*questions.potential_entities(q)).collect()[2]
    assert "Thing__c" in entities and {"High", "Acme", "Globex"} <= set(found)


def test_categories(spark):
    got = {(r.apiName, r.category) for r in queries.QUERIES["c02_object_categories"](spark, SF).where("rank = 1").collect()}
    assert {("Account", "business_core"), ("Invoice__c", "business_extended"), ("Setting__mdt", "custom_metadata"), ("pkg__Thing__c", "managed_package"), ("Profile", "system")} <= got
    bad = tagging.anti_patterns(spark.createDataFrame([("A", "system"), ("B", "platform_event"), ("C", "business_core")], "apiName string, category string"), F.lit("customer revenue"))
    assert {(r.apiName, r.severity) for r in bad.collect()} == {("A", "warning"), ("B", "error")}


def test_fuzzy_cache():
    now = [0.0]
    c = context.FuzzyCache(lambda: now[0], most=2)
    c.put("o", "big deals in march", 1)
    assert c.get("o", "show the big deals in march") == 1 and c.get("p", "big deals in march") is None
    now[0] = 301
    assert c.get("o", "big deals in march") is None


def test_case_scores(spark):
    x = spark.createDataFrame([("A", "a", ["x", "y"], ["X", "z"], True), ("A", "b", ["x"], [], False)], "expectedObject string, object string, expectedFields array<string>, fields array<string>, ok boolean")
    got = compare.case_scores(x).collect()
    assert round(got[0].overall, 4) == round((1 + 0.5 + 1) / 3, 4) and got[1].overall == 0


def test_lexical(spark):
    got = spark.sql("SELECT 'a' AS x").select(text.lexical_score(F.lit("Amount"), F.lit("Total Amount"), F.lit("the deal size"), F.lit("reference"), F.array(F.lit("amount"), F.lit("total"), F.lit("deal"), F.lit("xx")))).first()[0]
    assert got == 10 + 5 + 2 + 1


def test_streamed_sync(spark, tmp_path):
    state = {"now": spark.createDataFrame([("a", 1, 0)], "k string, v int, at int")}
    spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 9, 1)], "k string, v int, at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v int, at int").parquet(str(tmp_path / "in"))

    def swap(df, batch):
        df.write.mode("overwrite").parquet(str(tmp_path / f"snap{batch}"))
        state["now"] = spark.read.parquet(str(tmp_path / f"snap{batch}"))

    sync.sync(stream, lambda: state["now"], swap, ["k"], str(tmp_path / "cp"), "at").awaitTermination()
    assert {(r.k, r.v) for r in state["now"].collect()} == {("a", 3), ("b", 9)}


def test_described_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"objectName": "A", "describe": {"name": "A", "childRelationships": [{"childSObject": "B", "field": "A__c", "relationshipName": "Bs"}, {"childSObject": "C", "field": "x"}]}}\nnot json\n')
    good, bad = C.read_describes(spark, str(tmp_path / "d.json"))
    good.cache()
    assert good.count() == 1
    assert [(r.childObject, r.relationshipName) for r in C.child_relationships(good).collect()] == [("B", "Bs")]
