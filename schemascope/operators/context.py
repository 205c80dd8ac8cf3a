"""Choosing what of the catalog a question needs."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cache_jaccard, lexical_score

ALWAYS = ["Id", "Name", "OwnerId", "CreatedDate", "LastModifiedDate"]


def matching_objects(**sources: DataFrame) -> DataFrame:
    """apiName and the sources that found it, e.g. vector=..., token=..., entity=..., picklist=...."""
    out = None
    for name, df in sources.items():
        part = df.select("apiName", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("apiName").agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def without_system(found: DataFrame, objects: DataFrame) -> DataFrame:
    return found.join(objects.where(F.col("category").isin("system", "metadata_type", "platform_event", "external")).select("apiName"), "apiName", "left_anti")


def important_fields(fields: DataFrame, terms: Column, cap: int = 25, always: list[str] = ALWAYS) -> DataFrame:
    """Fields of each object: those always there, then by lexical score and name, ``cap`` at most."""
    description = F.col("description") if "description" in fields.columns else F.lit(None).cast("string")
    x = fields.withColumn("score", lexical_score(F.col("apiName"), F.col("label"), description, F.col("type"), terms)).withColumn("must", F.col("apiName").isin(*always))
    w = Window.partitionBy("sobjectType").orderBy(F.desc("must"), F.desc("score"), "apiName")
    return x.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= cap)


def ranked_fields(fields: DataFrame, terms: Column, top: int, ordinal: str = "ordinal") -> DataFrame:
    """Fields with a score, best first, first on ties."""
    x = fields.withColumn("score", lexical_score(F.col("apiName"), F.col("label"), F.lit(None).cast("string"), F.col("type"), terms)).where("score > 0")
    return x.orderBy(F.desc("score"), ordinal).limit(top)


def object_schema(objects: DataFrame, fields: DataFrame, refs: DataFrame, values: DataFrame, most_values: int = 50) -> DataFrame:
    """apiName, fields, parents, children, values as sorted lists of text."""
    f = fields.groupBy(F.col("sobjectType").alias("apiName")).agg(F.sort_array(F.collect_list(F.concat_ws(":", F.col("apiName"), F.col("type")))).alias("fields"))
    p = refs.groupBy(F.col("sourceObject").alias("apiName")).agg(F.sort_array(F.collect_set(F.concat_ws("->", "relationshipName", "targetObject"))).alias("parents"))
    c = refs.groupBy(F.col("targetObject").alias("apiName")).agg(F.sort_array(F.collect_set(F.concat_ws("<-", "childName", "sourceObject"))).alias("children"))
    v = values.where("isActive").groupBy(F.col("objectApiName").alias("apiName")).agg(F.slice(F.sort_array(F.collect_set(F.concat_ws("=", "fieldApiName", "value"))), 1, most_values).alias("values"))
    x = objects.select("apiName")
    for part in (f, p, c, v):
        x = x.join(part, "apiName", "left")
    none = F.array().cast("array<string>")
    return x.select("apiName", *[F.coalesce(k, none).alias(k) for k in ("fields", "parents", "children", "values")])


def polymorphic(fields: DataFrame, known: dict[str, str] | None = None) -> DataFrame:
    """Fields with several targets and the name of their relationship."""
    stripped = F.regexp_replace("apiName", "(?i)_?Id$", "")
    table = F.create_map(*[F.lit(x) for kv in (known or {"WhoId": "Who", "WhatId": "What", "OwnerId": "Owner", "user_id": "Who"}).items() for x in kv])
    return fields.where(F.size("referenceTo") > 1).select("sobjectType", "apiName", F.coalesce(F.element_at(table, F.col("apiName")), stripped).alias("relationshipName"), F.array_join(F.sort_array("referenceTo"), ",").alias("targets"))


def skeleton(scored: DataFrame, top: int = 15) -> DataFrame:
    """A compact line for each object (apiName, score, fields)."""
    return scored.orderBy(F.desc("score"), "apiName").limit(top).select("apiName", F.format_string("%s (%d): %s", "apiName", F.size("fields"), F.array_join(F.slice("fields", 1, 5), ", ")).alias("line"))


def expand(neighbours: DataFrame, scores: DataFrame, least: float = 0.15, budget: int = 8000, share: float = 0.1, each: int = 30) -> DataFrame:
    """The best score of each neighbour, those that fit the budget."""
    best = neighbours.join(scores, "apiName").groupBy("apiName").agg(F.max("total").alias("total")).where(F.col("total") >= least)
    return best.orderBy(F.desc("total"), "apiName").limit(min(each, int(budget * share / each)))


def merge_strategies(parts: list[tuple[str, DataFrame]], cap: int = 15) -> DataFrame:
    """Fields (sobjectType, apiName, ordinal) of several strategies in their order, each once, ``cap`` for each object."""
    out = None
    for k, (name, df) in enumerate(parts):
        part = df.select("sobjectType", "apiName", F.struct(F.lit(k).alias("priority"), F.col("ordinal").cast("long").alias("ordinal"), F.lit(name).alias("strategy")).alias("from"))
        out = part if out is None else out.unionByName(part)
    one = out.groupBy("sobjectType", "apiName").agg(F.min("from").alias("from"))
    w = Window.partitionBy("sobjectType").orderBy("from", "apiName")
    return one.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= cap).select("sobjectType", "apiName", F.col("from.strategy").alias("strategy"), "rank")


def pruned_text(merged: DataFrame, fallback: DataFrame, fewest: int = 4) -> DataFrame:
    """apiName and its fields as text; objects with few fields are filled from ``fallback`` (sobjectType, apiName)."""
    have = merged.groupBy("sobjectType").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "apiName"))), lambda x: x["apiName"]).alias("f"))
    more = fallback.groupBy("sobjectType").agg(F.sort_array(F.collect_set("apiName")).alias("m"))
    x = have.join(more, "sobjectType", "left")
    names = F.when(F.size("f") < fewest, F.slice(F.array_union("f", F.coalesce("m", F.array().cast("array<string>"))), 1, fewest)).otherwise(F.col("f"))
    return x.select(F.col("sobjectType").alias("apiName"), F.array_join(names, ", ").alias("fields"))


def ensemble(runs: DataFrame) -> DataFrame:
    """Union of tables and columns over successful runs (ok, tables, columns)."""
    union = lambda c: F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), ",").alias(c)
    return runs.where("ok").agg(union("tables"), union("columns"))


class FuzzyCache:
    """Answers kept on the driver by similar questions of an org: newest first, for a time, first in first out."""

    def __init__(self, clock: Callable[[], float], least: float = 0.8, seconds: float = 300, most: int = 100):
        self.clock, self.least, self.seconds, self.most = clock, least, seconds, most
        self.kept: OrderedDict[tuple[str, str], tuple[float, object]] = OrderedDict()

    @staticmethod
    def similar(a: str, b: str) -> float:
        from ..functions.text import STOP_WORDS

        x, y = ({w for w in "".join(c if c.isalnum() or c == "_" else " " for c in s.lower()).split() if len(w) > 2 and w not in STOP_WORDS} for s in (a, b))
        if not x and not y:
            return 1.0
        return len(x & y) / len(x | y) if x and y else 0.0

    def put(self, org: str, question: str, answer: object) -> None:
        self.kept.pop((org, question), None)
        self.kept[org, question] = (self.clock(), answer)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)

    def get(self, org: str, question: str) -> object | None:
        now = self.clock()
        for (o, q), (at, answer) in reversed(self.kept.items()):
            if o == org and now - at <= self.seconds and self.similar(q, question) >= self.least:
                return answer
        return None


def similar_questions(a: Column, b: Column) -> Column:
    return cache_jaccard(a, b)


def full_text(schema: DataFrame, objects: DataFrame) -> DataFrame:
    """apiName and a block of text for each object of ``object_schema``: its
    fields, parent lookups and child relationships, each part only where it
    has lines."""
    def part(head: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"  {head}:\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("    - "), x)), "\n")))

    values = lambda f: F.filter(F.col("values"), lambda v: F.split_part(v, F.lit("="), F.lit(1)) == F.split_part(f, F.lit(":"), F.lit(1)))
    field = lambda f: F.concat(F.split_part(f, F.lit(":"), F.lit(1)), F.lit(" ("), F.split_part(f, F.lit(":"), F.lit(2)), F.lit(")"), F.when(F.size(values(f)) > 0, F.concat(F.lit(" - Values: "), F.array_join(F.transform(values(f), lambda v: F.split_part(v, F.lit("="), F.lit(2))), ", "))).otherwise(""))
    parent = lambda p: F.concat(F.split_part(p, F.lit("->"), F.lit(1)), F.lit(".FieldName: fields of "), F.split_part(p, F.lit("->"), F.lit(2)))
    child = lambda c: F.concat(F.lit("(SELECT fields FROM "), F.split_part(c, F.lit("<-"), F.lit(1)), F.lit("): records of "), F.split_part(c, F.lit("<-"), F.lit(2)))
    head = F.concat(F.lit("Object: "), "apiName", F.lit(" ("), "label", F.lit(")"), F.when(F.col("category").isNotNull(), F.concat(F.lit(" ["), "category", F.lit("]"))).otherwise(""))
    x = schema.join(objects.select("apiName", "label", "category"), "apiName")
    return x.select("apiName", F.concat_ws("\n", head, part("Fields", F.transform("fields", field)), part("Parent lookups", F.transform("parents", parent)), part("Child relationships", F.transform("children", child))).alias("text"))


def semantic_context(hits: DataFrame, objects: DataFrame, fields: DataFrame, terms: Column, question: Column, most: int = 5, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """(fields, warnings) of the ``most`` best objects that terms found (apiName,
    confidence): ``cap`` fields of each by rank, and the anti-patterns that the
    objects' categories show in the question."""
    from .tagging import anti_patterns

    best = hits.groupBy("apiName").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "apiName").limit(most)
    chosen = fields.join(best.select(F.col("apiName").alias("sobjectType")), "sobjectType", "left_semi")
    found = important_fields(chosen, terms, cap).select("sobjectType", "apiName", "rank")
    return found, anti_patterns(objects.join(best, "apiName", "left_semi").select("apiName", "category"), question)
