"""Graph reads and paths over the catalog's edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

_DERIVED = "(Share|Feed|History|ChangeEvent)$"


def all_objects(objects: DataFrame, org: str | None = None, deleted: bool = False) -> DataFrame:
    x = objects if org is None else objects.where(F.col("orgId") == org)
    x = x if deleted else x.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    return x.select("apiName", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("category", F.lit("standard")).alias("category")).orderBy("apiName")


def object_by_name(objects: DataFrame, fields: DataFrame, name: str) -> DataFrame:
    counts = fields.groupBy(F.col("sobjectType").alias("apiName"), "orgId").agg(F.count("*").alias("fieldCount"))
    return objects.where(F.lower("apiName") == name.lower()).join(counts, ["apiName", "orgId"], "left").withColumn("fieldCount", F.coalesce("fieldCount", F.lit(0)))


def object_fields(fields: DataFrame, name: str, stamp: str = "lastRefreshed") -> DataFrame:
    """An object's fields by name; of several rows of one name the one refreshed last, then first by org."""
    own = fields.where(F.lower("sobjectType") == name.lower())
    if stamp in fields.columns:
        w = Window.partitionBy("apiName").orderBy(F.col(stamp).desc_nulls_last(), "orgId")
        own = own.withColumn("row_", F.row_number().over(w)).where("row_ = 1").drop("row_")
    return own.orderBy("apiName")


def relationships(refs: DataFrame, name: str) -> DataFrame:
    """Outgoing and incoming, one row for each field and target."""
    out = refs.where(F.lower("sourceObject") == name.lower()).select(F.lit("outgoing").alias("direction"), "fieldName", "sourceObject", "targetObject", "relationshipName", "relationshipType")
    into = refs.where(F.lower("targetObject") == name.lower()).select(F.lit("incoming").alias("direction"), "fieldName", "sourceObject", "targetObject", "relationshipName", "relationshipType")
    return out.unionByName(into).distinct()


def edges(refs: DataFrame, rollups: DataFrame) -> DataFrame:
    """(source, type, target) of every edge."""
    return refs.select(F.concat_ws(".", "sourceObject", "fieldName").alias("source"), F.when(F.col("relationshipType") == "MasterDetail", "MASTER_DETAIL").otherwise("LOOKS_UP").alias("type"), F.col("targetObject").alias("target")).unionByName(rollups.select(F.col("sourceObject").alias("source"), F.lit("REFERENCES").alias("type"), F.col("targetObject").alias("target")))


def neighbours(rollups: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """Direct neighbours, outgoing first, derived objects left out."""
    out = rollups.where(F.col("sourceObject") == name).select(F.lit(0).alias("rank"), F.col("targetObject").alias("apiName"), F.lit("outgoing").alias("direction"))
    into = rollups.where(F.col("targetObject") == name).select(F.lit(1).alias("rank"), F.col("sourceObject").alias("apiName"), F.lit("incoming").alias("direction"))
    return out.unionByName(into).where(~F.col("apiName").rlike(_DERIVED)).distinct().orderBy("rank", "apiName").limit(limit).select("apiName", "direction")


def child_relationships(rollups: DataFrame, name: str) -> DataFrame:
    x = rollups.where(F.col("targetObject") == name).select(F.col("sourceObject").alias("childObject"), F.explode("childRelationshipNames").alias("relationshipName"), "fields", "relationshipType")
    return x.select("childObject", "relationshipName", F.explode("fields").alias("fieldApiName"), (F.col("relationshipType") == "MASTER_DETAIL").alias("isMasterDetail")).distinct().orderBy("relationshipName", "childObject", "fieldApiName")


def picklist_values(values: DataFrame, owner: str, name: str) -> DataFrame:
    return values.where((F.col("objectApiName") == owner) & (F.col("fieldApiName") == name)).select("value", "label", "isActive").orderBy("value")


def objects_by_value(values: DataFrame, value: str, limit: int = 20) -> DataFrame:
    return values.where(F.col("isActive") & (F.lower("value") == value.lower())).select("objectApiName", "fieldApiName", "value").orderBy("objectApiName", "fieldApiName").limit(limit)


def relationship_target(refs: DataFrame, name: str) -> DataFrame:
    """Where a relationship or field name leads: as it is, else its singular or ``__c`` form; the best rank."""
    guesses = {0: [name], 1: [name.removesuffix("__r") + "__c"] if name.endswith("__r") else [name[:-1], name[:-3] + "y"] if name.endswith("s") else []}
    x = reduce(lambda a, b: a.unionByName(b), [refs.where(F.lower("relationshipName").isin(*[g.lower() for g in gs]) | F.lower("fieldName").isin(*[g.lower() for g in gs])).select("sourceObject", "targetObject", F.lit(rank).alias("rank")) for rank, gs in guesses.items() if gs])
    best = x.agg(F.min("rank").alias("rank"))
    return x.join(F.broadcast(best), "rank").select("sourceObject", "targetObject", "rank").distinct()


def signals(refs: DataFrame, names: DataFrame, primary: list[str]) -> DataFrame:
    """apiName, relationshipCount, primaryCount, isJunction of each name."""
    x = names.join(refs, names["apiName"] == refs["sourceObject"], "left")
    return x.groupBy("apiName").agg(F.countDistinct("targetObject").alias("relationshipCount"), F.countDistinct(F.when(F.col("targetObject").isin(*primary), F.col("targetObject"))).alias("primaryCount")).withColumn("isJunction", F.col("primaryCount") >= 2)


def org_summary(objects: DataFrame) -> DataFrame:
    return objects.groupBy("orgId").agg(F.count("*").alias("objectCount"), F.max("lastRefreshed").alias("lastSync"))


def search_objects(objects: DataFrame, q: str, limit: int = 20) -> DataFrame:
    if len(q) < 2:
        raise ValueError("at least two letters")
    hit = F.lower("apiName").contains(q.lower()) | F.lower("label").contains(q.lower())
    return objects.where(hit).orderBy("apiName").limit(max(1, min(100, limit)))


# --- paths


def distances(step: DataFrame, source: str, most: int, target: str | None = None) -> DataFrame:
    """apiName, distance of what arcs (src, dst) reach from ``source`` within
    ``most`` hops, the source included; ends at the level that reaches ``target``.

    Each level is written to the shared folder, so no level computes an earlier
    one again, and a node is met once.
    """
    front = step.sparkSession.createDataFrame([(source, 0)], "apiName string, distance int")
    seen = front
    for d in range(1, most + 1):
        front = staged(front.join(step, F.col("apiName") == F.col("src")).select(F.col("dst").alias("apiName")).distinct().join(seen, "apiName", "left_anti").withColumn("distance", F.lit(d)), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if target is not None and not front.where(F.col("apiName") == target).isEmpty():
            break
    return seen


def shortest_paths(arcs: DataFrame, source: str, target: str, most: int = 5, limit: int = 10, directed: bool = True) -> DataFrame:
    """nodes of all shortest paths along arcs (src, dst), in a total order.

    Distances first, then back from the target over arcs that come one nearer:
    only arcs on shortest paths are ever extended.
    """
    step = arcs.select("src", "dst").distinct()
    if not directed:
        step = step.unionByName(step.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    step = staged(step.where("src != dst"), "arcs")
    at = distances(step, source, most, target)
    end = at.where((F.col("apiName") == target) & (F.col("distance") > 0)).select("distance").first()
    paths = step.sparkSession.createDataFrame([([target],)] if end else [], "nodes array<string>")
    for d in range(end.distance - 1 if end else 0, -1, -1):
        nearer = at.where(F.col("distance") == d).select(F.col("apiName").alias("src"))
        paths = paths.join(step.join(nearer, "src", "left_semi"), F.element_at("nodes", 1) == F.col("dst")).select(F.concat(F.array("src"), "nodes").alias("nodes"))
    found = paths.where(F.lit(end is not None) & (F.element_at("nodes", 1) == source))
    return found.select(F.array_join("nodes", ">").alias("path"), (F.size("nodes") - 1).alias("hops")).orderBy("path").limit(limit)


def related(arcs: DataFrame, source: str, depth: int, limit: int | None = 100) -> DataFrame:
    """apiName, distance within ``depth`` hops in either direction, nearest first."""
    both = staged(arcs.select("src", "dst").unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "arcs")
    out = distances(both, source, depth).where("distance > 0").orderBy("distance", "apiName")
    return out if limit is None else out.limit(limit)


def neighbourhood_edges(refs: DataFrame, arcs: DataFrame, source: str, depth: int) -> DataFrame:
    """Field edges whose ends both lie within ``depth`` hops."""
    inside = related(arcs, source, depth, None).select("apiName").unionByName(refs.sparkSession.createDataFrame([(source,)], "apiName string"))
    return refs.join(inside, refs["sourceObject"] == inside["apiName"], "left_semi").join(inside, refs["targetObject"] == inside["apiName"], "left_semi").select("sourceObject", "fieldName", "targetObject")


def detailed_paths(refs: DataFrame, source: str, target: str, most: int = 5, limit: int = 25) -> DataFrame:
    """path, hop, from, to, direction, fields of undirected shortest paths; a hop is up if a field leads that way."""
    arcs = refs.select(F.col("sourceObject").alias("src"), F.col("targetObject").alias("dst"))
    hops = shortest_paths(arcs, source, target, most, limit, directed=False).select("path", F.split("path", ">").alias("n"))
    hops = hops.select("path", F.posexplode(F.arrays_zip(F.slice(F.col("n"), 1, F.size("n") - 1).alias("a"), F.slice(F.col("n"), 2, F.size("n") - 1).alias("b"))).alias("hop", "x")).select("path", "hop", F.col("x.a").alias("from"), F.col("x.b").alias("to"))
    up = refs.groupBy(F.col("sourceObject").alias("from"), F.col("targetObject").alias("to")).agg(F.array_join(F.sort_array(F.collect_set("fieldName")), ",").alias("up"))
    down = refs.groupBy(F.col("targetObject").alias("from"), F.col("sourceObject").alias("to")).agg(F.array_join(F.sort_array(F.collect_set("fieldName")), ",").alias("down"))
    x = hops.join(up, ["from", "to"], "left").join(down, ["from", "to"], "left")
    return x.select("path", "hop", "from", "to", F.when(F.col("up").isNotNull(), "up").otherwise("down").alias("direction"), F.coalesce("up", "down", F.lit("Unknown")).alias("fields"))


def consolidate(hops: DataFrame) -> DataFrame:
    """Paths of the same nodes merged: fields united hop by hop, up wins."""
    return hops.groupBy("path", "hop", "from", "to").agg(F.max("direction").alias("direction"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.split("fields", ","))))), ",").alias("fields"))


def query_paths(refs: DataFrame, source: str, target: str, most: int = 5, limit: int = 20) -> DataFrame:
    """path, hops, dot (up paths as a dotted name), subquery (down paths), tooDeep, recommended.

    Trails forward and backward: no edge twice; shortest first.
    """
    arcs = staged(refs.select(F.col("sourceObject").alias("a"), F.col("targetObject").alias("b"), F.col("relationshipName").alias("up"), F.col("childName").alias("down"), F.concat_ws(".", "sourceObject", "fieldName", "targetObject").alias("id")), "arcs")

    def trails(start: str, end: str) -> DataFrame:
        """Level by level; a trail goes on only where the end is still in reach, and levels stop once enough are found."""
        back = arcs.select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct()
        reach = distances(back, end, most).select(F.col("apiName").alias("b"), "distance")
        open_ = refs.sparkSession.createDataFrame([([start], [], [], [])], "nodes array<string>, ids array<string>, ups array<string>, downs array<string>")
        done, found = [], 0
        for k in range(1, most + 1):
            useful = arcs.join(reach.where(F.col("distance") <= most - k).select("b"), "b", "left_semi")
            open_ = open_.join(useful, F.element_at("nodes", -1) == F.col("a")).where(~F.array_contains("ids", F.col("id"))).select(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("ids", F.array("id")).alias("ids"), F.concat("ups", F.array("up")).alias("ups"), F.concat("downs", F.array("down")).alias("downs"))
            open_ = staged(open_, "trails")
            done.append(open_.where(F.element_at("nodes", -1) == end))
            found += done[-1].count()
            if found >= limit:
                break
        return reduce(lambda x, y: x.unionByName(y), done)

    up = trails(source, target).select(F.array_join("nodes", ">").alias("path"), F.size("ids").alias("hops"), F.array_join("ups", ".").alias("dot"), F.lit(None).cast("string").alias("subquery"))
    down = trails(target, source).select(F.array_join(F.reverse("nodes"), ">").alias("path"), F.size("ids").alias("hops"), F.lit(None).cast("string").alias("dot"), F.array_join(F.reverse("downs"), ".").alias("subquery"))
    x = up.unionByName(down).withColumn("tooDeep", F.col("hops") > 5).orderBy("hops", "path", "dot", "subquery").limit(limit)
    best = x.where("not tooDeep").agg(F.min(F.struct("hops", "path", F.coalesce("dot", F.lit("")).alias("d"), F.coalesce("subquery", F.lit("")).alias("s"))).alias("m"))
    return x.join(F.broadcast(best)).withColumn("recommended", F.coalesce(F.struct("hops", "path", F.coalesce("dot", F.lit("")).alias("d"), F.coalesce("subquery", F.lit("")).alias("s")) == F.col("m"), F.lit(False))).drop("m")


def path_tree(paths: list[list[str]], via: dict[tuple[str, str], str] | None = None) -> str:
    """Paths as an indented tree; a node met before on its path is marked."""
    tree: dict = {}
    for nodes in paths:
        at = tree
        for n in nodes:
            at = at.setdefault(n, {})

    def lines(at: dict, depth: int, above: tuple[str, ...]) -> list[str]:
        out = []
        for n, below in at.items():
            link = (via or {}).get((above[-1], n)) if above else None
            out.append("  " * depth + ("-> " if above else "") + n + (f" (via {link})" if link else "") + (" [cycle]" if n in above else ""))
            out += lines(below, depth + 1, (*above, n))
        return out

    return "\n".join(lines(tree, 0, ()))


def node_list(nodes: DataFrame, edges_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (apiName, depth), least depth first; edges with both ends, each once."""
    n = nodes.groupBy(F.lower("apiName").alias("id")).agg(F.min("depth").alias("depth"), F.min_by("apiName", "depth").alias("apiName"))
    e = edges_.withColumn("id", F.lower(F.concat_ws("-", "sourceObject", "fieldName", "targetObject"))).dropDuplicates(["id"])
    inside = n.select(F.col("id").alias("_n"))
    for c in ("sourceObject", "targetObject"):
        e = e.join(inside, F.lower(c) == F.col("_n"), "left_semi")
    return n, e


def _arcs(rollups: DataFrame) -> DataFrame:
    return rollups.select(F.col("sourceObject").alias("src"), F.col("targetObject").alias("dst"))


arcs_of = _arcs


# --- point and bulk reads


def status(objects: DataFrame) -> DataFrame:
    """populated, objectCount of the live objects."""
    return objects.where(~F.coalesce(F.col("deleted"), F.lit(False))).agg((F.count("*") > 0).alias("populated"), F.count("*").alias("objectCount"))


def in_category(assigned: DataFrame, objects: DataFrame, category: str) -> DataFrame:
    """apiName, label, confidence of the objects that a category is assigned to, surest first."""
    return objects.join(assigned.where(F.col("category") == category).select("apiName", "confidence"), "apiName").select("apiName", "label", "confidence").orderBy(F.desc("confidence"), "apiName")


def object_properties(objects: DataFrame, name: str) -> DataFrame:
    from ..functions import naming

    n = F.col("apiName")
    return objects.where(n == name).select(n, "label", naming.namespace(n).alias("namespace"), "category", naming.subtype(n).alias("subtype"))


def field_properties(fields: DataFrame, owner: str, name: str) -> DataFrame:
    """A field's properties; no targets is null."""
    from ..functions import naming

    n = F.col("apiName")
    return fields.where((n == name) & (F.col("sobjectType") == owner)).select(n, "sobjectType", "label", "type", naming.namespace(n).alias("namespace"), naming.field_category(n).alias("category"), F.when(F.size("referenceTo") > 0, F.array_join("referenceTo", ",")).alias("referenceTo"))


def lookups_to(objects: DataFrame, refs: DataFrame, target: str) -> DataFrame:
    """apiName, hasLookup of every object: whether a field of it refers to ``target``."""
    hit = refs.where(F.col("targetObject") == target).select(F.col("sourceObject").alias("apiName"), F.lit(True).alias("hit")).distinct()
    return objects.select("apiName").join(hit, "apiName", "left").select("apiName", F.coalesce("hit", F.lit(False)).alias("hasLookup"))


def custom_objects(objects: DataFrame) -> DataFrame:
    return objects.where("category = 'custom'").select("apiName").orderBy("apiName")


def unembedded(objects: DataFrame, fields: DataFrame, vectors: DataFrame) -> DataFrame:
    """kind, id of the objects and fields that have no vector (vectors: kind, id)."""
    every = objects.select(F.lit("Object").alias("kind"), F.col("apiName").alias("id")).unionByName(fields.select(F.lit("Field").alias("kind"), F.concat_ws(".", "sobjectType", "apiName").alias("id")))
    return every.join(vectors, ["kind", "id"], "left_anti")


def fields_with_owner(fields: DataFrame, objects: DataFrame, owner: str | None = None, org: str | None = None) -> DataFrame:
    """Fields with their object's label; of one object and one org only, where given."""
    x = fields if owner is None else fields.where(F.col("sobjectType") == owner)
    x = x if org is None else x.where(F.col("orgId") == org)
    o = objects.select(F.col("apiName").alias("sobjectType"), "orgId", F.col("label").alias("objectLabel"))
    return x.join(o, ["sobjectType", "orgId"]).select("sobjectType", "apiName", "label", "type", "objectLabel")


def search_nodes(objects: DataFrame, fields: DataFrame) -> DataFrame:
    """id, label, category, fieldCount, isCenter of search results."""
    counts = fields.groupBy(F.col("sobjectType").alias("id")).agg(F.count("*").alias("fieldCount"))
    x = objects.select(F.col("apiName").alias("id"), F.coalesce("label", "apiName").alias("label"), F.coalesce("category", F.lit("standard")).alias("category"))
    return x.join(counts, "id", "left").withColumn("fieldCount", F.coalesce("fieldCount", F.lit(0))).withColumn("isCenter", F.lit(False))


# Objects that link users or contacts to an object.
JUNCTIONS = {"Opportunity": ["OpportunityTeamMember", "OpportunityContactRole"], "Account": ["AccountTeamMember"], "Case": ["CaseTeamMember"]}


def compact(objects: DataFrame, fields: DataFrame, refs: DataFrame) -> DataFrame:
    """apiName, label, category, fieldCount, parents, junctions of every object that has fields."""
    f = fields.groupBy(F.col("sobjectType").alias("apiName")).agg(F.count("*").alias("fieldCount"), F.max((F.col("apiName") == "OwnerId").cast("int")).alias("owned"))
    arrow = F.concat_ws(" -> ", "relationshipName", F.array_join(F.sort_array(F.collect_set("targetObject")), ", "))
    p = refs.where("relationshipName is not null").groupBy(F.col("sourceObject").alias("apiName"), "relationshipName").agg(arrow.alias("hint")).groupBy("apiName").agg(F.sort_array(F.collect_list("hint")).alias("parents"))
    none = F.array().cast("array<string>")
    owner = F.when(F.col("owned") == 1, F.array(F.lit("Owner -> User"))).otherwise(none)
    junctions = F.create_map(*[x for k, v in JUNCTIONS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    x = objects.join(f, "apiName").join(p, "apiName", "left")
    return x.select("apiName", F.coalesce("label", "apiName").alias("label"), F.coalesce("category", F.lit("standard")).alias("category"), "fieldCount", F.concat(F.coalesce("parents", none), owner).alias("parents"), F.coalesce(F.element_at(junctions, F.col("apiName")), none).alias("junctions"))
