"""Parts of a query from a plain question, by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import DATE_PHRASES, lookup, multiplier, number_text, value_type
from ..plans.staging import bounded

_PLACE, _NAME = "([A-Za-z\\s]+)$", "\\s+(is|=|equals)\\s+([A-Za-z\\s]+)$"
_UNIT = "(\\s*k|\\s*thousand|\\s*m|\\s*million|\\s*b|\\s*billion)?"
_DAYS = "(yesterday|today|this week|this month|this year|last week|last month|last year)"
_PEOPLE = "\\s+(employees|employee|staff|people)"
# Fixed values: (pattern, object, field, operator, how, group) of explicit conditions.
EXPLICIT = [
    ("in\\s+" + _PLACE, "Account", "BillingState", "=", "text", 1),
    ("located\\s+in\\s+" + _PLACE, "Account", "BillingState", "=", "text", 1),
    ("from\\s+" + _PLACE, "Account", "BillingState", "=", "text", 1),
    ("based\\s+in\\s+" + _PLACE, "Account", "BillingState", "=", "text", 1),
    ("(more than|greater than|over|above)\\s+(\\d+)" + _PEOPLE, "Account", "NumberOfEmployees", ">", "number", 2),
    ("(less than|fewer than|under|below)\\s+(\\d+)" + _PEOPLE, "Account", "NumberOfEmployees", "<", "number", 2),
    ("with\\s+(\\d+)\\s+(or more|or greater)" + _PEOPLE, "Account", "NumberOfEmployees", ">=", "number", 1),
    ("(revenue|annual revenue|sales)\\s+(greater than|more than|over|above)\\s+(\\d+)" + _UNIT, "Account", "AnnualRevenue", ">", "scaled", 3),
    ("(revenue|annual revenue|sales)\\s+(less than|under|below)\\s+(\\d+)" + _UNIT, "Account", "AnnualRevenue", "<", "scaled", 3),
    ("(last name|lastname)" + _NAME, "Contact", "LastName", "=", "text", 3),
    ("(first name|firstname)" + _NAME, "Contact", "FirstName", "=", "text", 3),
    ("whose\\s+(last name|lastname)" + _NAME, "Contact", "LastName", "=", "text", 3),
    ("where\\s+(last name|lastname)" + _NAME, "Contact", "LastName", "=", "text", 3),
    ("(amount|value|deal size|revenue|worth|price)\\s+(greater than|more than|over|above)\\s+(\\d+)" + _UNIT, "Opportunity", "Amount", ">", "scaled", 3),
    ("(amount|value|deal size|revenue|worth|price)\\s+(less than|under|below)\\s+(\\d+)" + _UNIT, "Opportunity", "Amount", "<", "scaled", 3),
    ("worth\\s+(over|more than)\\s+(\\d+)(\\s*k|\\s*thousand|\\s*m|\\s*million|\\s*b|\\s*billion|\\s*bucks|\\s*dollars)?", "Opportunity", "Amount", ">", "scaled", 2),
    ("created\\s+" + _DAYS, None, "CreatedDate", "=", "day", 1),
    ("created\\s+(in the last|within the last|in the past|within the past)\\s+(\\d+)\\s+(days?|weeks?|months?|years?)", None, "CreatedDate", ">=", "last", 2),
    ("modified\\s+" + _DAYS, None, "LastModifiedDate", "=", "day", 1),
]
# Fixed values: (pattern, object, field, operator, value, type) of implied conditions.
IMPLIED = [
    ("\\b(active)\\b", "Account", "IsActive", "=", "true", "boolean"),
    ("\\b(inactive|not active)\\b", "Account", "IsActive", "=", "false", "boolean"),
    ("\\b(open)\\b", "Case", "IsClosed", "=", "false", "boolean"),
    ("\\b(closed)\\b", "Case", "IsClosed", "=", "true", "boolean"),
    ("\\b(won|winning|successful)\\b", "Opportunity", "IsWon", "=", "true", "boolean"),
    ("\\b(lost|unsuccessful)\\b", "Opportunity", "IsWon", "=", "false", "boolean"),
    ("\\b(converted)\\b", "Lead", "IsConverted", "=", "true", "boolean"),
    ("\\b(not converted|unconverted)\\b", "Lead", "IsConverted", "=", "false", "boolean"),
    ("\\b(big|large)\\b", "Opportunity", "Amount", ">", "100000", "number"),
    ("\\b(small)\\b", "Opportunity", "Amount", "<", "10000", "number"),
]
# Where an object keeps its place.
PLACES = {"Account": "BillingState", "Contact": "MailingState", "Lead": "State"}
# Status words and words that are no company.
STATUS_WORDS = ["high", "medium", "low", "critical", "urgent", "normal", "open", "closed", "new", "pending", "escalated", "won", "lost", "active", "inactive"]
NO_COMPANY = ["the", "all", "my", "our", "their", "some", "any", "open", "closed", "new"]
NO_ENTITY = ["The", "Show", "Get", "Find", "All", "With", "From", "And", "For"]
_NEGATIVE = {"IsActive": "(?i)\\bnot active\\b", "IsConverted": "(?i)\\bnot converted\\b"}


def _condition(field: str, op: str, value: Column, kind: Column, source: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(op).alias("operator"), value.alias("value"), kind.alias("valueType"), F.lit(source).alias("source"))


def explicit(q: Column, owner: Column) -> list[Column]:
    out = []
    for pattern, name, field, op, how, group in EXPLICIT:
        p = "(?i)" + pattern
        text = F.trim(F.regexp_extract(q, p, group))
        if how == "number":
            value = text
        elif how == "scaled":
            value = number_text(text.try_cast("double") * multiplier(F.regexp_extract(q, p, group + 1)))
        elif how == "day":
            value = lookup(DATE_PHRASES, F.lower(text))
        elif how == "last":
            value = F.concat(F.lit("LAST_N_"), F.upper(F.regexp_replace(F.regexp_extract(q, p, 3), "(?i)s$", "")), F.lit("S:"), text)
        else:
            value = text
        fits = q.rlike(p) if name is None else q.rlike(p) & (owner == name)
        out.append(F.when(fits, _condition(field, op, value, value_type(value), "pattern")))
    return out


def implied(q: Column, owner: Column) -> list[Column]:
    """The negative form of a word wins over the word in it."""
    out = []
    for pattern, name, field, op, value, kind in IMPLIED:
        fits = q.rlike("(?i)" + pattern) & (owner == name)
        if value == "true" and field in _NEGATIVE:
            fits = fits & ~q.rlike(_NEGATIVE[field])
        out.append(F.when(fits, _condition(field, op, F.lit(value), F.lit(kind), "implied")))
    return out


def place(q: Column, owner: Column) -> Column:
    text = F.lit(None).cast("string")
    for head in ("in", "located\\s+in", "from", "based\\s+in")[::-1]:
        got = F.trim(F.regexp_extract(q, f"(?i)\\b{head}\\s+([A-Za-z\\s]+)$", 1))
        text = F.when((F.length(got) >= 2) & ~F.lower(got).isin("the", "a", "an"), got).otherwise(text)
    field = lookup(PLACES, owner)
    return F.when(text.isNotNull() & field.isNotNull(), F.struct(field.alias("field"), F.lit("=").alias("operator"), text.alias("value"), F.lit("string").alias("valueType"), F.lit("location").alias("source")))


def conditions(questions: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """id and every condition of questions (id, question, object); only on fields that exist if ``fields`` is given."""
    q, o = F.col("question"), F.col("object")
    x = questions.select("id", "object", F.explode(F.array_compact(F.array(*explicit(q, o), *implied(q, o), place(q, o)))).alias("c")).select("id", "object", "c.*").distinct()
    if fields is not None:
        x = x.join(fields, (fields["sobjectType"] == x["object"]) & (fields["apiName"] == x["field"]), "left_semi")
    return x


def potential_entities(q: Column) -> tuple[Column, Column]:
    """(entities, values): custom names and capitalised words; status words, companies, capitalised words."""
    words = F.transform(F.split(F.lower(q), "\\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9_]", ""))
    statuses = F.transform(F.filter(words, lambda w: w.isin(*STATUS_WORDS)), lambda w: F.initcap(w))
    company = F.concat(*[F.regexp_extract_all(q, F.lit(p), 1) for p in ("(?i)(?:for|from)\\s+(\\w+)\\s+(?:deals?|accounts?|opportunities?|cases?)", "(?i)(\\w+)\\s+(?:deals?|accounts?|opportunities?|cases?)\\s+(?:owned|with|where)")])
    company = F.filter(company, lambda w: ~F.lower(w).isin(*NO_COMPANY))
    capital = F.filter(F.regexp_extract_all(q, F.lit("\\b([A-Z][a-z]+(?:[A-Z][a-z]+)*)\\b"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*NO_ENTITY))
    return F.array_distinct(F.concat(F.regexp_extract_all(q, F.lit("(?i)\\b(\\w+__c)\\b"), 1), capital)), F.array_distinct(F.concat(statuses, company, capital))


# Wordings of a parent lookup and of a child list.
_PARENT = ["(\\w+)\\s+with\\s+(?:their\\s+)?(\\w+)\\s+(?:name|id|details?|info(?:rmation)?)", "(\\w+)\\s+including\\s+(\\w+)\\s+(?:name|id|details?)", "(\\w+)\\s+and\\s+(?:their\\s+)?(\\w+)\\s+(?:name|id)"]
_CHILD = ["(\\w+)\\s+that\\s+have\\s+(\\w+s)\\b", "(\\w+)\\s+with\\s+(?:their\\s+)?(?:all\\s+)?(\\w+s)\\b(?!\\s+(?:name|id|details?))", "(\\w+)\\s+and\\s+(?:their\\s+)?(\\w+s)\\b(?!\\s+(?:name|id))", "(\\w+)\\s+(?:including|showing)\\s+(?:all\\s+)?(?:related\\s+)?(\\w+s)\\b"]


def _intent_of(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), F.initcap(x["a"]).alias("source"), F.initcap(x["b"]).alias("target"))


def relationship_intents(q: Column) -> Column:
    """Distinct (kind, source, target) that the wording shows."""
    low = F.lower(q)
    parts = []
    for kind, patterns in (("parent_lookup", _PARENT), ("child_subquery", _CHILD)):
        for p in patterns:
            pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(p), 1).alias("a"), F.regexp_extract_all(low, F.lit(p), 2).alias("b"))
            parts.append(F.transform(pairs, _intent_of(kind)))
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x["source"] != x["target"]))


# Phrases that ask for the largest; phrases that name an order themselves; phrases that ask about all the data.
LARGEST = ["top", "highest", "largest", "most"]
ORDERED = ["order by", "sort by"]
GLOBAL_PHRASES = ["overview", "summarize", "summary", "structure", "schema", "how is my data", "what objects", "top objects", "data model", "big picture", "all data", "trends"]


def _holds(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: text.contains(p))


def order_and_limit(q: Column) -> tuple[Column, Column]:
    """(struct(field, direction) or null, limit or null). Opportunities asked
    for by size go by amount, the largest first; an order in words is left alone."""
    low = F.lower(q)
    by = F.when(_holds(low, LARGEST) & ~_holds(low, ORDERED) & low.contains("opportunities"), F.struct(F.lit("Amount").alias("field"), F.lit("DESC").alias("direction")))
    number = lambda word: F.nullif(F.regexp_extract(low, f"{word}\\s+(\\d+)", 1), F.lit("")).try_cast("int")
    return by, F.coalesce(number("limit"), number("top"))


def is_global(q: Column) -> Column:
    return _holds(F.lower(q), GLOBAL_PHRASES)


# Words of a question and the fields that they call for, on objects that have them.
FIELD_WORDS = {
    "phone": ["Phone"], "website": ["Website"], "email": ["Email"], "address": ["BillingAddress", "ShippingAddress", "MailingAddress"], "employee": ["NumberOfEmployees"],
    "industry": ["Industry"], "revenue": ["AnnualRevenue"], "stage": ["StageName"], "probability": ["Probability"], "owner": ["OwnerId"], "account": ["AccountId"], "contact": ["ContactId"],
    **{w: ["CreatedDate", "LastModifiedDate", "CloseDate"] for w in ("date", "when", "time", "year", "month", "created")}, "name": ["Name"],
}
OBJECT_FIELD_WORDS = {
    "Contact": {"first name": ["FirstName"], "firstname": ["FirstName"], "last name": ["LastName"], "lastname": ["LastName"]},
    "Opportunity": {w: ["Amount"] for w in ("amount", "value", "worth", "money", "dollar")},
}


def needed_fields(questions: DataFrame, fields: DataFrame) -> DataFrame:
    """id, apiName: which proposed fields of questions (id, question, object,
    proposed) a query needs: those that the question names, those that its
    words call for, and Id; only fields that the object has."""
    words = [(None, w, f) for w, fs in FIELD_WORDS.items() for f in fs] + [(o, w, f) for o, ws in OBJECT_FIELD_WORDS.items() for w, fs in ws.items() for f in fs] + [(None, "", "Id")]
    table = questions.sparkSession.createDataFrame(words, "owner string, word string, apiName string")
    low = F.lower("question")
    called = questions.join(F.broadcast(table), low.contains(F.col("word")) & (F.col("owner").isNull() | (F.col("owner") == F.col("object")))).select("id", "object", "apiName")
    named = questions.select("id", "object", "question", F.explode("proposed").alias("apiName")).where(low.contains(F.lower("apiName"))).select("id", "object", "apiName")
    found = called.unionByName(named).distinct()
    return found.join(fields.select(F.col("sobjectType").alias("object"), "apiName"), ["object", "apiName"], "left_semi").select("id", "apiName")


def identify_objects(questions: DataFrame, objects: DataFrame, hits: DataFrame) -> DataFrame:
    """id, apiName, confidence: search hits (id, apiName, confidence) of the words, and object names in the text; most confident first."""
    named = questions.join(bounded(objects.select("apiName")), F.lower("question").contains(F.lower("apiName"))).select("id", "apiName", F.lit(0.8).alias("confidence"))
    return hits.unionByName(named).groupBy("id", "apiName").agg(F.max("confidence").alias("confidence"))


def identify_fields(questions: DataFrame, fields: DataFrame) -> DataFrame:
    q = F.lower("question")
    return questions.join(bounded(fields.select("sobjectType", "apiName", "label")), (F.col("object") == F.col("sobjectType")) & (q.contains(F.lower("apiName")) | q.contains(F.lower("label")))).select("id", "sobjectType", "apiName").distinct()


# Child lists whose names aren't the object's with an s.
CHILD_LISTS = {"Opportunity": "Opportunities", "Product2": "Products"}


def relationship_sketch(source: str, target: str, kind: str) -> str:
    """A query for a relationship: the target as a dotted parent, or as a child list of the source."""
    if kind == "parent_lookup":
        return f"SELECT Id, {target}.Name FROM {source}"
    return f"SELECT Id, Name, (SELECT Id FROM {CHILD_LISTS.get(target, target + 's')}) FROM {source}"
