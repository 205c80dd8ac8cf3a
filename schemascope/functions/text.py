"""Text functions: matching, normalising, scoring. All are column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Business words for objects.
SYNONYMS = {
    "Account": ["acct", "acc", "company", "organization", "org", "client", "customer", "business", "vendor", "partner"],
    "Contact": ["con", "person", "people", "individual"],
    "Opportunity": ["opp", "oppty", "deal", "deals", "potential sale", "revenue", "negotiation", "pipeline"],
    "Lead": ["ld", "prospect", "potential customer", "suspect", "inquiry"],
    "Case": ["cs", "ticket", "issue", "problem", "request", "incident", "support request", "complaint"],
    "Task": ["todo", "action item", "activity", "reminder"],
    "Event": ["meeting", "appointment", "calendar entry", "scheduled item"],
    "User": ["agent", "rep", "employee", "owner", "staff_member"],
    "Campaign": ["camp", "cmpgn", "promo", "marketing initiative", "promotion"],
    "Product2": ["product", "item", "merchandise", "sku", "good"],
    "Pricebook2": ["pricebook", "catalog", "pricing", "price list"],
    "Contract": ["agreement", "legal binding", "covenant"],
    "Order": ["purchase", "purchase order", "po", "requisition"],
    "Asset": ["purchased item", "equipment", "possession", "holding"],
    "Quote": ["proposal", "estimate", "bid"],
    "OpportunityLineItem": ["opportunity product", "line item", "deal product"],
    "OrderItem": ["order product", "line item"],
    "Solution": ["answer", "knowledge", "kb", "resolution"],
    "KnowledgeArticle": ["article", "guide", "help doc", "faq"],
    "Entitlement": ["sla", "support level", "right"],
    "ServiceContract": ["support agreement", "maintenance contract"],
    "ContentVersion": ["file", "document", "attachment", "upload"],
    "ContentDocument": ["file", "document", "doc"],
    "Note": ["memo", "comment", "annotation"],
    "Attachment": ["file", "upload"],
    "UserRole": ["role", "job function", "title"],
    "Profile": ["permission set", "security profile", "access level"],
    "Group": ["queue", "public group", "team"],
    "RecordType": ["record type", "layout type"],
    "Organization": ["company settings", "org settings"],
    "Partner": ["partnership", "ally"],
}
# Lexical scores of a term.
EXACT, PARTIAL, DESCRIPTION, REFERENCE = 10, 5, 2, 1
# Words that cache keys leave out.
STOP_WORDS = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "all", "show", "get", "find", "list", "me", "my"]


def closest(candidates: DataFrame, name: str, target: Column, by: list[str], ordinal: str, most: int = 3) -> DataFrame:
    """For each ``by`` key the best candidate for ``target``: exact, first prefix,
    first substring, else least edit distance up to ``most``; the first on ties."""
    a, b = F.lower(F.col(name)), F.lower(target)
    distance = F.levenshtein(a, b, most)
    tier = F.when(a == b, 0).when(a.startswith(b), 1).when(a.contains(b), 2).when(distance >= 0, 3)
    w = Window.partitionBy(*by).orderBy("tier", "distance", ordinal)
    scored = candidates.withColumn("tier", tier).where("tier is not null").withColumn("distance", F.when(F.col("tier") == 3, distance).otherwise(0))
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9\\s]", ""), "\\s+", " "))


def variants(c: Column) -> Column:
    """The term, its singular forms, its plural."""
    n = normalised(c)
    return F.array_distinct(F.array_compact(F.array(
        n,
        F.when(n.endswith("s") & (F.length(n) > 1), F.substring(n, F.lit(1), F.length(n) - 1)),
        F.when(n.endswith("es") & (F.length(n) > 2), F.substring(n, F.lit(1), F.length(n) - 2)),
        F.when(n.endswith("ies") & (F.length(n) > 3), F.concat(F.substring(n, F.lit(1), F.length(n) - 3), F.lit("y"))),
        F.when(~n.endswith("s"), F.concat(n, F.lit("s"))),
    )))


def tokens(c: Column, least: int = 1) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9_\\s]", " "), "\\s+"), lambda t: F.length(t) >= least)


def lexical_score(api_name: Column, label: Column, description: Column, kind: Column, terms: Column, least: int = 3) -> Column:
    a, b, d = F.lower(api_name), F.lower(label), F.lower(F.coalesce(description, F.lit("")))

    def one(t: Column) -> Column:
        return F.when((a == t) | (b == t), EXACT).when(a.contains(t) | b.contains(t), PARTIAL).when(d.contains(t), DESCRIPTION).otherwise(0)

    total = F.aggregate(F.filter(terms, lambda t: F.length(t) >= least), F.lit(0), lambda acc, t: acc + one(t))
    return total + F.when(kind == "reference", REFERENCE).otherwise(0)


def jaccard(a: Column, b: Column) -> Column:
    """Word Jaccard; 0 if either side has no words."""
    return set_jaccard(word_set(a), word_set(b))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "\\W+"), lambda t: t != ""))


def set_jaccard(x: Column, y: Column) -> Column:
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def cache_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of cache keys: without stop words and words of up to two letters; 1 if both are empty."""
    words = lambda c: F.array_distinct(F.filter(tokens(c, 3), lambda t: ~t.isin(*STOP_WORDS)))
    x, y = words(a), words(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def embedding_text(api_name: Column, label: Column, owner: Column, kind: Column, description: Column, help_text: Column, related: Column, least: int = 5, most: int = 6000) -> Column:
    """Parts joined by ". "; null if shorter than ``least``; cut at ``most``."""
    some = lambda c: F.nullif(c, F.lit(""))
    name, title = some(api_name), some(label)
    out = F.trim(F.concat_ws(". ", F.coalesce(title, name), F.when(title.isNotNull() & (name != title), F.concat(F.lit("("), name, F.lit(")"))), F.concat(F.lit("on "), some(owner)), F.concat(F.lit("Type: "), some(kind)), some(description), some(help_text), F.when(F.size(related) > 0, F.concat(F.lit("Related to: "), F.array_join(related, ", ")))))
    return F.when(F.length(out) >= least, F.substring(out, 1, most))


def log_score(n: Column) -> Column:
    return F.least(F.lit(1.0), F.log1p(n) / F.log1p(F.lit(50.0)))


def search_term(c: Column) -> Column:
    """A term safe for a name search: no special characters, no operators, at least two letters; else empty."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), "[?&|!{}\\[\\]()^~*:\\\\\"'+\\-]", "")
    out = F.regexp_replace(out, "(?i)\\b(AND|OR|NOT)\\b", "")
    out = F.trim(F.regexp_replace(out, "\\s+", " "))
    return F.when(F.length(out) < 2, F.lit("")).otherwise(out)


def search_query(term: str, objects: dict[str, list[str]], limit: int = 5) -> str:
    """The text of a name search over objects."""
    returning = ", ".join(f"{o}({', '.join(f)} LIMIT {limit})" for o, f in objects.items())
    return f"FIND {{{term}}} IN NAME FIELDS RETURNING {returning}"


_KEYWORDS = "SELECT|FROM|WHERE|AND|OR|NOT|IN|LIKE|ORDER|BY|GROUP|HAVING|LIMIT|OFFSET|ASC|DESC|NULLS|FIRST|LAST|NULL|TRUE|FALSE|COUNT|COUNT_DISTINCT|SUM|AVG|MIN|MAX|INCLUDES|EXCLUDES|TYPEOF|WHEN|THEN|ELSE|END|ROLLUP|CUBE"


def draft_columns(soql: Column, known: Column) -> Column:
    """Known fields named in a draft query: literals masked, keywords dropped, the last part of paths."""
    plain = F.regexp_replace(soql, "'(?:[^'\\\\]|\\\\.)*'", " ")
    names = F.regexp_extract_all(plain, F.lit("[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*"), 0)
    last = F.transform(F.filter(names, lambda t: ~t.rlike(f"(?i)^({_KEYWORDS})$")), lambda t: F.lower(F.element_at(F.split(t, "\\."), -1)))
    return F.filter(known, lambda k: F.array_contains(last, F.lower(k)))


def main_object(soql: Column) -> Column:
    return F.nullif(F.regexp_extract(soql, "(?i)\\bFROM\\s+(\\w+)", 1), F.lit(""))


def with_core(columns: Column, core=("Id", "Name", "CreatedDate", "LastModifiedDate")) -> Column:
    return F.array_union(F.array(*[F.lit(c) for c in core]), columns)


def regex_escape(s: str) -> str:
    return re.escape(s)
