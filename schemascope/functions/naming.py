"""Classification of object and field names, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that decide an object's kind, in the order they are tried.
DERIVED_SUFFIXES = [
    ("__Share", "share"), ("__Feed", "feed"), ("__History", "history"), ("__ChangeEvent", "change_event"),
    ("Share", "share"), ("Feed", "feed"), ("History", "history"), ("ChangeEvent", "change_event"),
]
PRIMARY_SUFFIXES = [("__c", "custom"), ("__x", "external"), ("__mdt", "metadata_type"), ("__e", "platform_event")]
# Names shown for categories and subtypes.
CATEGORY_NAMES = {
    "standard": "Standard Objects", "custom": "Custom Objects", "external": "External Objects",
    "metadata_type": "Custom Metadata Types", "platform_event": "Platform Events", "system": "System Objects",
}
SUBTYPE_NAMES = {"share": "Sharing Object", "feed": "Feed Object", "history": "History Object", "change_event": "Change Event"}


def _derived(name: Column, found) -> Column:
    """found(suffix, subtype) for the first derived suffix that the name has, but isn't."""
    out = F.lit(None).cast("string")
    for suffix, subtype in reversed(DERIVED_SUFFIXES):
        out = F.when(name.endswith(suffix) & (F.length(name) > len(suffix)), found(suffix, subtype)).otherwise(out)
    return out


def subtype(name: Column) -> Column:
    return _derived(name, lambda _, s: F.lit(s))


def category(name: Column) -> Column:
    out = F.lit("standard")
    for suffix, kind in reversed(PRIMARY_SUFFIXES):
        out = F.when(name.endswith(suffix), F.lit(kind)).otherwise(out)
    return F.when(subtype(name).isNotNull(), F.lit("system")).otherwise(out)


def namespace(name: Column) -> Column:
    parts = F.split(name, "__")
    return F.when(F.size(parts) >= 3, parts[0])


def parent_name(name: Column) -> Column:
    """The object that a derived object belongs to."""
    def cut(suffix: str, _) -> Column:
        base = F.substring(name, F.lit(1), F.length(name) - len(suffix))
        return F.when(base.endswith("__c") | F.lit(not suffix.startswith("__")), base).otherwise(F.concat(base, F.lit("__c")))

    return _derived(name, cut)


def field_category(name: Column) -> Column:
    return F.when(name.endswith("__c"), F.lit("custom")).otherwise(F.lit("standard"))


def matches_category(kind: Column, wanted: list[str] | None) -> Column:
    return kind.isin(*wanted) if wanted else F.lit(True)


def relationship_type(targets: Column, owner: Column, order: Column, cascade: Column) -> Column:
    """Null without targets; a self reference, an owning reference by either sign, or a plain one."""
    return (
        F.when(targets.isNull() | (F.size(targets) == 0), F.lit(None).cast("string"))
        .when(F.array_contains(targets, owner), F.lit("Hierarchical"))
        .when(order.isNotNull() | F.coalesce(cascade, F.lit(False)), F.lit("MasterDetail"))
        .otherwise(F.lit("Lookup"))
    )


def display_name(kind: Column, sub: Column | None = None) -> Column:
    table = CATEGORY_NAMES if sub is None else SUBTYPE_NAMES
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind if sub is None else sub)
