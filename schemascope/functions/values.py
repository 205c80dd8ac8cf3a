"""Recognising what a value in a question stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date literals and the phrases for them.
DATE_LITERALS = [
    "TODAY", "YESTERDAY", "TOMORROW", "LAST_WEEK", "THIS_WEEK", "NEXT_WEEK", "LAST_MONTH", "THIS_MONTH", "NEXT_MONTH",
    "LAST_QUARTER", "THIS_QUARTER", "NEXT_QUARTER", "LAST_YEAR", "THIS_YEAR", "NEXT_YEAR", "LAST_90_DAYS", "NEXT_90_DAYS", "LAST_N_DAYS", "NEXT_N_DAYS",
]
DATE_PHRASES = {p.lower().replace("_", " "): p for p in ["TODAY", "YESTERDAY", "TOMORROW", "THIS_WEEK", "LAST_WEEK", "NEXT_WEEK", "THIS_MONTH", "LAST_MONTH", "NEXT_MONTH", "THIS_QUARTER", "LAST_QUARTER", "NEXT_QUARTER", "THIS_YEAR", "LAST_YEAR", "NEXT_YEAR"]}
# Priority and status words.
PRIORITIES = {"high": "High", "medium": "Medium", "low": "Low", "critical": "Critical", "urgent": "Urgent", "highest": "Highest", "lowest": "Lowest", "normal": "Normal"}
STATUSES = {"open": "Open", "closed": "Closed", "new": "New", "active": "Active", "inactive": "Inactive", "pending": "Pending", "in progress": "In Progress"}
# Weights of a category's objects when values are grounded.
CATEGORY_WEIGHTS = {
    "business_core": 1.0, "business_extended": 0.9, "system": 0.3, "system_derived": 0.3, "managed_package": 0.7,
    "custom_metadata": 0.4, "platform_event": 0.2, "external_object": 0.6, "big_object": 0.6,
}
DEFAULT_WEIGHT = 0.8
# What a kind of value filters on: (type, template, fields).
FILTERS = {
    "salesforce_id": ("id_reference", "Id = '%s'", ["Id"]),
    "date_literal": ("date_reference", "CreatedDate = %s", ["CreatedDate", "CloseDate", "LastModifiedDate"]),
    "date_value": ("date_reference", "CreatedDate = %s", ["CreatedDate", "CloseDate", "LastModifiedDate"]),
    "currency_value": ("numeric_value", "Amount >= %s", ["Amount", "AnnualRevenue", "ExpectedRevenue"]),
    "numeric_value": ("numeric_value", "Amount >= %s", ["Amount", "AnnualRevenue", "ExpectedRevenue"]),
    "email_address": ("field_reference", "Email = '%s'", ["Email"]),
    "phone_number": ("field_reference", "Phone LIKE '%%%s%%'", ["Phone", "MobilePhone"]),
    "url": ("field_reference", "Website = '%s'", ["Website"]),
    "priority_value": ("priority_value", "Priority = '%s'", ["Priority"]),
    "status_value": ("status_value", "Status = '%s'", ["Status", "StageName"]),
}


def lookup(table: dict, key: Column, kind: str = "string") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key).cast(kind)


def number_text(x: Column) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(F.format_string("%.6f", x), "\\.?0+$", "")


def pattern(value: Column) -> Column:
    """struct(kind, normalised, confidence) of the first pattern that fits, else null.

    An id needs a digit, so that long plain words aren't ids.
    """
    v = F.trim(value)
    low, up, digits = F.lower(v), F.upper(v), F.regexp_replace(v, "\\D", "")
    plain = F.regexp_extract(v, "^(\\d+(?:\\.\\d+)?)\\s*([kKmMbB])?$", 1).try_cast("double")
    scale = F.lower(F.regexp_extract(v, "^(\\d+(?:\\.\\d+)?)\\s*([kKmMbB])?$", 2))
    number = plain * F.when(scale == "k", 1e3).when(scale == "m", 1e6).when(scale == "b", 1e9).otherwise(1.0)

    def hit(kind: str, normalised: Column, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), normalised.alias("normalised"), F.lit(confidence).alias("confidence"))

    return (
        F.when(v.rlike("^[a-zA-Z0-9]{15}([a-zA-Z0-9]{3})?$") & v.rlike("\\d"), hit("salesforce_id", v, 0.95))
        .when(up.isin(*DATE_LITERALS), hit("date_literal", up, 0.98))
        .when(low.isin(*DATE_PHRASES), hit("date_literal", lookup(DATE_PHRASES, low), 0.95))
        .when(v.rlike("^\\d{4}-\\d{2}-\\d{2}$"), hit("date_value", v, 0.95))
        .when(v.rlike("^\\$?[\\d,]+(\\.\\d{2})?$") & v.rlike("\\d"), hit("currency_value", number_text(F.regexp_replace(v, "[$,]", "").try_cast("double")), 0.9))
        .when(plain.isNotNull(), hit("numeric_value", number_text(number), 0.9))
        .when(v.rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"), hit("email_address", low, 0.95))
        .when(v.rlike("^[\\d\\s\\-+().]{7,}$") & (F.length(digits) >= 7), hit("phone_number", digits, 0.85))
        .when(v.rlike("(?i)^https?://.+"), hit("url", v, 0.95))
        .when(low.isin(*PRIORITIES), hit("priority_value", lookup(PRIORITIES, low), 0.9))
        .when(low.isin(*STATUSES), hit("status_value", lookup(STATUSES, low), 0.85))
    )


def suggested_filter(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, (_, template, _) in FILTERS.items():
        shown = F.substring(found["normalised"], -10, 10) if kind == "phone_number" else found["normalised"]
        out = F.when(found["kind"] == kind, F.format_string(template, shown)).otherwise(out)
    return out


def grounding_type(found: Column) -> Column:
    return lookup({k: v[0] for k, v in FILTERS.items()}, found["kind"])


def category_weight(kind: Column) -> Column:
    return F.coalesce(lookup(CATEGORY_WEIGHTS, kind, "double"), F.lit(DEFAULT_WEIGHT))


def value_type(value: Column) -> Column:
    plain = F.upper(F.split(value, ":")[0])
    literal = plain.isin(*DATE_LITERALS) | plain.rlike("^(LAST|NEXT)_N_(DAYS|WEEKS|MONTHS|QUARTERS|YEARS)$")
    return F.when(value.try_cast("double").isNotNull(), "number").when(F.lower(value).isin("true", "false"), "boolean").when(literal, "date").otherwise("string")


def multiplier(suffix: Column) -> Column:
    s = F.lower(F.trim(suffix))
    return F.when(s.isin("k", "thousand"), 1e3).when(s.isin("m", "million"), 1e6).when(s.isin("b", "billion"), 1e9).otherwise(1.0)


def fallback_entity(value: Column) -> Column:
    """struct(kind, confidence) by simple rules, where nothing can be grounded."""
    number = value.rlike("^\\$?\\d+(,\\d{3})*(\\.\\d{2})?[kKmM]?$")
    phrases = [p for p in DATE_PHRASES if p not in ("next quarter", "next year")]
    rules = [(F.lower(value).isin(*phrases), "date_reference", 0.95), (number, "numeric_value", 0.95), (value.rlike("^[a-zA-Z0-9]{15}([a-zA-Z0-9]{3})?$"), "object_reference", 0.95), (value.rlike("^[A-Z][a-z]+(\\s+[A-Z][a-z]+)*$"), "unknown", 0.5)]
    out = F.struct(F.lit("unknown").alias("kind"), F.lit(0.3).alias("confidence"))
    for fits, kind, score in reversed(rules):
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("confidence"))).otherwise(out)
    return out
