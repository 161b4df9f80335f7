"""Categories, provinces, traits and legal rank from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta import refdata as R
from statuta.functions.text import normalize_province, py_strip


def category_of_title(title: Column) -> Column:
    low, out = F.lower(title), None
    for word, category in R.CATEGORY_KEYWORDS:
        out = (F if out is None else out).when(F.contains(low, F.lit(word)), category)
    return out.otherwise(R.DEFAULT_CATEGORY)


def is_tagged(legal_area: Column) -> Column:
    return F.coalesce((legal_area != "") & (legal_area != R.UNCLASSIFIED), F.lit(False))


def category(title: Column, legal_area: Column, override: Column | None = None) -> Column:
    """An override decides if there is one; a value that is no category gives the default."""
    own = category_of_title(F.when(is_tagged(legal_area), F.concat_ws(" ", legal_area, title)).otherwise(title))
    out = own if override is None else F.coalesce(F.nullif(override, F.lit("")), own)
    return F.when(out.isin(R.CATEGORIES), out).otherwise(R.DEFAULT_CATEGORY)


def province(authority: Column) -> Column:
    return F.nullif(py_strip(F.regexp_extract(authority, r"(?iuU)(?:tỉnh|thành\s*phố)\s+(.+)$", 1)), F.lit(""))


def province_scope(scope: Column, authority: Column) -> Column:
    return F.when(scope == "dia_phuong", province(authority))


def rank_of(doc_type: Column, scope: Column) -> Column:
    out = F.when((doc_type == "nghi_quyet") & (scope == "trung_uong"), R.CENTRAL_RESOLUTION_RANK)
    for rank in sorted(set(R.INSTRUMENT_RANK.values())):
        out = out.when(doc_type.isin([k for k, v in R.INSTRUMENT_RANK.items() if v == rank]), rank)
    return out.otherwise(R.UNRANKED)


def is_ranked(doc_type: Column) -> Column:
    return F.coalesce(doc_type.isin(list(R.INSTRUMENT_RANK)), F.lit(False))


def more_authoritative(type_a: Column, scope_a: Column, type_b: Column, scope_b: Column) -> Column:
    return rank_of(type_a, scope_a) < rank_of(type_b, scope_b)


def in_jurisdiction(scope: Column, authority: Column, user_province: Column, include_national: Column | None = None) -> Column:
    """Central law where national law is asked for; provincial law whose authority names the province; nothing else."""
    named = F.contains(F.lower(authority), normalize_province(user_province))
    return F.coalesce(F.when(scope == "trung_uong", F.lit(True) if include_national is None else include_national).when(scope == "dia_phuong", named), F.lit(False))


def legal_area_boost(legal_area: Column, keywords: Column) -> Column:
    hit = F.exists(keywords, lambda k: (k != "") & F.contains(F.lower(legal_area), F.lower(k)))
    return F.when(is_tagged(legal_area) & F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)


def entity_visible(chunk_type: Column, user_type: Column) -> Column:
    own = F.coalesce(chunk_type, F.lit("both"))
    return (own == "both") | (own == user_type)


def province_visible(scope: Column, user_province: Column) -> Column:
    """National law always; provincial law only in the user's own province."""
    own = F.coalesce(scope, F.lit("national"))
    return (own == "national") | F.coalesce(own == user_province, F.lit(False))


def traits(p: str = "") -> Column:
    """Tags of a profile with the rule that gave each; of equal tags the first rule counts."""
    c = lambda name: F.col(p + name)
    tag = lambda when, value, rule: F.when(when, F.struct(value.alias("tag"), F.lit(rule).alias("source_rule")))
    given = lambda name: F.coalesce(c(name) != "", F.lit(False))
    owner = F.coalesce(c("has_business"), F.lit(False))
    every = F.array_compact(F.array(
        tag(given("occupation_type"), c("occupation_type"), "occupation"),
        tag(owner, F.lit("small_business_owner"), "business_owner"),
        tag(owner & given("business_sector"), F.concat(F.lit("business_sector_"), c("business_sector")), "business_owner"),
        tag(F.coalesce(c("dependents"), F.lit(0)) > 0, F.lit("has_dependents"), "dependents"),
        tag(given("marital_status"), F.concat(F.lit("marital_"), c("marital_status")), "marital_status"),
        tag(F.coalesce(c("owns_property"), F.lit(False)), F.lit("property_owner"), "owns_property"),
        tag(F.coalesce(c("owns_vehicle"), F.lit(False)), F.lit("vehicle_owner"), "owns_vehicle"),
        tag(given("province"), F.concat(F.lit("resident_of_"), c("province")), "province"),
    ))
    return F.filter(every, lambda x, i: ~F.exists(F.slice(every, 1, i), lambda y: y["tag"] == x["tag"]))


def entity_type(tags: Column) -> Column:
    return F.when(F.array_contains(tags, "small_business_owner"), "business").otherwise("individual")
