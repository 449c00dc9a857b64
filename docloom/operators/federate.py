"""Rows of external sources: mapped from their JSON, united and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["title", "citation", "summary", "url", "date", "source_name", "source_level", "jurisdiction", "metadata"]
LEVEL_RANK = {"authority_verified": 0, "auxiliary_db": 1, "internal_template": 2, "model_inference": 3}

#: Paths within one result object; several are tried in turn.  ``items`` is the path of the list.
CONNECTORS = {
    "yuandian": {"items": "$.data", "title": ["$.title", "$.ftmc"], "citation": ["$.fgmc"], "summary": ["$.content", "$.llm_content"], "date": ["$.fbrq"], "jurisdiction": "china_mainland"},
    "pkulaw": {"items": "$.result.content", "title": ["$.title"], "citation": ["$.citation"], "summary": ["$.summary"], "date": ["$.date"], "jurisdiction": "china_mainland"},
    "qcc": {"items": "$.result.content", "title": ["$.name", "$.企业名称"], "citation": ["$.credit_code", "$.creditCode", "$.统一社会信用代码"], "summary": ["$.business_scope", "$.经营范围"], "date": ["$.founded", "$.成立日期"], "jurisdiction": "china_mainland"},
    "fyopen": {"items": "$.data", "title": ["$.title"], "citation": ["$.citation"], "summary": ["$.summary"], "date": ["$.date"], "jurisdiction": "china_mainland"},
    "courtlistener": {"items": "$.results", "title": ["$.caseName"], "citation": ["$.citation[0].cite", "$.citation[0]"], "summary": ["$.snippet"], "date": ["$.dateFiled"], "jurisdiction": "united_states"},
    "sec_edgar": {"items": "$.hits.hits", "title": ["$._source.display_names[0]"], "citation": ["$._source.adsh"], "summary": ["$._source.form_type"], "date": ["$._source.file_date"], "jurisdiction": "united_states"},
    "gleif": {"items": "$.data", "title": ["$.attributes.entity.legalName.name"], "citation": ["$.id"], "summary": ["$.attributes.entity.legalAddress.country"], "date": ["$.attributes.registration.initialRegistrationDate"], "jurisdiction": "$.attributes.entity.legalAddress.country"},
    "firecrawl": {"items": "$.data", "title": ["$.title"], "citation": [], "summary": ["$.description"], "date": [], "jurisdiction": "?"},
    "vaquill": {"items": "$.results", "title": ["$.title"], "citation": ["$.id"], "summary": ["$.snippet"], "date": ["$.date"], "jurisdiction": "united_states"},
    "eur_lex": {"items": "$.results.bindings", "title": ["$.title.value"], "citation": ["$.celex.value"], "summary": [], "date": [], "jurisdiction": "european_union", "level": "authority_verified"},
    "opencorporates": {"items": "$.results.companies", "title": ["$.company.name"], "citation": ["$.company.company_number"], "summary": ["$.company.registered_address.country"], "date": ["$.company.incorporation_date"], "jurisdiction": "$.company.jurisdiction_code"},
}


def parsed(raw: DataFrame, connector: str, json_col: str = "body", asked: str | None = None) -> DataFrame:
    """Result rows of one connector's responses.

    A response that is no JSON, or has no list, gives none; so does a result without a title, and
    a response that says it had no success.  An item that is a text part with JSON in it (an
    object or a list of them) stands for what is in the text.
    """
    spec = CONNECTORS[connector]
    items = F.from_json(F.get_json_object(json_col, spec["items"]), "array<string>")
    pick = lambda paths: F.coalesce(*[F.get_json_object("item", p) for p in paths], F.lit(None).cast("string"))
    where = spec["jurisdiction"]
    place = F.get_json_object("item", where) if where.startswith("$") else F.lit(asked if where == "?" else where).cast("string")
    went_well = F.coalesce(F.get_json_object(json_col, "$.success"), F.lit("true")) != "false"
    text = lambda x: F.trim(F.get_json_object(x, "$.text"))
    inner = lambda x: F.when(text(x).startswith("["), F.from_json(text(x), "array<string>")).when(text(x).startswith("{"), F.array(text(x)))
    rows = raw.where(went_well).select(F.posexplode(F.flatten(F.transform(items, lambda x: F.coalesce(inner(x), F.array(x))))).alias("pos", "item"))
    out = rows.select("pos", *[pick(spec[c]).alias(c) for c in ("title", "citation", "summary", "date")], pick(["$.url", "$.absolute_url", "$.link"]).alias("url"), F.lit(connector).alias("source_name"), F.lit(spec.get("level", "auxiliary_db")).alias("source_level"), place.alias("jurisdiction"), F.col("item").alias("metadata"))
    return out.where("title is not null and title != ''").select(*COLUMNS, "pos")


def level_rank(level: Column) -> Column:
    out = None
    for name, rank in LEVEL_RANK.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out.otherwise(4)


def federated(parts: list[DataFrame]) -> DataFrame:
    """All results with ``rank``: by source level, then in the order of sources and results."""
    numbered = [p.withColumn("source_order", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b), numbered)
    return rows.withColumn("level_rank", level_rank(F.col("source_level"))).orderBy("level_rank", "source_order", "pos")


def registry(rows: DataFrame, region: str | None = None, priority: str | None = None, implemented: bool | None = None, needs_credentials: bool | None = None) -> DataFrame:
    out = rows
    for col, value in (("region", region), ("priority", priority), ("implemented", implemented)):
        out = out.where(F.col(col) == value) if value is not None else out
    if needs_credentials is not None:
        out = out.where((~F.col("implemented") & ~F.col("auth").isin("free", "none")) == needs_credentials)
    return out
