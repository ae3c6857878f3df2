"""Declared schemas of the directory's collections: rules as data, checked in one scan.

A schema is a tuple of fields; a check gives one issue (path, problem) for each rule that a record breaks, nested items
by their position. Records without an issue may be written, cut down to the declared fields; the others go to quarantine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field and its rules. kind: text, number, list (of texts, or of records where items are given), record or any."""

    name: str
    kind: str = "text"
    required: bool = True
    least: int = 0  # characters of a text, items of a list
    most: int | None = None
    pattern: str | None = None
    choice: tuple[str, ...] = ()
    url: bool = False
    low: float | None = None
    high: float | None = None
    items: tuple[Field, ...] = ()


def text(name: str, **rules) -> Field:
    return Field(name, **{"least": 1, **rules})


def optional(name: str, **rules) -> Field:
    return text(name, required=False, **rules)


def texts(name: str) -> Field:
    return Field(name, "list", required=False)


# fixed values: the collections' fields, formats, choices and bounds
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"
STATUSES = ("active", "draft", "needs_review", "archived")
SOURCE_KINDS = ("official", "registration_platform", "aggregator", "review", "social", "other")
CONFIDENCES = ("high", "medium", "low")
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains")

FAQS = Field("faqs", "list", required=False, items=(text("question"), text("answer")))
QUOTE = (text("quote", most=400), text("attribution"), Field("source_url", required=False, url=True))
SCORES = (
    Field("overall", "number", low=0, high=100),
    Field("breakdown", "list", required=False, items=(text("label"), Field("score", "number", low=0, high=100))),
)
DATED = (text("last_updated"), Field("status", choice=STATUSES))
SECTIONS = Field("sections", "list", least=1, items=(text("heading"), Field("paragraphs", "list", least=1)))
CITED = (Field("n", "number", low=1), text("label"), optional("publisher"), Field("url", url=True), Field("type", required=False, choice=(*SOURCE_KINDS, "news")))
EDITORIAL = (text("slug", least=0, pattern=SLUG), text("title"), optional("seo_title", most=70), optional("meta_description", most=200), text("topic"), text("dek"), SECTIONS)

ENTITY = (
    text("entity_id"), text("slug", least=0, pattern=SLUG), text("name"), text("category_id"), text("region_id"), text("short_description", most=220), text("ai_summary"),
    texts("pros"), texts("cons"), Field("sentiment_scores", "record", required=False, items=SCORES), Field("excerpt_quotes", "list", required=False, items=QUOTE),
    texts("research_highlights"), texts("research_watchouts"), Field("research_confidence", required=False, choice=CONFIDENCES), optional("research_last_updated"), FAQS,
    Field("reliability_score", "number", low=0, high=100), texts("tags"),
    Field("source_mix", "list", required=False, items=(Field("url", url=True), text("label"), Field("type", choice=SOURCE_KINDS), optional("last_checked"))),
    Field("affiliate_links", "list", required=False, items=(text("label"), Field("url", url=True))),
    Field("cta_links", "list", required=False, items=(text("label"), Field("url", url=True), text("type"))), texts("related_entity_ids"), *DATED,
)
CATEGORY = (text("category_id"), text("slug", least=0, pattern=SLUG), text("label"), text("short_description"), optional("intro"), texts("related_category_ids"), FAQS, *DATED)
REGION = (text("region_id"), text("slug", least=0, pattern=SLUG), text("label"), text("granularity"), Field("parent_region_id", required=False), text("short_description"), optional("intro"), FAQS, *DATED)
GUIDE = (
    text("listicle_id"), text("slug", least=0, pattern=SLUG), text("title"), text("intro"),
    Field("facts", "list", required=False, items=(text("field"), Field("op", choice=OPERATORS))), Field("sort_direction", required=False, choice=("asc", "desc")),
    Field("limit", "number", required=False, low=1), FAQS, *DATED,
)
REVIEW = (
    text("review_id"), text("slug", least=0, pattern=SLUG), text("entity_id"), text("title"), optional("seo_title", most=70), optional("meta_description", most=200), text("dek"),
    text("verdict"), Field("rating", "record", required=False, items=SCORES), SECTIONS, Field("pull_quotes", "list", required=False, items=QUOTE),
    Field("sources", "list", least=1, items=CITED), FAQS, *DATED,
)
ARTICLE = (text("article_id"), *EDITORIAL, Field("sources", "list", required=False, items=CITED), FAQS, *DATED)
PRODUCT = (text("name"), text("category"), text("why"), optional("price_range"), Field("affiliate_link", "record", items=(text("label"), Field("url", url=True))))
GEAR_ARTICLE = (*ARTICLE, Field("products", "list", required=False, items=PRODUCT))
AGENCY = (
    text("agency_id"), text("slug", least=0, pattern=SLUG), text("name"), text("country"), Field("website", url=True), text("description"),
    Field("certifications", "list", least=1, items=(text("race_name"), text("evidence"), text("source_label"), Field("source_url", url=True))),
    Field("contact_email", required=False, pattern=r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), *DATED,
)
#: Facts of each kind of directory.
FACTS = {
    "races": (
        text("date"), Field("distance_km", "list", least=1, items=(Field("", "number", low=5e-324),)), Field("elevation_gain_m", "number", required=False, low=0),
        Field("registration_status", required=False), Field("registration_deadline", required=False, pattern=ISO_DAY), Field("city", required=False), text("country"),
    ),
    "hotels": (text("address"), text("brand"), texts("elite_benefits")),
    "local-services": (texts("service_area"),),
    "courses": (text("duration"), Field("modality", choice=("online", "in-person", "hybrid")), Field("level", required=False, choice=("beginner", "intermediate", "advanced", "all-levels"))),
    "event-planning": (texts("style_tags"), text("vendor_type")),
}


def is_url(value: Column) -> Column:
    """Whether a text is a whole url."""
    return F.coalesce(value.rlike(r"^(?i)[a-z][a-z0-9+.-]*:(//[^/?#\s]+|[^/\s])\S*$"), F.lit(False))


def _issue(path: Column, problem: str) -> Column:
    return F.struct(path.alias("path"), F.lit(problem).alias("problem"))


def _value_issues(value: Column, path: Column, f: Field) -> Column:
    """The array of issues of one value."""
    there, rules = value.isNotNull(), []
    if f.kind == "text":
        if f.least:
            rules.append((F.length(value) < f.least, "empty"))
        if f.most is not None:
            rules.append((F.length(value) > f.most, "long"))
        if f.pattern:
            rules.append((~value.rlike(f.pattern), "pattern"))
        if f.choice:
            rules.append((~value.isin(*f.choice), "choice"))
        if f.url:
            rules.append((there & ~is_url(value), "url"))
    elif f.kind == "number":
        rules += [(value < f.low, "low")] if f.low is not None else []
        rules += [(value > f.high, "high")] if f.high is not None else []
    elif f.kind == "list" and f.least:
        rules.append((F.size(value) < f.least, "few"))
    if f.required:
        rules.append((~there, "required"))
    found = F.array_compact(F.array(*(F.when(bad, _issue(path, problem)) for bad, problem in rules))) if rules else None
    parts = [] if found is None else [found]
    if f.kind == "record":
        parts += [F.when(there, _issues(value, f.items, path))]
    elif f.kind == "list":
        place = lambda i: F.concat(path, F.lit("."), i.cast("string"))
        inside = f.items or (Field("", least=1),)
        each = (lambda x, i: _value_issues(x, place(i), inside[0])) if inside[0].name == "" else (lambda x, i: _issues(x, inside, place(i)))
        parts += [F.flatten(F.transform(value, each))]
    none = F.array().cast("array<struct<path:string,problem:string>>")
    return F.concat(*(F.coalesce(p, none) for p in parts)) if parts else none


def _issues(record: Column | None, fields: Sequence[Field], path: Column | None) -> Column:
    at = lambda f: F.lit(f.name) if path is None else F.concat(path, F.lit("." + f.name))
    value = lambda f: F.col(f.name) if record is None else record[f.name]
    return F.concat(*(_value_issues(value(f), at(f), f) for f in fields))


def issues(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """rows with `issues`, the array of (path, problem). Fields that the table doesn't have are missing ones."""
    absent = [f.name for f in fields if f.name not in rows.columns]
    kinds = {"text": "string", "number": "double", "list": "array<string>", "record": "string", "any": "string"}
    missing = {f.name: F.lit(None).cast(kinds[f.kind]) for f in fields if f.name in absent}
    known = [f if f.name not in absent else Field(f.name, f.kind if f.kind != "record" else "any", f.required) for f in fields]
    return rows.withColumns(missing).withColumn("issues", _issues(None, known, None)).drop(*absent)


def record_issues(record: Column, fields: Sequence[Field], names) -> Column:
    """The issues of a struct that has the fields of these names; a required field that it lacks is missing."""
    there = _issues(record, [f for f in fields if f.name in names], None)
    lost = [_issue(F.lit(f.name), "required") for f in fields if f.name not in names and f.required]
    return F.concat(there, F.array(*lost)) if lost else there


def describe(fields: Sequence[Field]) -> list[tuple[str, str, bool, str]]:
    """(field, type, required, note) of a declared schema, nested fields by dotted names; the note states the rules that a value keeps."""
    out = []
    for f in fields:
        inner = f.items[0] if f.items and f.items[0].name == "" else None
        kind = {"text": "string", "record": "object", "list": f"array of {'object' if f.items and not inner else 'number' if inner else 'string'}"}.get(f.kind, f.kind)
        if f.choice:
            kind = f"one of [{', '.join(f'"{c}"' for c in f.choice)}]"
        unit = "items" if f.kind == "list" else "characters"
        notes = [f"at least {f.least} {unit}"] if f.least else []
        notes += [f"at most {f.most} {unit}"] if f.most is not None else []
        notes += [f"matches {f.pattern}"] if f.pattern else []
        notes += ["a whole url"] if f.url else []
        notes += [f"from {f.low:g}"] if f.low is not None else []
        notes += [f"up to {f.high:g}"] if f.high is not None else []
        out.append((f.name, kind, f.required, "; ".join(notes)))
        out += [(f"{f.name}.{n}", *rest) for n, *rest in describe(() if inner else f.items)]
    return out


def accepted(rows: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ()) -> DataFrame:
    """Records without an issue, cut down to the declared fields and those to keep."""
    names = [f.name for f in fields if f.name in rows.columns]
    return issues(rows, fields).filter(F.size("issues") == 0).select(*dict.fromkeys([*names, *keep]))


def quarantined(rows: DataFrame, fields: Sequence[Field], key: str) -> DataFrame:
    """(key, path, problem) for each issue."""
    # the outer form, as an inner one filters by the list first, which is then made several times
    return issues(rows, fields).select(key, F.inline_outer("issues")).filter("path is not null")
