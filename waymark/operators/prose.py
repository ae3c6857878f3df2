"""Checks on what readers see: a walk over declared schemas turns nested records of any collection into (path, text) rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.facts import once
from waymark.functions.text import CHUNK_REF, own_check, word_count
from waymark.operators import schema
from waymark.operators.linking import CITATION

PIECE = "array<struct<path:string,place:string,text:string>>"
#: A tag of a citation, closed or not.
CITE = "(?i)</?cite"
PARAGRAPH, ANSWER = "sections[].paragraphs[]", "faqs[].answer"
ENTITY_PROSE = ("ai_summary", "short_description", "pros[]", "cons[]", ANSWER)
#: The declared schema of each collection, and the places that each rule looks at.
COLLECTIONS = {
    "entity": (schema.ENTITY, {"V5.check": ENTITY_PROSE, "V7.answer": (ANSWER,)}),
    "review": (schema.REVIEW, {"V11.cite": (PARAGRAPH,), "V11.ref": (PARAGRAPH,), "V11.facets": (PARAGRAPH,), "V7.answer": (ANSWER,)}),
    "gear": (schema.GEAR_ARTICLE, {"V11.cite": (PARAGRAPH,), "V11.ref": (PARAGRAPH,), "V7.answer": (ANSWER,)}),
    "article": (schema.ARTICLE, {"V11.cite": (PARAGRAPH,), "V11.ref": (PARAGRAPH,), "V7.answer": (ANSWER,)}),
}
RULES = {
    "V5.check": ("warning", lambda t: own_check(t).isNotNull()),
    "V7.answer": ("warning", lambda t: ~word_count(t).between(30, 80)),
    "V11.cite": ("error", lambda t: t.rlike(CITE)),
    "V11.ref": ("error", lambda t: t.rlike(CHUNK_REF)),
    "V11.facets": ("warning", lambda t: F.regexp_count(t, F.lit(" · ")) >= 3),
}


def _walk(value: Column, of: T.DataType, f: schema.Field | None, path: Column, place: str):
    """The arrays of pieces of one value. A field that is declared as a list of texts holds texts; records hold what their fields do."""
    if isinstance(of, T.StringType):
        yield F.array(F.struct(path.alias("path"), F.lit(place).alias("place"), value.alias("text")))
    elif isinstance(of, T.StructType):
        yield from _fields(lambda n: value[n], of, f.items, lambda n: F.concat(path, F.lit(f".{n}")), f"{place}.")
    elif isinstance(of, T.ArrayType) and of.elementType != of:
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        inner = of.elementType
        if any(True for _ in _walk(F.lit(None), inner, f, F.lit(""), place)):
            each = F.transform(value, lambda x, i: F.concat(*_walk(x, inner, f, at(i), f"{place}[]")))
            yield F.coalesce(F.flatten(each), F.array().cast(PIECE))


def _fields(value, of: T.StructType, fields: Sequence[schema.Field], path, before: str):
    typed = {x.name: x.dataType for x in of}
    for f in fields:
        if f.name in typed:
            yield from _walk(value(f.name), typed[f.name], f, path(f.name), before + f.name)


def pieces(rows: DataFrame, fields: Sequence[schema.Field]) -> Column:
    """The array of (path, place, text) of all declared texts of a record, at any depth, in the order of the schema: path is where a text
    stands (`faqs[1].answer`), place the same without numbers. Fields that the table lacks, or has as something else, hold none."""
    found = list(_fields(F.col, rows.schema, fields, F.lit, ""))
    return F.filter(F.concat(*found), lambda p: p["text"].isNotNull()) if found else F.array().cast(PIECE)


def texts(rows: DataFrame, fields: Sequence[schema.Field], key: str) -> DataFrame:
    """(key, path, place, text) rows; one generator, whatever the nesting."""
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(pieces(rows, fields)).alias("p")).select("key", "p.*")


def _cited(text: Column) -> Column:
    """The numbers that a text cites, as often as it does."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("long"))))


def violations(rows: DataFrame, collection: str, key: str) -> DataFrame:
    """(collection, key, path, rule, severity, detail) of the records of one collection: every rule on every text it looks at, in one pass over the
    rows. Where records have sources, each citation that names none is an error, and each source that no paragraph cites a warning."""
    fields, places = COLLECTIONS[collection]
    issue = lambda path, rule, severity, detail: F.struct(
        path.alias("path"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")
    )
    none = F.lit(None).cast("string")
    rules = [(r, *RULES[r], seen) for r, seen in places.items()]
    broken = lambda p: F.array_compact(
        F.array(*(F.when(p["place"].isin(*seen) & bad(p["text"]), issue(p["path"], rule, severity, none)) for rule, severity, bad, seen in rules))
    )
    held = once(rows, _pieces=pieces(rows, fields)).select(F.col(key).cast("string").alias("key"), F.col("_pieces").alias("pieces"), *(["sources"] if "sources" in rows.columns else []))
    found = [F.flatten(F.transform("pieces", broken))]
    if "sources" in rows.columns:
        numbers = F.coalesce(F.transform("sources", lambda s: s["n"].cast("long")), F.array().cast("array<bigint>"))
        paragraphs = F.filter("pieces", lambda p: p["place"] == PARAGRAPH)
        lost = F.transform(paragraphs, lambda p: F.transform(F.filter(_cited(p["text"]), lambda n: ~F.array_contains(numbers, n)), lambda n: issue(p["path"], "V12.unresolved", "error", n)))
        cited = F.flatten(F.transform(paragraphs, lambda p: _cited(p["text"])))
        silent = F.filter(F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: ~F.array_contains(cited, s["n"]))
        at = lambda s: F.concat(F.lit("sources["), s["i"].cast("string"), F.lit("]"))
        found += [F.flatten(lost), F.transform(silent, lambda s: issue(at(s), "V12.uncited", "warning", s["n"]))]
    # the outer form, as an inner one filters by the list first, which is then made several times
    return held.select(F.lit(collection).alias("collection"), "key", F.inline_outer(F.concat(*found))).filter("rule is not null")


def all_violations(collections: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """violations of several collections, by name: (records, key)."""
    return reduce(DataFrame.unionByName, (violations(rows, name, key) for name, (rows, key) in collections.items()))
