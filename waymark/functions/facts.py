"""Values of open records: typed columns, and dotted paths into a VARIANT, with comparisons that depend on a value's own type."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The column that holds an entity's open facts.
FACTS = "core_facts"
#: Texts that count as numbers where a text meets a number.
NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


@dataclass
class Value:
    """A value with its own type: kind is number, text, bool, list, other, null or missing."""

    kind: Column
    number: Column
    text: Column
    shown: Column
    items: Column  # the elements of a list, as (kind, number, text)


def _as_number(kind: Column, number: Column, text: Column) -> Column:
    """What a value is in a comparison with a number: a truth value is 0 or 1, an empty text and null are 0; null if it is none."""
    of_text = F.when(F.trim(text) == "", 0.0).when(text.rlike(NUMBER), F.expr("double(0)") + F.trim(text).try_cast("double"))
    return F.when(kind.isin("number", "bool"), number).when(kind == "text", of_text).when(kind == "null", 0.0)


def _kind_of_variant(x: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0)
    return (
        F.when(x.isNull(), "missing").when(F.is_variant_null(x), "null").when(name.isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "number").when(name == "STRING", "text")
        .when(name == "BOOLEAN", "bool").when(name == "ARRAY", "list").otherwise("other")
    )


def _number_of_variant(kind: Column, x: Column) -> Column:
    return F.when(kind == "number", F.try_variant_get(x, "$", "double")).when(kind == "bool", F.try_variant_get(x, "$", "boolean").cast("double"))


def _text_of_variant(kind: Column, x: Column) -> Column:
    return F.when(kind == "text", F.try_variant_get(x, "$", "string"))


def _shown_of_variant(kind: Column, x: Column) -> Column:
    return F.when(kind.isin("missing", "null"), "").otherwise(F.try_variant_get(x, "$", "string"))


def _items_of_variant(kind: Column, x: Column) -> Column:
    return F.when(kind == "list", F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: _item(_of_variant(y))))


def _of_variant(x: Column) -> tuple[Column, Column, Column]:
    """(kind, number, text) of a VARIANT."""
    kind = _kind_of_variant(x)
    return kind, _number_of_variant(kind, x), _text_of_variant(kind, x)


def _of_column(x: Column, of: T.DataType) -> tuple[Column, Column, Column]:
    """(kind, number, text) of a typed value; dates are texts."""
    none = F.lit(None)
    if isinstance(of, T.NumericType):
        kind, number, text = "number", x.cast("double"), none.cast("string")
    elif isinstance(of, T.BooleanType):
        kind, number, text = "bool", x.cast("double"), none.cast("string")
    elif isinstance(of, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        kind, number, text = "text", none.cast("double"), x.cast("string")
    else:
        kind, number, text = ("list" if isinstance(of, T.ArrayType) else "other"), none.cast("double"), none.cast("string")
    return F.when(x.isNull(), "missing").otherwise(kind), number, text


def _item(parts: tuple[Column, Column, Column]) -> Column:
    return F.struct(*(p.alias(n) for p, n in zip(parts, ("kind", "number", "text"), strict=True)))


NO_ITEMS = "array<struct<kind:string,number:double,text:string>>"


def _path(field: str) -> list[str]:
    """The paths that a dotted name may mean: a number is a place in a list, or a name."""
    if "'" in field or "\\" in field:
        return []
    steps = [[f"[{int(x)}]", f"['{x}']"] if x.isdigit() and len(x) < 9 else [f"['{x}']"] for x in field.split(".")]
    return ["$" + "".join(p) for p in product(*steps)]


def value_of(rows: DataFrame, field: str, column_first: bool = False, found: dict[str, str] | None = None) -> Value:
    """The value of a field of rows: a path into the open facts if rows have them, else the column of that name; what is in neither
    is missing. column_first prefers a column, as orders do. found names columns that hold what lies on paths."""
    typed = {f.name: f.dataType for f in rows.schema}
    if FACTS in typed and not (column_first and field in typed and field != FACTS):
        at = [F.col(found[p]) if found else F.try_variant_get(F.col(FACTS), p, "variant") for p in _path(field)]
        x = F.coalesce(*at) if at else F.lit(None).cast("variant")
        kind, number, text = _of_variant(x)
        return Value(kind, number, text, _shown_of_variant(kind, x), _items_of_variant(kind, x))
    if field not in typed:
        none = F.lit(None)
        return Value(F.lit("missing"), none.cast("double"), none.cast("string"), F.lit(""), none.cast(NO_ITEMS))
    x, of = F.col(field), typed[field]
    kind, number, text = _of_column(x, of)
    if isinstance(of, T.ArrayType):
        items = F.transform(x, lambda y: _item(_of_column(y, of.elementType)))
        return Value(kind, number, text, F.to_json(x), items)
    return Value(kind, number, text, F.coalesce(F.to_json(x) if isinstance(of, (T.StructType, T.MapType)) else x.cast("string"), F.lit("")), F.lit(None).cast(NO_ITEMS))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row, however many expressions and filters use them: an exploded list of one, which the
    optimizer moves no expression across."""
    if not columns:
        return rows
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.explode(F.array(made)).alias("_once")).select("*", *(F.col(f"_once.{n}").alias(n) for n in columns)).drop("_once")


def values_of(rows: DataFrame, wanted: Iterable[tuple[str, bool]], looked_into: Collection[str] | None = None) -> tuple[DataFrame, dict[tuple[str, bool], Value]]:
    """rows with the values of fields, each computed once, and those values by (field, column_first). Typed columns are values as they are. What lies
    on a path is found once, then its kind, then the parts that rest on the kind; elements are made for the fields that are looked into, if these are given."""
    wanted = list(wanted)
    typed = {f.name for f in rows.schema}
    is_open = lambda f, first: FACTS in typed and not (first and f in typed and f != FACTS)
    paths = dict.fromkeys(p for f, first in wanted if is_open(f, first) for p in _path(f))
    found = {p: f"_x{i}" for i, p in enumerate(paths)}
    rows = once(rows, **{n: F.try_variant_get(F.col(FACTS), p, "variant") for p, n in found.items()})
    values = {w: value_of(rows, *w, found) for w in wanted if not is_open(*w)}
    # one field is one value, be it a fact or an order
    names = {f: f"_v{i}" for i, f in enumerate(dict.fromkeys(f for f, first in wanted if is_open(f, first)))}
    at = {n: [F.col(found[p]) for p in _path(f)] for f, n in names.items()}
    rows = rows.withColumns({n: F.coalesce(*x) if x else F.lit(None).cast("variant") for n, x in at.items()})
    rows = rows.withColumns({f"{n}_kind": _kind_of_variant(F.col(n)) for n in names.values()})
    parts = {}
    for f, n in names.items():
        x, kind, number, text, shown, items = F.col(n), *(F.col(f"{n}_{p}") for p in ("kind", "number", "text", "shown", "items"))
        parts |= {f"{n}_number": _number_of_variant(kind, x), f"{n}_text": _text_of_variant(kind, x), f"{n}_shown": _shown_of_variant(kind, x)}
        if looked_into is None or f in looked_into:
            parts[f"{n}_items"] = _items_of_variant(kind, x)
        else:
            items = F.lit(None).cast(NO_ITEMS)
        values |= {w: Value(kind, number, text, shown, items) for w in wanted if w[0] == f and is_open(*w)}
    return rows.withColumns(parts).drop(*found.values(), *names.values()), values


def _same(kind: Column, number: Column, text: Column, x) -> Column:
    """Whether a value is x: of its type as well."""
    if x is None:
        return kind == "null"
    if isinstance(x, bool):
        return (kind == "bool") & (number == float(x))
    if isinstance(x, (int, float)):
        return (kind == "number") & (number == float(x))
    return (kind == "text") & (text == F.lit(str(x)))


def _ordered(v: Value, x, by) -> Column:
    """Two texts compare as texts; else both count as numbers, and what is none satisfies nothing."""
    if isinstance(x, str):
        as_number = float(x) if x.strip() and _is_number(x) else 0.0 if not x.strip() else None
        numbers = F.lit(False) if as_number is None else by(_as_number(v.kind, v.number, v.text), F.lit(as_number))
        return F.when(v.kind == "text", by(v.text, F.lit(x))).otherwise(numbers)
    return by(_as_number(v.kind, v.number, v.text), F.lit(0.0 if x is None else float(x)))


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


def holds(v: Value, op: str, x) -> Column:
    """A predicate on a value. A missing value differs from every value and satisfies no comparison; an unknown operator is
    no restriction."""
    false = lambda c: F.coalesce(c, F.lit(False))
    same = lambda y: false(_same(v.kind, v.number, v.text, y))
    inside = F.exists(v.items, lambda y: false(_same(y["kind"], y["number"], y["text"], x)))
    made = {
        "eq": lambda: same(x), "neq": lambda: ~same(x),
        "gt": lambda: false(_ordered(v, x, lambda a, b: a > b)), "gte": lambda: false(_ordered(v, x, lambda a, b: a >= b)),
        "lt": lambda: false(_ordered(v, x, lambda a, b: a < b)), "lte": lambda: false(_ordered(v, x, lambda a, b: a <= b)),
        "in": lambda: F.lit(False) if isinstance(x, str) or not hasattr(x, "__iter__") else F.coalesce(*(F.when(same(y), True) for y in x), F.lit(False)),
        "contains": lambda: F.when(v.kind == "list", false(inside)).otherwise(F.contains(F.coalesce(v.shown, F.lit("")), F.lit(_shown(x)))),
    }
    return made.get(op, lambda: F.lit(True))()


def _shown(x) -> str:
    return ("true" if x else "false") if isinstance(x, bool) else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)


def sort_keys(v: Value, descending: bool) -> dict[str, Column]:
    """Keys by which ascending columns put rows in the order of v: numbers and truth values before texts before all else, that
    reversed if descending, and missing and null values last both ways. Rows of ascending and descending orders may be ranked by the same keys, but
    for `down`, which is a text to be sorted downwards."""
    kind = F.when(v.kind.isin("number", "bool"), 0).when(v.kind == "text", 1).when(v.kind.isin("missing", "null"), None).otherwise(2)
    text = F.when(v.kind == "text", v.text).when(v.kind.isin("list", "other"), v.shown)
    none = F.lit(None).cast("string")
    return {"kind": -kind if descending else kind, "number": -v.number if descending else v.number, "up": none if descending else text, "down": text if descending else none}
