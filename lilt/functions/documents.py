"""Typed reading of JSON documents as variants, field by field, with the rules of the service's own models.

A value is taken in the model's type where nothing is lost: numbers and flags written as text count, whole numbers may be
written as 12.0, a flag may be 0 or 1. Unknown fields are ignored and absent ones take their default. A value of another type,
a NULL where none is allowed or an absent field without default makes the whole document invalid.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = object()


@dataclass(frozen=True)
class Field:
    """A field of a model: kind is int, float, str, bool, a list of one kind, or a model (a dictionary of fields)."""

    kind: Any
    default: Any = REQUIRED
    optional: bool = False


Model = dict[str, Field]

# Texts that count as flags.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")


def sql_type(kind: Any) -> T.DataType:
    if isinstance(kind, dict):
        return T.StructType([T.StructField(n, sql_type(f.kind)) for n, f in kind.items()])
    if isinstance(kind, list):
        return T.ArrayType(sql_type(kind[0]))
    return {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}[kind]


# The reader is built as SQL text: a model of thirty fields is one expression, parsed at once.


def _name(name: str) -> str:
    return f"`{name}`"


def _null(kind: Any) -> str:
    return f"CAST(NULL AS {sql_type(kind).simpleString()})"


def _pair(value: str, ok: str) -> str:
    return f"named_struct('v', {value}, 'ok', {ok})"


def _bound(value: str, name: str, use: str) -> str:
    """``use`` with ``value`` under a name: computed once, however often it is used."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def _scalar(value: str, kind: type) -> str:
    """Pair of a variant (a name) in its type and whether it has that type. Numbers as text and flags count as numbers."""
    get = lambda t: f"try_variant_get({value}, '$', '{t}')"
    is_a = f"schema_of_variant({value})"
    if kind is str:
        return _pair(f"CASE WHEN {is_a} = 'STRING' THEN {get('string')} END", f"{is_a} = 'STRING'")
    number = f"CASE WHEN {is_a} LIKE 'OBJECT%' OR {is_a} LIKE 'ARRAY%' THEN NULL ELSE nullif(coalesce({get('double')}, CAST({get('boolean')} AS double)), double('NaN')) END"
    if kind is float:
        return _bound(number, "n", _pair("n", "n IS NOT NULL"))
    if kind is int:
        whole = "(n IS NOT NULL AND abs(n) < 9.2e18 AND floor(n) = n)"
        exact = f"CASE WHEN {is_a} = 'BIGINT' THEN {get('bigint')} WHEN {whole} THEN CAST(n AS bigint) END"
        return _bound(number, "n", _pair(exact, whole))
    texts = [", ".join(f"'{t}'" for t in group) for group in (TRUE_TEXTS, FALSE_TEXTS)]
    text = f"lower({get('string')})"
    flag = (
        f"CASE WHEN {is_a} = 'BOOLEAN' THEN {get('boolean')} WHEN {is_a} = 'STRING' THEN CASE WHEN {text} IN ({texts[0]}) THEN true"
        f" WHEN {text} IN ({texts[1]}) THEN false END ELSE CASE {number} WHEN 1 THEN true WHEN 0 THEN false END END"
    )
    return _bound(flag, "f", _pair("f", "f IS NOT NULL"))


def typed_sql(value: str, kind: Any, depth: int = 0) -> str:
    """SQL of the pair (``v``, ``ok``): the variant ``value`` in its type, and whether it keeps to the model."""
    own = f"x{depth}"
    if isinstance(kind, dict):
        fields = ", ".join(f"'{n}', {_field(own, n, f, depth + 1)}" for n, f in kind.items())
        parts = f"p{depth}"
        v = "named_struct(" + ", ".join(f"'{n}', {parts}.{_name(n)}.v" for n in kind) + ")"
        ok = " AND ".join(f"{parts}.{_name(n)}.ok" for n in kind)
        whole = _bound(f"named_struct({fields})", parts, _pair(v, ok))
        invalid = _pair(_null(kind), "false")
        return _bound(value, own, f"CASE WHEN schema_of_variant({own}) LIKE 'OBJECT%' THEN {whole} ELSE {invalid} END")
    if isinstance(kind, list):
        items = f"transform(try_variant_get({value}, '$', 'array<variant>'), {own} -> {typed_sql(own, kind[0], depth + 1)})"
        found = f"l{depth}"
        return _bound(items, found, _pair(f"transform({found}, y -> y.v)", f"coalesce(forall({found}, y -> y.ok), false)"))
    return _bound(value, own, _scalar(own, kind))


def _default(field: Field) -> str:
    kind = sql_type(field.kind).simpleString()
    if field.default is REQUIRED or field.default is None:
        return f"CAST(NULL AS {kind})"
    plain = {True: "true", False: "false"}.get(field.default, field.default) if isinstance(field.default, bool) else field.default
    return f"CAST({'array()' if plain == [] else plain} AS {kind})"


def _field(parent: str, name: str, field: Field, depth: int) -> str:
    value = f"f{depth}"
    absent = _pair(_default(field), str(field.default is not REQUIRED).lower())
    null = _pair(_null(field.kind), str(field.optional).lower())
    read = f"CASE WHEN {value} IS NULL THEN {absent} WHEN is_variant_null({value}) THEN {null} ELSE {typed_sql(value, field.kind, depth)} END"
    return _bound(f"try_variant_get({parent}, '$.{name}', 'variant')", value, read)


# Most documents hold plain JSON values of the model's own types. Such a one is cast as a whole; the rules above, field by
# field, cost many times as much and are left to the others.

_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"
_PLAIN = {int: "BIGINT", float: _NUMBER, str: "STRING", bool: "BOOLEAN"}


def _plain_schema(kind: Any) -> str:
    """Pattern of the schemas of variants that hold plain values of the kind, besides unknown fields with scalars."""
    if isinstance(kind, dict):
        known = [f"{n}: {_plain_schema(f.kind)}" for n, f in kind.items()]
        unknown = rf"(?!(?:{'|'.join(kind)}):)[a-z_]+: (?:BOOLEAN|STRING|{_NUMBER})"
        return f"OBJECT<(?:(?:{'|'.join([*known, unknown])})(?:, |(?=>)))*>"
    return f"ARRAY<{_plain_schema(kind[0])}>" if isinstance(kind, list) else _PLAIN[kind]


def _whole(value: str, kind: Any, depth: int = 0) -> str:
    """Whether a plain value that was cast has all that the model requires, and whole numbers in reach."""
    own = f"w{depth}"
    if isinstance(kind, dict):
        parts = [f"{value}.{_name(n)} IS NOT NULL" for n, f in kind.items() if f.default is REQUIRED]
        for n, f in kind.items():
            if f.kind is int or isinstance(f.kind, (dict, list)):
                inner = _whole(f"{value}.{_name(n)}", f.kind, depth)
                parts += [f"coalesce({inner}, true)"] if inner != "true" else []
        return "(" + " AND ".join(parts or ["true"]) + ")"
    if isinstance(kind, list):
        inner = _whole(own, kind[0], depth + 1)
        return f"forall({value}, {own} -> {own} IS NOT NULL" + (f" AND {inner})" if inner != "true" else ")")
    return f"abs(CAST({value} AS double)) < 9.2e18" if kind is int else "true"


def _filled(value: str, kind: Any, depth: int = 0) -> str:
    """The value with the defaults of absent fields."""
    own = f"d{depth}"
    if isinstance(kind, dict):
        fields = []
        for n, f in kind.items():
            inner = _filled(f"{value}.{_name(n)}", f.kind, depth)
            fields.append(f"'{n}', " + (inner if f.default is REQUIRED or f.default is None else f"coalesce({inner}, {_default(f)})"))
        return f"named_struct({', '.join(fields)})"
    if isinstance(kind, list) and isinstance(kind[0], (dict, list)):
        return f"transform({value}, {own} -> {_filled(own, kind[0], depth + 1)})"
    return value


def typed(column: str, model: Model, text: str | None = None) -> Column:
    """Struct of a variant column as a document of the model (``v``) and whether it is one (``ok``).

    With the column ``text`` that the variant was read from, plain documents are cast as a whole. One with a NULL anywhere is
    not plain, as the cast can't tell a NULL from an absent field.
    """
    value = _name(column)
    slow = typed_sql(value, model)
    if text is None:
        return F.expr(slow)
    cast_whole = f"try_variant_get({value}, '$', '{sql_type(model).simpleString()}')"
    plain = f"coalesce(NOT contains({_name(text)}, 'null') AND regexp_like(schema_of_variant({value}), r'^{_plain_schema(model)}$'), false)"
    kept = f"CASE WHEN {plain} THEN {cast_whole} END"
    use = f"CASE WHEN c IS NOT NULL AND {_whole('c', model)} THEN {_pair(_filled('c', model), 'true')} ELSE {slow} END"
    return F.expr(_bound(kept, "c", use))


def default_of(model: Model) -> Column:
    return F.expr("named_struct(" + ", ".join(f"'{n}', {_default(f)}" for n, f in model.items()) + ")")
