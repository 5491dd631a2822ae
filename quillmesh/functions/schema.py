"""JSON-Schema rules compiled to column expressions over typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = {"date": r"^\d{4}-\d{2}-\d{2}$", "uri": r"^[a-zA-Z][a-zA-Z0-9+.-]*:.+"}


def rules(value: Column, schema: dict, path: str = "$", root: dict | None = None) -> list[tuple[str, str, Column]]:
    """(code, path, broken) for each keyword that a value of a typed column can break.

    References are local. Types are the column's own, so `type` only tells null from not null;
    unknown keywords are ignored. An object's properties are fields of a struct. One of
    `oneOf` must hold and no other.
    """
    root = root or schema
    if ref := schema.get("$ref"):
        target = root
        for step in ref.removeprefix("#/").split("/"):
            target = target[step]
        return rules(value, target, path, root)
    if options := schema.get("oneOf"):
        fits = [~_any(rules(value, o, path, root)) for o in options]
        count = F.lit(0)
        for fit in fits:
            count = count + fit.cast("int")
        return [("one_of", path, count != 1)]
    out: list[tuple[str, str, Column]] = []
    add = lambda code, broken: out.append((code, path, F.coalesce(broken, F.lit(False))))
    kinds = schema.get("type")
    if kinds:
        named = {kinds} if isinstance(kinds, str) else set(kinds)
        if named == {"null"}:
            add("type", value.isNotNull())
        elif "null" not in named:
            add("type", value.isNull())
    if "const" in schema:
        add("const", ~value.eqNullSafe(F.lit(schema["const"])))
    if "enum" in schema:
        add("enum", ~value.isin(*schema["enum"]))
    for key, broken in (
        ("minLength", lambda n: F.length(value) < n),
        ("maxLength", lambda n: F.length(value) > n),
        ("pattern", lambda p: ~value.rlike(p)),
        ("minimum", lambda n: value < n),
        ("maximum", lambda n: value > n),
        ("minItems", lambda n: F.size(value) < n),
        ("minProperties", lambda n: F.size(value) < n),
        ("uniqueItems", lambda on: (F.size(F.array_distinct(value)) < F.size(value)) & F.lit(on)),
    ):
        if key in schema:
            add(key, broken(schema[key]))
    if (form := schema.get("format")) in _FORMATS:
        bad = ~value.rlike(_FORMATS[form])
        if form == "date":
            bad = bad | F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).isNull()
        add("format", bad)
    if "items" in schema and schema["items"]:
        add("items", F.exists(value, lambda x: _any(rules(x, schema["items"], f"{path}[]", root))))
    if isinstance(more := schema.get("additionalProperties"), dict) and "properties" not in schema:
        add("additionalProperties", F.exists(F.map_values(value), lambda x: _any(rules(x, more, f"{path}.*", root))))
    required = schema.get("required", ())
    for name, sub in schema.get("properties", {}).items():
        field = value.getField(name)
        if name in required:
            out.append(("required", f"{path}.{name}", F.coalesce(value.isNotNull() & field.isNull(), F.lit(False))))
        out += [(code, at, field.isNotNull() & broken) for code, at, broken in rules(field, sub, f"{path}.{name}", root) if code != "type"]
    return out


def _any(found: list[tuple[str, str, Column]]) -> Column:
    out = F.lit(False)
    for _, _, broken in found:
        out = out | broken
    return out


def issues(value: Column, schema: dict) -> Column:
    """array<struct<code, path>>: what a value breaks."""
    return F.array_compact(F.array(*(F.when(broken, F.struct(F.lit(code).alias("code"), F.lit(at).alias("path"))) for code, at, broken in rules(value, schema))))
