"""JSON Schema as expressions: a schema is compiled, when the plan is made, to Columns over open JSON (VARIANT).

Every keyword becomes a test at a path, all in the document's row, so checking needs no shuffle and
no validator on the executors. Alternatives (``oneOf``, ``anyOf``, ``if``) are counted at their path.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "array<struct<path:string,keyword:string,keys:array<string>>>"
#: Objects with keys to strip in one answer at most; beyond, it stays as it is.
MOST_STRIPPED = 50
#: A schema may refer to itself so many levels deep.
DEPTH = 24


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _members(v: Column) -> Column:
    """The values of an object by key; null for anything else."""
    return _as(v, "map<string,variant>")


def _items(v: Column) -> Column:
    return _as(v, "array<variant>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _read(v: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value with what it has as an object and as an array."""
    return _let(F.struct(v.alias("v"), _members(v).alias("members"), _items(v).alias("items")), body)


def _kind(x: Column) -> Column:
    """The JSON type: object, array, string, integer, number, boolean or null."""
    v = x["v"]
    scalar = F.schema_of_variant(v)
    number = _as(v, "double")
    whole = F.when(number == F.floor(number), "integer").otherwise("number")
    plain = F.when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").when(scalar.isin("VOID", "NULL"), "null").otherwise(whole)
    return F.when(x["members"].isNotNull(), "object").when(x["items"].isNotNull(), "array").otherwise(plain)


def _error(test: Column, path: Column, keyword: str, keys: Column | None = None) -> Column:
    """A list of one error where ``test`` is true, else an empty one."""
    none = F.array().cast(ERROR)
    one = F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), (F.array().cast("array<string>") if keys is None else keys).alias("keys"))
    return F.when(F.coalesce(test, F.lit(False)), F.array(one).cast(ERROR)).otherwise(none)


def _resolved(schema: dict, root: dict) -> dict:
    """A schema with its reference followed; keywords beside it hold as well."""
    if "$ref" not in schema:
        return schema
    target = root
    for part in schema["$ref"].removeprefix("#").strip("/").split("/"):
        target = target[part.replace("~1", "/").replace("~0", "~")] if part else target
    rest = {k: v for k, v in schema.items() if k != "$ref"}
    target = _resolved(target, root)
    return {"allOf": [target, rest]} if rest.keys() - {"title", "description"} else target


def errors(v: Column, schema: dict, root: dict | None = None, path: Column | None = None, depth: int = 0) -> Column:
    """What the schema finds in ``v`` (VARIANT): ``array<struct<path, keyword, keys>>``.

    Paths are JSON pointers; ``keys`` are those that ``required`` misses and ``additionalProperties`` refuses, and for ``enum`` and ``const`` what is allowed, as JSON. All
    errors are found, not the first alone. Keywords: type, enum, const, required, properties, additionalProperties, minProperties,
    items, minItems, maxItems, uniqueItems, minLength, maxLength, pattern, format (date), minimum, maximum, exclusiveMinimum,
    exclusiveMaximum, allOf, anyOf, oneOf, not, if with then and else, and references within the schema. A null document has null errors.
    """
    root = schema if root is None else root
    path = F.lit("") if path is None else path
    if depth > DEPTH:
        raise ValueError("the schema refers to itself")
    schema = _resolved(schema, root)
    found = _read(v, lambda x: _found(x, schema, root, path, depth))
    return found if depth else F.when(v.isNotNull(), found)


def _found(x: Column, schema: dict, root: dict, path: Column, depth: int) -> Column:
    """The errors of a value that was read."""
    inner = lambda value, sub, at: errors(value, sub, root, at, depth + 1)
    found: list[Column] = []
    v, members, items = x["v"], x["members"], x["items"]
    add = lambda test, keyword, keys=None: found.append(_error(test, path, keyword, keys))
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        add(~_kind(x).isin(*kinds, *(["integer"] if "number" in kinds else [])), "type")
    for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
        if values is not None:
            allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in values]
            add(~F.to_json(v).isin(*allowed), keyword, F.array(*map(F.lit, allowed)))
    if "required" in schema:
        missing = F.filter(F.array(*map(F.lit, schema["required"])), lambda k: ~F.map_contains_key(members, k))
        add(F.size(missing) > 0, "required", missing)
    known = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        extra = F.filter(F.map_keys(members), lambda k: ~k.isin(*known) if known else F.lit(True))
        add(members.isNotNull() & (F.size(extra) > 0), "additionalProperties", F.array_sort(extra))
    if "minProperties" in schema:
        add(members.isNotNull() & (F.size(members) < schema["minProperties"]), "minProperties")
    for name, sub in known.items():
        at = F.concat(path, F.lit("/" + name.replace("~", "~0").replace("/", "~1")))
        own = inner(F.try_element_at(members, F.lit(name)), sub, at)
        found.append(F.when(F.coalesce(F.map_contains_key(members, F.lit(name)), F.lit(False)), own).otherwise(F.array().cast(ERROR)))
    for keyword, test in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
        if keyword in schema:
            add(items.isNotNull() & test(schema[keyword]), keyword)
    if schema.get("uniqueItems"):
        text = F.transform(items, lambda x: F.to_json(x))  # with one argument: the second is the place
        add(F.size(F.array_distinct(text)) < F.size(text), "uniqueItems")
    if "items" in schema:
        each = F.transform(items, lambda x, i: inner(x, schema["items"], F.concat(path, F.lit("/"), i.cast("string"))))
        found.append(F.coalesce(F.flatten(each), F.array().cast(ERROR)))
    text, number = _as(v, "string"), _as(v, "double")
    is_text, is_number = _kind(x) == "string", _kind(x).isin("integer", "number")
    strings = {
        "minLength": lambda n: F.char_length(text) < n,
        "maxLength": lambda n: F.char_length(text) > n,
        "pattern": lambda p: ~text.rlike(p),
        "format": lambda kind: ~(text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()) if kind == "date" else F.lit(False),
    }
    numbers = {"minimum": lambda n: number < n, "maximum": lambda n: number > n, "exclusiveMinimum": lambda n: number <= n, "exclusiveMaximum": lambda n: number >= n}
    for keyword in strings.keys() & schema.keys():
        add(is_text & strings[keyword](schema[keyword]), keyword)
    for keyword in numbers.keys() & schema.keys():
        add(is_number & numbers[keyword](schema[keyword]), keyword)
    here = lambda sub: _found(x, _resolved(sub, root), root, path, depth + 1)
    holds = lambda sub: F.size(here(sub)) == 0
    found += [here(sub) for sub in schema.get("allOf", [])]
    count = lambda subs: reduce(lambda a, b: a + b, [holds(s).cast("int") for s in subs])
    if "anyOf" in schema:
        add(count(schema["anyOf"]) == 0, "anyOf")
    if "oneOf" in schema:
        add(count(schema["oneOf"]) != 1, "oneOf")
    if "not" in schema:
        add(holds(schema["not"]), "not")
    if "if" in schema:
        test, nothing = holds(schema["if"]), F.array().cast(ERROR)
        found.append(F.when(test, here(schema["then"]) if "then" in schema else nothing).otherwise(here(schema["else"]) if "else" in schema else nothing))
    return F.concat(*found) if len(found) > 1 else found[0] if found else F.array().cast(ERROR)


def _without_extra(v: Column, schema: dict, root: dict, depth: int = 0) -> Column:
    """``v`` without the keys that no part of the schema for their object knows; other values stay as they are."""
    if depth > DEPTH:
        raise ValueError("the schema refers to itself")
    schema = _resolved(schema, root)
    inner = lambda value, sub: _without_extra(value, sub, root, depth + 1)
    out = _read(v, lambda x: _own_cleaned(x, schema, inner))
    for sub in schema.get("allOf", []):
        out = inner(out, sub)
    if "if" in schema:
        test = F.size(errors(v, schema["if"], root)) == 0
        out = F.when(test, inner(out, schema["then"]) if "then" in schema else out).otherwise(inner(out, schema["else"]) if "else" in schema else out)
    return out


def _own_cleaned(x: Column, schema: dict, inner: Callable[[Column, dict], Column]) -> Column:
    out = x["v"]
    known, closed = schema.get("properties", {}), schema.get("additionalProperties") is False
    parts = {k: s for k, s in known.items() if any(word in json.dumps(s) for word in ("properties", "additionalProperties", "$ref"))}
    if parts or closed:
        members = x["members"]
        if closed:
            members = F.map_filter(members, lambda k, _: k.isin(*known) if known else F.lit(False))
        if parts:
            members = F.transform_values(members, lambda k, value: reduce(lambda rest, p: F.when(k == p[0], inner(value, p[1])).otherwise(rest), parts.items(), value))
        out = F.when(x["members"].isNotNull(), F.call_function("to_variant_object", members)).otherwise(out)
    if isinstance(schema.get("items"), dict):
        each = F.transform(x["items"], lambda value: inner(value, schema["items"]))
        out = F.when(x["items"].isNotNull(), F.call_function("to_variant_object", each)).otherwise(out)
    return out


def stripped(v: Column, schema: dict, most: int = MOST_STRIPPED) -> Column:
    """``struct<output, errors, removed>`` of an answer: extra keys go if that alone makes it valid.

    Keys are deleted only if every error is of that kind, in ``most`` objects at most, and nothing is wrong afterwards; else the answer stays
    as it was written, with its own errors, and ``removed`` is 0. Deleting never uncovers what was not checked before, as all errors are
    found at once, so one pass is the fixpoint. A null answer (undecodable) has null errors.
    """
    none = F.array().cast(ERROR)

    def judged(before: Column) -> Column:
        all_extra = (F.size(before) > 0) & F.forall(before, lambda e: e["keyword"] == "additionalProperties") & (F.size(before) <= most)
        as_written = F.struct(v.alias("output"), before.alias("errors"), F.lit(0).alias("removed"))
        removed = F.aggregate(before, F.lit(0), lambda n, e: n + F.size(e["keys"]))
        settled = lambda c: F.when(F.size(errors(c, schema)) == 0, F.struct(c.alias("output"), none.alias("errors"), removed.alias("removed"))).otherwise(as_written)
        return F.when(F.coalesce(all_extra, F.lit(False)), _let(_without_extra(v, schema, schema), settled)).otherwise(as_written)

    return _let(errors(v, schema), judged)
