"""JSON Schema as columns: a schema is compiled once, documents are judged where they lie."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about validity.
NOTES = frozenset("$schema $id $defs $comment definitions title description default examples deprecated readOnly writeOnly".split())
#: Keywords that are judged; any other is reported as skipped.
JUDGED = frozenset(
    "type properties required additionalProperties enum const pattern minLength maxLength minimum maximum exclusiveMinimum "
    "exclusiveMaximum multipleOf items minItems maxItems uniqueItems minProperties maxProperties allOf anyOf oneOf not if then else $ref".split()
)
_FINDINGS = "array<struct<path: string, rule: string>>"


def _none() -> Column:
    return F.array().cast(_FINDINGS)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind of JSON value; numbers without a fraction are integers."""
    told = F.schema_of_variant(v)
    number = told.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.try_variant_get(v, "$", "double")
    return {
        "null": told == "VOID",
        "boolean": told == "BOOLEAN",
        "string": told == "STRING",
        "number": number,
        "integer": number & (value == F.floor(value)),
        "object": told.startswith("OBJECT"),
        "array": told.startswith("ARRAY"),
    }[kind]


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is used: a bare column expression is evaluated at each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _text(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _equals(v: Column, value: object) -> Column:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.coalesce(_is(v, "number") & (F.try_variant_get(v, "$", "double") == float(value)), F.lit(False))
    return F.to_json(v) == F.lit(_text(value))


def _resolved(root: dict, ref: str) -> object:
    if not ref.startswith("#"):
        raise ValueError(f"{ref} lies outside of the schema")
    node: object = root
    for step in ref[1:].strip("/").split("/") if ref != "#" else []:
        node = node[step.replace("~1", "/").replace("~0", "~")]
    return node


def skipped_keywords(schema: object) -> list[str]:
    """Keywords anywhere in a schema that aren't judged."""

    def walk(node: object) -> Iterator[str]:
        if not isinstance(node, dict):
            return
        for key, value in node.items():
            if key not in JUDGED | NOTES:
                yield key
            for below in value.values() if key in ("properties", "$defs", "definitions") else value if key in ("allOf", "anyOf", "oneOf") else [value] if key in ("items", "additionalProperties", "not", "if", "then", "else") else []:
                yield from walk(below)

    return sorted(set(walk(schema)))


class _Compiler:
    def __init__(self, root: dict):
        self.root, self.open = root, []

    def found(self, node: object, v: Column, path: Column) -> Column:
        """Findings about a variant that isn't missing, in the order of the rules below."""
        if node is True or node == {}:
            return _none()
        if node is False:
            return F.array(F.struct(path.alias("path"), F.lit("false").alias("rule")))
        parts: list[Column] = []

        def breach(rule: str, applies: Column, fine: Column) -> None:
            bad = F.coalesce(applies, F.lit(False)) & ~F.coalesce(fine, F.lit(False))
            parts.append(F.when(bad, F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(_none()))

        always = F.lit(True)
        if "$ref" in node:
            if node["$ref"] in self.open:
                raise ValueError(f"{node['$ref']} refers to itself: its depth has no bound")
            self.open.append(node["$ref"])
            parts.append(self.found(_resolved(self.root, node["$ref"]), v, path))
            self.open.pop()
        if "type" in node:
            kinds = [node["type"]] if isinstance(node["type"], str) else node["type"]
            any_ = _is(v, kinds[0])
            for k in kinds[1:]:
                any_ = any_ | _is(v, k)
            breach("type", always, any_)
        if "enum" in node:
            breach("enum", always, F.exists(F.array(*[_equals(v, x) for x in node["enum"]]), lambda x: x))
        if "const" in node:
            breach("const", always, _equals(v, node["const"]))
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        for rule, fine in (("pattern", lambda x: text.rlike(x)), ("minLength", lambda x: F.char_length(text) >= x), ("maxLength", lambda x: F.char_length(text) <= x)):
            if rule in node:
                breach(rule, _is(v, "string"), fine(node[rule]))
        bounds = {
            "minimum": lambda x: number >= x,
            "maximum": lambda x: number <= x,
            "exclusiveMinimum": lambda x: number > x,
            "exclusiveMaximum": lambda x: number < x,
            "multipleOf": lambda x: number / x == F.floor(number / x),
        }
        for rule, fine in bounds.items():
            if rule in node:
                breach(rule, _is(v, "number"), fine(float(node[rule])))
        parts += self._array(node, v, path, breach) + self._object(node, v, path, breach)
        parts += self._combined(node, v, path, breach)
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()

    def _present(self, node: object, value: Column, path: Column) -> Column:
        return _bound(value, lambda v: F.when(v.isNotNull(), self.found(node, v, path)).otherwise(_none()))

    def _array(self, node: dict, v: Column, path: Column, breach) -> list[Column]:
        values = F.try_variant_get(v, "$", "array<variant>")
        rules = {
            "minItems": lambda x: F.size(values) >= x,
            "maxItems": lambda x: F.size(values) <= x,
            "uniqueItems": lambda x: F.size(F.array_distinct(F.transform(values, lambda y: F.to_json(y)))) == F.size(values) if x else F.lit(True),
        }
        for rule, fine in rules.items():
            if rule in node:
                breach(rule, _is(v, "array"), fine(node[rule]))
        if "items" not in node:
            return []
        each = F.transform(values, lambda x, i: self.found(node["items"], x, F.concat(path, F.lit("/"), i.cast("string"))))
        return [F.when(_is(v, "array"), F.flatten(each)).otherwise(_none())]

    def _object(self, node: dict, v: Column, path: Column, breach) -> list[Column]:
        fields = F.try_variant_get(v, "$", "map<string,variant>")
        names = F.map_keys(fields)
        for rule, fine in (("minProperties", lambda x: F.size(names) >= x), ("maxProperties", lambda x: F.size(names) <= x)):
            if rule in node:
                breach(rule, _is(v, "object"), fine(node[rule]))
        out = []

        def of(wanted: Column, rule: str) -> None:
            """A finding for each of the names in ``wanted``."""
            each = F.transform(wanted, lambda n: F.struct(F.concat(path, F.lit("/"), n).alias("path"), F.lit(rule).alias("rule")))
            out.append(F.when(_is(v, "object"), each).otherwise(_none()))

        if node.get("required"):
            of(F.array_except(F.array(*map(F.lit, node["required"])), names), "required")
        known = node.get("properties", {})
        rest = F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))
        if node.get("additionalProperties") is False:
            of(rest, "additionalProperties")
        elif isinstance(node.get("additionalProperties"), dict):
            each = F.transform(rest, lambda n: self.found(node["additionalProperties"], F.element_at(fields, n), F.concat(path, F.lit("/"), n)))
            out.append(F.when(_is(v, "object"), F.flatten(each)).otherwise(_none()))
        for name, below in known.items():
            here = F.try_variant_get(v, "$['" + name.replace("'", "\\'") + "']", "variant")
            out.append(self._present(below, here, F.concat(path, F.lit("/" + name))))
        return out

    def _combined(self, node: dict, v: Column, path: Column, breach) -> list[Column]:
        fine = lambda below: F.size(self.found(below, v, path)) == 0
        out = [self.found(below, v, path) for below in node.get("allOf", [])]
        for rule, good in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
            if rule in node:
                breach(rule, F.lit(True), good(sum((fine(x).cast("int") for x in node[rule][1:]), fine(node[rule][0]).cast("int"))))
        if "not" in node:
            breach("not", F.lit(True), ~fine(node["not"]))
        if "if" in node:
            then, other = (self.found(node.get(k, True), v, path) for k in ("then", "else"))
            out.append(F.when(fine(node["if"]), then).otherwise(other))
        return out


def judged(document: Column, schema: dict) -> Column:
    """struct(state, findings, skipped) of a JSON text: state is passed, failed, or skipped.

    A finding has a path (``/a/0/b``) and the keyword that fails; a text that is no JSON fails at the root with ``parse``.
    A null text is skipped. So is a text without findings if the schema has keywords that aren't judged (``skipped`` names
    them, ``format`` for one): skipped isn't passed. A schema that refers to itself is an error, as its depth has no bound.
    """
    names = skipped_keywords(schema)
    unread = F.array(F.struct(F.lit("").alias("path"), F.lit("parse").alias("rule")))

    def judge(text: Column) -> Column:
        found = _bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), unread).otherwise(_Compiler(schema).found(schema, v, F.lit(""))))
        return _bound(F.when(text.isNull(), _none()).otherwise(found), lambda f: told(text, f))

    def told(text: Column, f: Column) -> Column:
        state = F.when(F.size(f) > 0, "failed").when(text.isNull() | F.lit(bool(names)), "skipped").otherwise("passed")
        return F.struct(state.alias("state"), f.alias("findings"), F.array(*map(F.lit, names)).cast("array<string>").alias("skipped"))

    return _bound(document, judge)
