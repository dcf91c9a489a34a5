"""JSON Schemas of what the engine writes, made from the tables' own types, and a check of records against them (survey K19)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from .schema import EVENT, SEVERITIES
from .store import TABLES

_PLAIN = {T.StringType: "string", T.LongType: "integer", T.IntegerType: "integer", T.DoubleType: "number", T.BooleanType: "boolean", T.TimestampType: "string"}
_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _of(kind: T.DataType, nullable: bool = True) -> dict[str, Any]:
    """A Spark type as JSON Schema."""
    if isinstance(kind, T.StructType):
        out = {"type": "object", "properties": {f.name: _of(f.dataType) for f in kind}, "required": kind.names}
    elif isinstance(kind, T.MapType):
        out = {"type": "object", "additionalProperties": _of(kind.valueType)}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": _of(kind.elementType, False)}
    else:
        out = {"type": _PLAIN[type(kind)]}
    return out | {"type": [out["type"], "null"]} if nullable else out


_REF = T.StructType([T.StructField(n, T.LongType() if n == "event_id" else T.StringType()) for n in ("event_id", "source", "source_event_id", "observation")])
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "array<string>": T.ArrayType(T.StringType()), "array<long>": T.ArrayType(T.LongType()), f"array<{_REF.simpleString()}>": T.ArrayType(_REF)}


def _table(name: str) -> T.StructType:
    """A stored table's columns, but for the case. Spark itself parses such a text only within a session."""
    own = [c.split() for c in TABLES[name].split(", ")]
    return T.StructType([T.StructField(n, _TYPES[kind]) for n, kind in own if n != "case_id"])


def _named(name: str, title: str, body: dict[str, Any]) -> dict[str, Any]:
    return {"$id": f"evtrail.{name}/1", "title": title, **body}


def _every() -> dict[str, dict[str, Any]]:
    event, finding = _of(EVENT, False), _of(_table("findings"), False)
    for key in ("id", "source", "event_id"):
        event["properties"][key] = _of(EVENT[key].dataType, False)
    for key in ("uid", "rule_id", "evidence"):
        finding["properties"][key] = _of(_table("findings")[key].dataType, False)
    finding["properties"]["severity"] = {"type": "string", "enum": list(SEVERITIES)}
    finding["properties"]["confidence"] = {"type": "integer", "minimum": 0, "maximum": 100}
    finding["properties"]["evidence"]["minItems"] = 1
    line = {"type": "object", "required": ["record", "record_type", "schema", "tool"], "properties": {"record": {"type": "object"}, "record_type": {"type": "string", "enum": ["event", "finding"]}, "schema": {"type": "string"}, "tool": {"type": "string", "enum": ["evtrail"]}}}
    result = {"type": "object", "required": ["command", "status"], "properties": {"command": {"type": "string"}, "status": {"type": "string", "enum": ["ok", "error"]}, "error": {"type": "string"}, "truncated": {"type": "boolean"}}}
    return {
        "event": _named("event", "A normalized event", event),
        "finding": _named("finding", "A finding of a rule", finding),
        "evidence": _named("evidence", "A registered file", _of(_table("evidence"), False)),
        "export": _named("export", "A line of an export", line),
        "result": _named("result", "What a command prints", result),
    }


SCHEMAS = _every()


def named(name: str) -> dict[str, Any]:
    if name not in SCHEMAS:
        raise KeyError(f"no schema {name}; there are {', '.join(SCHEMAS)}")
    return SCHEMAS[name]


def faults(value: Any, schema: dict[str, Any], at: str = "") -> list[str]:
    """Where a value departs from a schema of the kind above; none if it fits."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    fits = [k for k in kinds if isinstance(value, _KINDS[k]) and not (k in ("integer", "number") and isinstance(value, bool))]
    here = at or "the record"
    if kinds and not fits:
        return [f"{here}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{here}: not one of {', '.join(map(str, schema['enum']))}")
    if isinstance(value, (int, float)) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{here}: out of range")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{here}: too few items")
        for i, x in enumerate(value):
            out += faults(x, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        out += [f"{here}: {k} is missing" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            below = schema.get("properties", {}).get(k, schema.get("additionalProperties", {}))
            out += faults(x, below if isinstance(below, dict) else {}, f"{at}.{k}" if at else k)
    return out
