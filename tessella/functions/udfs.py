"""Functions that Spark lacks, as Arrow-batched UDFs: changes to JSON texts, planar geometry, Unicode forms, XML checks, addresses and compression."""

from __future__ import annotations

import ipaddress
import json
import re
import unicodedata
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import geometry


def steps(path: str) -> list:
    """Keys and indexes of a JSON path."""
    if not path.startswith("$"):
        raise ValueError(f"no JSON path: {path!r}")
    return [int(i) if i else (q or k) for k, q, i in re.findall(r'\.(\w+)|\."([^"]*)"|\[(\d+)\]', path)]


def _at(doc, path: list):
    """(holder, key, whether the place is there) of a path's last step; None where the way there is missing."""
    for s in path[:-1]:
        if isinstance(doc, dict) and s in doc or isinstance(doc, list) and isinstance(s, int) and s < len(doc):
            doc = doc[s]
        else:
            return None
    last = path[-1]
    if isinstance(doc, dict) and isinstance(last, str):
        return doc, last, last in doc
    if isinstance(doc, list) and isinstance(last, int):
        return doc, last, last < len(doc)
    return None


def change(kind: str, doc, path: str, value=None):
    """JSON_SET, JSON_INSERT, JSON_REPLACE, JSON_REMOVE, JSON_ARRAY_APPEND and JSON_ARRAY_INSERT at one path."""
    way = steps(path)
    if not way:
        if kind == "array_append":
            return [*doc, value] if isinstance(doc, list) else [doc, value]
        return value if kind in ("set", "replace") else doc
    place = _at(doc, way)
    if place is None:
        return doc
    holder, key, there = place
    if kind == "remove":
        if there:
            del holder[key]
    elif kind == "array_append":
        if there:
            holder[key] = [*holder[key], value] if isinstance(holder[key], list) else [holder[key], value]
    elif kind == "array_insert":
        if isinstance(holder, list):
            holder.insert(key, value)
    elif there and kind in ("set", "replace"):
        holder[key] = value
    elif not there and kind in ("set", "insert"):
        if isinstance(holder, list):
            holder.append(value)
        else:
            holder[key] = value
    return doc


def merge_patch(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge_preserve(a, b):
    if isinstance(a, dict) and isinstance(b, dict):
        return a | {k: merge_preserve(a[k], v) if k in a else v for k, v in b.items()}
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def search(doc, one: bool, wanted: str) -> str | None:
    found: list[str] = []
    pattern = re.compile(re.escape(wanted).replace("%", ".*").replace("_", "."), re.S)

    def look(v, path: str) -> None:
        if isinstance(v, str) and pattern.fullmatch(v):
            found.append(path)
        for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
            look(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]")

    look(doc, "$")
    return None if not found else json.dumps(found[0] if one or len(found) == 1 else found)


def depth(v) -> int:
    return 1 + max(map(depth, v.values() if isinstance(v, dict) else v), default=0) if isinstance(v, (dict, list)) else 1


def dump(v) -> str:
    return json.dumps(v, ensure_ascii=False)


def _json_change(kind: str, doc: str, args) -> str:
    value = json.loads(doc)
    args = list(args)
    if kind == "remove":
        for path in args:
            value = change(kind, value, path)
        return dump(value)
    if kind in ("merge_patch", "merge_preserve"):
        for other in args:
            value = (merge_patch if kind == "merge_patch" else merge_preserve)(value, json.loads(other))
        return dump(value)
    for path, text in zip(args[::2], args[1::2], strict=True):
        value = change(kind, value, path, json.loads(text).get("v"))
    return dump(value)


def _well_formed(text: str) -> bool:
    import xml.etree.ElementTree as ET

    try:
        ET.fromstring(text)
    except ET.ParseError:
        return False
    return True


def _xml_rows(text: str, path: str) -> list[str]:
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    top, *rest = [p for p in path.split("/") if p]
    if top != root.tag and not path.startswith("//"):
        return []
    found = root.iter(top) if path.startswith("//") and not rest else root.findall("./" + "/".join(rest)) if rest else [root]
    return [ET.tostring(x, encoding="unicode").strip() for x in found]


def update_xml(text: str, path: str, new: str) -> str:
    """The document with the one element at the path replaced; unchanged if there is none, or more than one."""
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    top, *rest = [p for p in path.split("/") if p]
    if not rest:
        return new if top == root.tag else text
    if top != root.tag:
        return text
    found = [(p, k) for p in ([root] if len(rest) == 1 else root.findall("./" + "/".join(rest[:-1]))) for k, c in enumerate(p) if c.tag == rest[-1]]
    if len(found) != 1:
        return text
    parent, at = found[0]
    tail = parent[at].tail
    parent[at] = ET.fromstring(new)
    parent[at].tail = tail
    return ET.tostring(root, encoding="unicode", short_empty_elements=False)


_JSON_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_kind(v, kind: str) -> bool:
    if kind == "number":
        return isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "integer":
        return isinstance(v, int) and not isinstance(v, bool)
    return isinstance(v, _JSON_KINDS[kind])


def schema_fault(schema: dict, v, where: str = "#", at: str = "#") -> tuple[str, str, str] | None:
    """(keyword, its place in the schema, place in the document) of the first fault, by draft 4 of JSON Schema without references; None if there is none."""
    number, kinds = _is_kind(v, "number"), schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    checks = {
        "type": lambda x: any(_is_kind(v, k) for k in kinds),
        "enum": lambda x: any(v == c and isinstance(v, bool) == isinstance(c, bool) for c in x),
        "minimum": lambda x: not number or (v > x if schema.get("exclusiveMinimum") else v >= x),
        "maximum": lambda x: not number or (v < x if schema.get("exclusiveMaximum") else v <= x),
        "multipleOf": lambda x: not number or v % x == 0,
        "minLength": lambda x: not isinstance(v, str) or len(v) >= x,
        "maxLength": lambda x: not isinstance(v, str) or len(v) <= x,
        "pattern": lambda x: not isinstance(v, str) or re.search(x, v) is not None,
        "minItems": lambda x: not isinstance(v, list) or len(v) >= x,
        "maxItems": lambda x: not isinstance(v, list) or len(v) <= x,
        "uniqueItems": lambda x: not x or not isinstance(v, list) or len({dump(i) for i in v}) == len(v),
        "minProperties": lambda x: not isinstance(v, dict) or len(v) >= x,
        "maxProperties": lambda x: not isinstance(v, dict) or len(v) <= x,
        "required": lambda x: not isinstance(v, dict) or all(k in v for k in x),
        "additionalProperties": lambda x: x is not False or not isinstance(v, dict) or set(v) <= set(schema.get("properties", {})),
        "allOf": lambda x: all(schema_fault(s, v) is None for s in x),
        "anyOf": lambda x: any(schema_fault(s, v) is None for s in x),
        "oneOf": lambda x: sum(schema_fault(s, v) is None for s in x) == 1,
        "not": lambda x: schema_fault(x, v) is not None,
    }
    for keyword, ok in checks.items():
        if keyword in schema and not ok(schema[keyword]):
            return keyword, where, at
    inner = []
    if isinstance(v, dict):
        inner = [(s, v[k], f"{where}/properties/{k}", f"{at}/{k}") for k, s in schema.get("properties", {}).items() if k in v]
    if isinstance(v, list) and isinstance(schema.get("items"), dict):
        inner = [(schema["items"], x, f"{where}/items", f"{at}/{k}") for k, x in enumerate(v)]
    return next((fault for i in inner if (fault := schema_fault(*i))), None)


def schema_report(schema: str, doc: str) -> str:
    fault = schema_fault(json.loads(schema), json.loads(doc))
    if fault is None:
        return dump({"valid": True})
    keyword, where, at = fault
    reason = f"The JSON document location '{at}' failed requirement '{keyword}' at JSON Schema location '{where}'"
    return dump({"valid": False, "reason": reason, "schema-location": where, "document-location": at, "schema-failed-keyword": keyword})


def _each(f: Callable, *series: pd.Series) -> pd.Series:
    """f of each row; null if any argument is."""
    return pd.Series([None if any(v is None or v is pd.NA or isinstance(v, float) and v != v for v in row) else f(*row) for row in zip(*series, strict=True)], dtype=object)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, under names that begin with tessella_."""

    def add(name: str, kind: str, f: Callable, n: int) -> None:
        def one(a: pd.Series) -> pd.Series:
            return _each(f, a)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return _each(f, a, b)

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return _each(f, a, b, c)

        spark.udf.register(f"tessella_{name}", F.pandas_udf((one, two, three)[n - 1], kind))

    add("json_change", "string", _json_change, 3)
    add("json_search", "string", lambda doc, how, what: search(json.loads(doc), how.lower() == "one", what), 3)
    add("json_depth", "int", lambda doc: depth(json.loads(doc)), 1)
    add("json_pretty", "string", lambda doc: json.dumps(json.loads(doc), ensure_ascii=False, indent=2), 1)
    add("json_schema_valid", "int", lambda schema, doc: int(schema_fault(json.loads(schema), json.loads(doc)) is None), 2)
    add("json_schema_validation_report", "string", schema_report, 2)
    add("updatexml", "string", update_xml, 3)
    add("xml_ok", "boolean", _well_formed, 1)
    add("xml_rows", "array<string>", _xml_rows, 2)
    add("normalize", "string", lambda s, form: unicodedata.normalize(form, s), 2)
    add("compress", "binary", lambda s: len(s.encode()).to_bytes(4, "little") + zlib.compress(s.encode()), 1)
    add("uncompress", "string", lambda b: zlib.decompress(bytes(b)[4:]).decode(), 1)
    add("inet6_aton", "binary", lambda s: ipaddress.ip_address(s).packed, 1)
    add("inet6_ntoa", "string", lambda b: str(ipaddress.ip_address(bytes(b))), 1)
    add("geo_fromwkb", "string", lambda b: geometry.show(*geometry.from_wkb(bytes(b))), 1)
    add("geo_towkb", "binary", lambda g: geometry.to_wkb(geometry.parse(g)), 1)
    one = lambda f: lambda g: f(geometry.parse(g))
    two = lambda f: lambda g, h: f(geometry.parse(g), geometry.parse(h))
    nth = lambda f: lambda g, n: f(geometry.parse(g), int(n))
    for name, (f, kind) in geometry.ONE.items():
        add(f"geo_{name}", "double" if kind == "n" else "string", one(f), 1)
    for name, (f, kind) in geometry.TWO.items():
        add(f"geo_{name}", "double" if kind == "n" else "string", two(f), 2)
    for name, f in geometry.NTH.items():
        add(f"geo_{name}", "string", nth(f), 2)
