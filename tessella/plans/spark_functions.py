"""Calls that need more than a template: a part of the printer, which it inherits."""

from __future__ import annotations

import re

from ..functions.names import GET_FORMATS
from .ast import Node
from .lexer import SqlError


def strip(e: Node) -> Node:
    while e.kind in ("paren", "outer_sign"):
        e = e.expr
    return e


def text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_point(a: Node) -> bool:
    return strip(a).kind == "call" and strip(a).name in ("point", "st_point", "st_makepoint", "sdo_point")


class MoreFunctions:
    """Methods named f_<function> print a call, or give None where a template will do."""

    def f_encode(self, e):
        if self.dialect == "mysql":
            raise SqlError(f"{e.name} is a cipher of its server's own")
        return None

    # JSON

    def json_text(self, doc: Node, path: str) -> str:
        """What is at the path as text: strings without their quotes."""
        return f"get_json_object({self.expr(doc)}, {text(path)})"

    def json_value(self, doc: Node, path: str) -> str:
        """What is at the path as JSON: strings in quotes. Paths with wildcards give what Spark makes of them."""
        if re.fullmatch(r"\$(?:\.\w+|\[\d+\])*", path):
            return f"to_json(try_variant_get(try_parse_json({self.expr(doc)}), {text(path)}, 'variant'))"
        return self.json_text(doc, path)

    def f_json_extract(self, e):
        if self.dialect != "mysql" or any(strip(a).kind != "string" for a in e.args[1:]):
            return None
        found = [self.json_value(e.args[0], strip(a).text) for a in e.args[1:]]
        if len(found) == 1:
            return found[0]
        parts = ", ".join(f"parse_json({f})" for f in found)
        return f"nullif(to_json(filter(array({parts}), x -> x IS NOT NULL)), '[]')"

    def json_element(self, a: Node) -> str:
        """A value as JSON; what is JSON already stays as it is."""
        x = self.expr(a)
        if strip(a).kind == "call" and strip(a).name.startswith("json_") and strip(a).name not in ("json_value", "json_unquote", "json_type", "json_length", "json_depth", "json_valid"):
            return f"coalesce({x}, 'null')"
        return f"substring(to_json(array({x}), map('ignoreNullFields', 'false')), 2, length(to_json(array({x}), map('ignoreNullFields', 'false'))) - 2)"

    def json_pair(self, key: Node, value: Node) -> str:
        return f"concat('\"', {self.expr(key)}, '\"{':' if self.dialect == 'oracle' else ': '}', {self.json_element(value)})"

    def json_glue(self) -> str:
        return "','" if self.dialect == "oracle" else "', '"

    def f_json_array(self, e):
        return f"concat('[', concat_ws({self.json_glue()}, {', '.join(map(self.json_element, e.args))}), ']')" if e.args else "'[]'"

    def f_json_object(self, e):
        pairs = ", ".join(self.json_pair(k, v) for k, v in zip(e.args[::2], e.args[1::2], strict=True))
        return f"concat('{{', concat_ws({self.json_glue()}, {pairs}), '}}')" if e.args else "'{}'"

    def f_json_arrayagg(self, e):
        return f"concat('[', array_join(collect_list({self.json_element(e.args[0])}), {self.json_glue()}), ']')"

    def f_json_objectagg(self, e):
        return f"concat('{{', array_join(collect_list({self.json_pair(*e.args)}), {self.json_glue()}), '}}')"

    # regular expressions and texts

    def f_regexp_match(self, e):
        """The groups of the first match, or the match where the pattern has none."""
        x, p, n = self.pattern_groups(e)
        groups = ", ".join(f"regexp_extract({x}, {p}, {k})" for k in range(1, n + 1)) or f"regexp_extract({x}, {p}, 0)"
        return f"CASE WHEN regexp_like({x}, {p}) THEN array({groups}) END"

    def f_regexp_matches(self, e):
        """As regexp_match, a row for the first match, or with the flag g for each."""
        x, p, n = self.pattern_groups(e)
        if "g" not in (strip(e.args[2]).text if len(e.args) > 2 else ""):
            return f"explode(filter(array({self.f_regexp_match(e)}), m -> m IS NOT NULL))"
        if n <= 1:
            return f"explode(transform(regexp_extract_all({x}, {p}, {n}), m -> array(m)))"
        groups = ", ".join(f"regexp_extract_all({x}, {p}, {k})" for k in range(1, n + 1))
        names = ", ".join(f"s.`{k}`" for k in range(n))
        return f"explode(transform(arrays_zip({groups}), s -> array({names})))"

    def pattern_groups(self, e) -> tuple[str, str, int]:
        p = strip(e.args[1])
        if p.kind != "string":
            raise SqlError(f"{e.name} needs its pattern as a literal")
        flags = strip(e.args[2]).text if len(e.args) > 2 else ""
        bare = re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", p.text)
        return self.expr(e.args[0]), text("(?i)" + p.text if "i" in flags else p.text), len(re.findall(r"\((?!\?)", bare))

    def f_unistr(self, e):
        if strip(e.args[0]).kind != "string":
            raise SqlError("UNISTR needs a literal")
        point = lambda m: "\\" if m[0] == "\\\\" else chr(int(next(x for x in m.groups() if x), 16))
        return text(re.sub(r"\\\\|\\(?:u([0-9A-Fa-f]{4})|\+([0-9A-Fa-f]{6})|U([0-9A-Fa-f]{8})|([0-9A-Fa-f]{4}))", point, strip(e.args[0]).text))

    def f_dump(self, e):
        """Oracle's view of a text's bytes; that of numbers and dates is its own storage format."""
        if self.dialect != "oracle":
            return None
        if self.type_of(e.args[0]) not in ("str", None) or len(e.args) > 1:
            raise SqlError("DUMP shows texts only")
        x = self.expr(e.args[0])
        code = "96" if strip(e.args[0]).kind == "string" else "1"
        octets = f"transform(sequence(1, octet_length({x})), i -> conv(substring(hex({x}), 2 * i - 1, 2), 16, 10))"
        return f"CASE WHEN {x} IS NULL THEN 'NULL' ELSE concat('Typ={code} Len=', octet_length({x}), ': ', array_join({octets}, ',')) END"

    # dates and intervals

    def f_age(self, e):
        """Years, months and days between two dates, borrowing from the month of the earlier one."""
        if self.dialect != "pg":
            return None
        a, b = [self.expr(x) for x in e.args] if len(e.args) == 2 else ["current_date()", self.expr(e.args[0])]
        both = f"named_struct('l', greatest(cast({a} AS timestamp), cast({b} AS timestamp)), 'e', least(cast({a} AS timestamp), cast({b} AS timestamp)), 's', if(cast({a} AS timestamp) < cast({b} AS timestamp), -1, 1))"
        clock = lambda x: f"(unix_micros({x}) - unix_micros(date_trunc('DAY', {x})))"
        months = "(year(t.l) - year(t.e)) * 12 + month(t.l) - month(t.e)"
        fields = f"named_struct('s', t.s, 'm', {months}, 'd', day(t.l) - day(t.e) - if({clock('t.l')} < {clock('t.e')}, 1, 0), 'u', pmod({clock('t.l')} - {clock('t.e')}, 86400000000), 'n', day(last_day(t.e)))"
        interval = "make_interval(0, f.s * (f.m - if(f.d < 0, 1, 0)), 0, f.s * (f.d + if(f.d < 0, f.n, 0)), 0, 0, cast(cast(f.s * f.u AS decimal(18, 0)) / 1000000 AS decimal(18, 6)))"
        return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN transform(transform(array({both}), t -> {fields}), f -> {interval})[0] END"

    def f_justify_days(self, e):
        """Months for every thirty days; an interval's days and times are one number here, so whole days are taken from it."""
        if self.dialect != "pg":
            return None
        if strip(e.args[0]).kind != "interval":
            raise SqlError(f"{e.name} needs an interval literal")
        months, micros, _ = self.months_micros(strip(e.args[0]))
        days = f"cast(({micros}) div 86400000000 AS int)"
        thirties, left = ("0", days) if e.name == "justify_hours" else (f"{days} div 30", f"{days} % 30")
        return f"make_interval(0, cast({months} AS int) + {thirties}, 0, {left}, 0, 0, cast((({micros}) % 86400000000) / 1000000 AS decimal(18, 6)))"

    f_justify_hours = f_justify_interval = f_justify_days

    def f_time_format(self, e):
        return self.f_date_format(e) if self.dialect == "mysql" else None

    def f_get_format(self, e):
        if self.dialect != "mysql":
            return None
        kind = strip(e.args[0])
        return text(GET_FORMATS[kind.parts["parts"][-1].text.upper(), strip(e.args[1]).text.upper()])

    def f_export_set(self, e):
        bits, on, off, *rest = [self.expr(a) for a in e.args]
        sep, n = rest[0] if rest else "','", rest[1] if len(rest) > 1 else "64"
        return f"array_join(transform(sequence(0, least(64, {n}) - 1), i -> CASE WHEN (shiftright({bits}, i) & 1) = 1 THEN {on} ELSE {off} END), {sep})"

    def f_overlay(self, e):
        """Without FOR as many characters go as come."""
        if len(e.args) != 3:
            return None
        x, new, start = [self.expr(a) for a in e.args]
        return f"overlay({x} PLACING {new} FROM {start} FOR length({new}))"

    def f_regexp_split_to_table(self, e):
        return f"explode(split({self.expr(e.args[0])}, {self.expr(e.args[1])}))"

    def f_string_to_table(self, e):
        return f"explode(split({self.expr(e.args[0])}, concat('\\\\Q', {self.expr(e.args[1])}, '\\\\E')))"

    # XML

    def f_xmlpi(self, e):
        tag = strip(e.args[0])
        name = tag.parts["parts"][-1].text if tag.kind == "column" else tag.text
        rest = f", ' ', {self.expr(e.args[1])}" if len(e.args) > 1 else ""
        return f"concat('<?{name}'{rest}, '?>')"

    def f_xmlparse(self, e):
        x = self.expr(e.args[0])
        whole = x if strip(e.args[1]).text == "DOCUMENT" else f"concat('<r>', {x}, '</r>')"
        return f"CASE WHEN tessella_xml_ok({whole}) THEN {x} ELSE raise_error('invalid XML') END"

    def f_xmlserialize(self, e):
        return self.expr(e.args[0])

    def f_xmlroot(self, e):
        x, version, *alone = [self.expr(a) for a in e.args]
        standalone = f"""', ' standalone="', {alone[0]}, '"'""" if alone else "'"
        return f"""concat('<?xml version="', {version}, '"{standalone}, '?>', regexp_replace({x}, '^<[?]xml[^>]*[?]>', ''))"""

    def f_xmlexists(self, e):
        return f"xpath_boolean({self.expr(e.args[1])}, {self.expr(e.args[0])})"

    f_xpath_exists = f_xmlexists

    def f_xmlquery(self, e):
        return f"nullif(array_join(tessella_xml_rows({self.expr(e.args[1])}, {self.expr(e.args[0])}), ''), '')"

    def f_xmlcolattval(self, e):
        out = []
        for a in e.args:
            n = strip(a).parts["parts"][-1].text.upper()
            out.append(f"""CASE WHEN {self.expr(a)} IS NULL THEN '' ELSE concat('<column name="{n}">', {self.expr(a)}, '</column>') END""")
        return f"concat({', '.join(out)})"

    # geometry

    def geo_text(self, a: Node) -> str:
        """A geometry as well-known text; points made of two numbers, which are structs, too."""
        return f"concat('POINT(', {self.coordinates(a)}, ')')" if is_point(a) else self.expr(a)

    def coordinates(self, a: Node) -> str:
        if is_point(a):
            x, y = (self.expr(c) for c in strip(a).args)
            return f"concat(cast({x} AS double), ' ', cast({y} AS double))"
        return f"regexp_extract({self.geo_text(a)}, '[(](.*)[)]', 1)"

    def geo_made(self, e: Node) -> str | None:
        """LINESTRING, POLYGON, MULTI... and GEOMETRYCOLLECTION of their parts."""
        if self.dialect != "mysql" or not e.args:
            return None
        kind = e.name.upper()
        if kind in ("LINESTRING", "MULTIPOINT"):
            parts = [self.coordinates(a) for a in e.args]
        elif kind == "GEOMETRYCOLLECTION":
            parts = [self.geo_text(a) for a in e.args]
        else:  # rings of lines, lines, polygons
            parts = [f"regexp_extract({self.geo_text(a)}, '[(].*[)]', 0)" for a in e.args]
        return f"tessella_geo_astext(concat('{kind}(', concat_ws(',', {', '.join(parts)}), ')'))"

    f_linestring = f_polygon = f_multipoint = f_multilinestring = f_multipolygon = f_geometrycollection = geo_made
