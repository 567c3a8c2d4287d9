"""A compiler of stored rules: JSON tests over named predicates become Columns, checked against the table before a plan exists.

A test is one of {"all": [...]}, {"any": [...]}, {"not": test}, {"is": name, **arguments} for a predicate of the library, and
{"col": name, op: value} with the operators eq, ne, in, not_in, gt, lt, gte, lte, contains, regex, missing. A null test does not hold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType

from platewise.operators.families import fused

#: Kinds of columns that a predicate may need.
KINDS = {"number": NumericType, "string": StringType, "boolean": BooleanType, "array": ArrayType}
SEVERITIES = ("error", "warning", "advisory")


class RuleError(ValueError):
    """A stored rule that cannot be compiled: unknown name, column, operator or argument, or a column of another type."""


@dataclass(frozen=True)
class Predicate:
    """SQL text with {arguments}, and the columns that it needs by kind."""

    sql: str
    needs: dict[str, str]
    arguments: dict[str, float]


LIBRARY: dict[str, Predicate] = {}


def define(name: str, sql: str, arguments: dict[str, float] | None = None, **needs: str) -> None:
    LIBRARY[name] = Predicate(sql, needs, arguments or {})


# text and fonts
define("font_embedded", "embedded", embedded="boolean")
define("font_subset", "base_font RLIKE '^[A-Z]{{6}}[+]'", base_font="string")
define("font_standard_14", "base_font RLIKE '^(Courier|Helvetica|Times|Symbol|ZapfDingbats)'", base_font="string")
define("font_of_type", "subtype = '{type}'", {"type": "Type3"}, subtype="string")
define("font_unmapped", "NOT has_unicode", has_unicode="boolean")
define("text_below", "size_pt > 0 AND size_pt < {points}", {"points": 5}, size_pt="number")
define("text_invisible", "render_mode = 3", render_mode="number")
define("text_rotated", "pmod(angle, 360) NOT IN (0, 90, 180, 270)", angle="number")
# images
_DPI = "least(pixel_width / (sqrt(a * a + c * c) / 72), pixel_height / (sqrt(b * b + d * d) / 72))"
_MATRIX = {"a": "number", "b": "number", "c": "number", "d": "number"}
define("image_below", f"sqrt(a * a + c * c) >= 1e-10 AND sqrt(b * b + d * d) >= 1e-10 AND {_DPI} < {{dpi}}", {"dpi": 150}, pixel_width="number", pixel_height="number", **_MATRIX)
define("image_above", f"sqrt(a * a + c * c) >= 1e-10 AND sqrt(b * b + d * d) >= 1e-10 AND {_DPI} > {{dpi}}", {"dpi": 450}, pixel_width="number", pixel_height="number", **_MATRIX)
define("image_mirrored", "a * d - b * c < 0", **_MATRIX)
define("image_sheared", "abs(a * b + c * d) > {ratio} * abs(a * d - b * c)", {"ratio": 0.01}, **_MATRIX)
define("image_in", "color_space = '{space}'", {"space": "DeviceRGB"}, color_space="string")
# strokes, fills and inks
_INKS = {"c": "number", "m": "number", "y": "number", "k": "number"}
define("hairline", "NOT fill AND line_width > 0 AND line_width < {points}", {"points": 0.25}, fill="boolean", line_width="number")
define("zero_width", "NOT fill AND line_width = 0", fill="boolean", line_width="number")
define("coverage_above", "(c + m + y + k) * 100 > {percent}", {"percent": 300}, **_INKS)
define("registration", "least(c, m, y, k) >= 0.99", **_INKS)
define("pure_black", "k > 0 AND greatest(c, m, y) = 0", **_INKS)
define("rich_black", "k > 0.9 AND greatest(c, m, y) > 0.05", **_INKS)
define("white", "greatest(c, m, y, k) = 0", **_INKS)
define("inks_above", "IF(c > 0, 1, 0) + IF(m > 0, 1, 0) + IF(y > 0, 1, 0) + IF(k > 0, 1, 0) > {inks}", {"inks": 3}, **_INKS)
# transparency
define("transparent", "alpha < 1", alpha="number")
define("blended", "blend_mode NOT IN ('Normal', 'Compatible')", blend_mode="string")
define("overprinted", "overprint", overprint="boolean")
# pages
define("page_landscape", "tx1 - tx0 > ty1 - ty0", tx0="number", ty0="number", tx1="number", ty1="number")
define("page_rotated", "rotate <> 0", rotate="number")
define("page_scaled", "user_unit <> 1", user_unit="number")
define("page_larger", "greatest(tx1 - tx0, ty1 - ty0) * 25.4 / 72 > {mm}", {"mm": 1000}, tx0="number", ty0="number", tx1="number", ty1="number")
define("box_missing", "tx0 IS NULL", tx0="number")
# documents
define("document_encrypted", "encrypted", encrypted="boolean")
define("document_older", "coalesce(try_cast(version AS DOUBLE), 0) < {version}", {"version": 1.6}, version="string")
define("document_newer", "try_cast(version AS DOUBLE) > {version}", {"version": 1.7}, version="string")
define("document_scripted", "names_js OR open_js", names_js="boolean", open_js="boolean")
define("document_untagged", "NOT tagged", tagged="boolean")
define("without_intent", "intents = 0", intents="number")
define("without_xmp", "NOT has_xmp", has_xmp="boolean")
# bar codes
define("code_of_digits", "payload RLIKE '^[0-9]+$'", payload="string")
define("code_is_link", "payload LIKE 'http%'", payload="string")


def _type(fields: dict[str, DataType], column: str, rule: str) -> DataType:
    if column not in fields:
        raise RuleError(f"{rule}: the table has no column {column!r}")
    return fields[column]


def _named(test: dict, fields: dict[str, DataType], rule: str) -> Column:
    given = {k: v for k, v in test.items() if k != "is"}
    known = LIBRARY.get(test["is"])
    if known is None:
        raise RuleError(f"{rule}: no predicate is named {test['is']!r}")
    if extra := set(given) - set(known.arguments):
        raise RuleError(f"{rule}: {test['is']} has no argument {', '.join(sorted(extra))}")
    for column, kind in known.needs.items():
        if not isinstance(_type(fields, column, rule), KINDS[kind]):
            raise RuleError(f"{rule}: {test['is']} needs {column} as a {kind}")
    values = known.arguments | given
    for name, value in values.items():
        default = known.arguments[name]
        if isinstance(default, str) != isinstance(value, str) or isinstance(value, bool) or (isinstance(value, str) and not value.isidentifier()):
            raise RuleError(f"{rule}: {name} of {test['is']} is no {'name' if isinstance(default, str) else 'number'}")
    return F.expr(known.sql.format(**values))


def _compared(test: dict, fields: dict[str, DataType], rule: str) -> Column:
    kind, col = _type(fields, test["col"], rule), F.col(test["col"])
    found = F.lit(True)
    for op, value in test.items():
        if op == "col":
            continue
        values = value if op in ("in", "not_in") else [value]
        if op not in ("eq", "ne", "in", "not_in", "gt", "lt", "gte", "lte", "contains", "regex", "missing") or not isinstance(values, list):
            raise RuleError(f"{rule}: no operator {op!r} with {value!r}")
        if op == "missing":
            found &= col.isNull() if value else col.isNotNull()
            continue
        fits = {bool: BooleanType, str: StringType, int: NumericType, float: NumericType}
        for v in values:
            if not isinstance(kind, fits.get(type(v), ())) or (op in ("contains", "regex") and not isinstance(v, str)) or (op in ("gt", "lt", "gte", "lte") and not isinstance(kind, NumericType)):
                raise RuleError(f"{rule}: {test['col']} is {kind.simpleString()} and cannot be compared by {op} with {v!r}")
        hit = {"eq": lambda: col == value, "ne": lambda: col != value, "in": lambda: col.isin(*value), "not_in": lambda: ~col.isin(*value), "gt": lambda: col > value, "lt": lambda: col < value, "gte": lambda: col >= value, "lte": lambda: col <= value, "contains": lambda: col.contains(value), "regex": lambda: col.rlike(value)}
        found &= F.coalesce(hit[op](), F.lit(False))
    return found


def compile_test(test: dict, table: DataFrame, rule: str = "rule") -> Column:
    """The Column of a stored test over the columns of ``table``; a RuleError if any part of it is unknown or of the wrong type."""
    fields = {f.name: f.dataType for f in table.schema.fields}

    def build(t: dict) -> Column:
        if not isinstance(t, dict) or not t:
            raise RuleError(f"{rule}: a test is an object, not {t!r}")
        if "is" in t:
            return F.coalesce(_named(t, fields, rule), F.lit(False))
        if "col" in t:
            return _compared(t, fields, rule)
        if len(t) != 1 or not (op := next(iter(t))) in ("all", "any", "not"):
            raise RuleError(f"{rule}: a test has no part {', '.join(sorted(t))}")
        if op == "not":
            return ~build(t["not"])
        found = F.lit(op == "all")
        for part in t[op]:
            found = found & build(part) if op == "all" else found | build(part)
        return found

    return build(test)


def stored_rules(text: str) -> list[dict]:
    """Rules of a JSON list of {"id", "severity", "test"}."""
    rules = json.loads(text)
    for r in rules:
        if not isinstance(r, dict) or set(r) != {"id", "severity", "test"} or r["severity"] not in SEVERITIES:
            raise RuleError(f"a rule has id, severity and test: {r!r}")
    return rules


def apply_stored(table: DataFrame, rules: list[dict], *keep: str) -> DataFrame:
    """(*keep, inspection_id, severity) of every stored rule that holds, in one scan; all are compiled before the plan is made."""
    compiled = {f"{r['id']}#{i}": (r["severity"], compile_test(r["test"], table, r["id"])) for i, r in enumerate(rules)}
    return fused(table, compiled, *keep)
