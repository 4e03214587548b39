"""Style rules in JSON, compiled to columns over a feature table.

An expression becomes a value and a flag that says whether its evaluation failed, which is neither true nor false. Kinds are known when
compiling: properties are typed columns; a missing property is null, which is a kind of its own when rules are evaluated.
Branches are nested, so that an earlier decisive operand hides later failures.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions import colors as C

#: Limits of an expression.
MOST_DEPTH, MOST_NODES, MOST_ARGUMENTS, MOST_TEXT = 32, 4096, 1024, 16384
#: Labels of a match that are compared one by one; more become a table.
MOST_COMPARED = 64
#: A constant of a rule of which only the shape is compiled: [PARAMETER, kind, number].
PARAMETER = "@"


def no() -> Column:
    return F.lit(False)


class RuleError(ValueError):
    """The rule itself is not valid."""


@dataclass(frozen=True)
class Value:
    """kind: null, boolean, number, string or array. failed: evaluation failed, so value counts for nothing."""

    kind: str
    value: Column
    failed: Column
    items: tuple | None = None


@dataclass
class Scope:
    """What rules can see: columns of properties by name and kind, the zoom and the geometry type."""

    properties: dict[str, tuple[str, Column]]
    zoom: Column | None = None
    geometry: Column | None = None
    #: Arrays of the constants of a rule whose shape is compiled: kind -> column.
    parameters: dict[str, Column] | None = None


def constant(x: Any) -> Value:
    if x is None:
        return Value("null", F.lit(None).cast("string"), no())
    if isinstance(x, bool):
        return Value("boolean", F.lit(x), no())
    if isinstance(x, (int, float)):
        if not math.isfinite(x):
            raise RuleError("numbers must be finite")
        return Value("number", F.lit(float(x)), no())
    if isinstance(x, str):
        return Value("string", F.lit(x), no())
    if isinstance(x, list):
        return Value("array", F.lit(None).cast("string"), no(), tuple(x))
    raise RuleError(f"no literal: {x!r}")


class Compiler:
    def __init__(self, scope: Scope) -> None:
        self.scope, self.nodes = scope, 0

    def of(self, e: Any, bound: dict[str, Value] | None = None, depth: int = 0) -> Value:
        self.nodes += 1
        if depth > MOST_DEPTH or self.nodes > MOST_NODES:
            raise RuleError("the rule is too large")
        if isinstance(e, dict):
            return self.of(from_function(e), bound, depth)
        if not isinstance(e, list):
            return self.tokens(e) if isinstance(e, str) and "{" in e else constant(e)
        if not e or not isinstance(e[0], str) or len(e) - 1 > MOST_ARGUMENTS:
            raise RuleError(f"no expression: {str(e)[:60]}")
        name, args = e[0], e[1:]
        run = OPERATORS.get(name)
        if run is None:
            raise RuleError(f"unknown operator {name}")
        return run(self, args, lambda x: self.of(x, bound, depth + 1), bound or {}, depth)

    def tokens(self, text: str) -> Value:
        """Text with {name} replaced by the property's text; an unclosed brace stays."""
        parts, rest = [], text
        while "{" in rest and "}" in rest[rest.index("{") :]:
            head, rest = rest.split("{", 1)
            name, rest = rest.split("}", 1)
            parts += [F.lit(head), text_of(self.get(name))]
        return Value("string", F.concat(*parts, F.lit(rest)), no())

    def get(self, name: str) -> Value:
        kind, column = self.scope.properties.get(name, ("null", F.lit(None).cast("string")))
        return Value(kind, column, no())


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def text_of(v: Value) -> Column:
    """Null: empty."""
    if v.kind == "number":
        return F.coalesce(number_text(v.value), F.lit(""))
    return F.lit("") if v.kind == "null" else F.coalesce(v.value.cast("string"), F.lit(""))


def equal(a: Value, b: Value) -> Column:
    if a.kind == b.kind == "array":
        return F.lit(a.items == b.items)
    if a.kind == b.kind:
        return a.value.eqNullSafe(b.value)
    return a.value.isNull() & b.value.isNull() if "array" not in (a.kind, b.kind) else no()


def truth(v: Value) -> tuple[Column, Column]:
    """(value, failed) as a condition: what is not a boolean fails."""
    if v.kind != "boolean":
        return no(), F.lit(True)
    return F.coalesce(v.value, no()), v.failed | v.value.isNull()


def kind_of(values: list[Value]) -> str:
    kinds = {v.kind for v in values} - {"null"}
    if len(kinds) > 1:
        raise RuleError(f"branches of kinds {sorted(kinds)}")
    return kinds.pop() if kinds else "null"


def cast(v: Value, kind: str) -> Column:
    return v.value if v.kind == kind else F.lit(None).cast({"number": "double", "boolean": "boolean"}.get(kind, "string"))


def _get(c, args, of, bound, depth):
    return c.get(args[0])


def _has(c, args, of, bound, depth):
    return Value("boolean", c.get(args[0]).value.isNotNull(), no())


def _geometry(c, args, of, bound, depth):
    return Value("string", F.lit(None).cast("string"), F.lit(True)) if c.scope.geometry is None else Value("string", c.scope.geometry, no())


def _zoom(c, args, of, bound, depth):
    return Value("number", F.lit(None).cast("double"), F.lit(True)) if c.scope.zoom is None else Value("number", c.scope.zoom.cast("double"), no())


def _same(negate: bool):
    def run(c, args, of, bound, depth):
        a, b = of(args[0]), of(args[1])
        hit = equal(a, b)
        return Value("boolean", ~hit if negate else hit, a.failed | b.failed)

    return run


def _order(compare):
    def run(c, args, of, bound, depth):
        a, b = of(args[0]), of(args[1])
        if a.kind != b.kind or a.kind not in ("number", "string"):
            return Value("boolean", no(), F.lit(True))
        fail = a.failed | b.failed | a.value.isNull() | b.value.isNull()
        out = compare(a.value, b.value)
        if a.kind == "number":  # what is no number is in no order
            out = out & ~F.isnan(a.value) & ~F.isnan(b.value)
        return Value("boolean", F.coalesce(out, no()), fail)

    return run


def _not(c, args, of, bound, depth):
    value, failed = truth(of(args[0]))
    return Value("boolean", ~value, failed)


def _all(decisive: bool):
    def run(c, args, of, bound, depth):
        value, failed = F.lit(not decisive), no()
        for a in reversed(args):
            v, f = truth(of(a))
            ends = v if decisive else ~v
            value, failed = F.when(f, no()).when(ends, F.lit(decisive)).otherwise(value), F.when(f, F.lit(True)).when(ends, no()).otherwise(failed)
        return Value("boolean", value, failed)

    return run


def _in(c, args, of, bound, depth):
    needle, hit, failed = of(args[0]), no(), None
    failed = needle.failed
    for a in args[1:]:
        v = of(a)
        failed = failed | v.failed
        for x in [constant(i) for i in v.items] if v.kind == "array" else [v]:
            hit = hit | equal(needle, x)
    return Value("boolean", hit, failed)


def _case(c, args, of, bound, depth):
    branches, last = [(truth(of(a)), of(b)) for a, b in zip(args[:-1:2], args[1::2], strict=False)], of(args[-1])
    kind = kind_of([*(v for _, v in branches), last])
    value, failed = cast(last, kind), last.failed
    for (t, f), v in reversed(branches):
        value, failed = F.when(~f & t, cast(v, kind)).otherwise(value), F.when(f, F.lit(True)).when(t, v.failed).otherwise(failed)
    return Value(kind, value, failed)


def _coalesce(c, args, of, bound, depth):
    values = [of(a) for a in args]
    kind = kind_of(values)
    return Value(kind, F.coalesce(*[F.when(~v.failed, cast(v, kind)) for v in values]), no())


def _concat(c, args, of, bound, depth):
    values = [of(a) for a in args if not isinstance(a, dict)]
    out = F.concat(*[text_of(v) for v in values])
    failed = no()
    for v in values:
        failed = failed | v.failed
    return Value("string", out, failed | (F.length(out) > MOST_TEXT))


def choose(at: Column, values: list[Column], first: int = 0) -> Column:
    """The value of number `at`, told by halves: few comparisons for many values."""
    if len(values) == 1:
        return values[0]
    half = len(values) // 2
    return F.when(at < first + half, choose(at, values[:half], first)).otherwise(choose(at, values[half:], first + half))


def bucket_of(x: str | float, n: int) -> int:
    return (zlib.crc32(x.encode()) if isinstance(x, str) else math.floor(x)) % n


def looked_up(needle: Value, labels: list[list]) -> Column:
    """The number of the first list that holds the needle, or null: labels lie in small buckets of a constant table, by a hash of theirs (numbers: by their whole part)."""
    kind = needle.kind
    own = [(x, k) for k, group in enumerate(labels) for x in group if isinstance(x, str if kind == "string" else (int, float)) and not isinstance(x, bool)]
    n = max(1, len(own) // 2)
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for x, k in own:
        if all(y["x"] != x for y in buckets[bucket_of(x, n)]):
            buckets[bucket_of(x, n)].append({"x": x, "k": k})
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<x:{'string' if kind == 'string' else 'double'},k:int>>>")
    v = needle.value
    at = F.crc32(v.cast("binary")) if kind == "string" else F.floor(v)
    found = F.get(F.filter(F.get(table, F.pmod(at, F.lit(n)).cast("int")), lambda e: e["x"] == v), F.lit(0))
    return found["k"]


def _match(c, args, of, bound, depth):
    needle, last = of(args[0]), of(args[-1])
    arms = [(a if isinstance(a, list) else [a], of(b)) for a, b in zip(args[1:-1:2], args[2::2], strict=False)]
    kind = kind_of([*(v for _, v in arms), last])
    if sum(len(labels) for labels, _ in arms) > MOST_COMPARED and needle.kind in ("string", "number") and all(x is not None for labels, _ in arms for x in labels):
        at = F.coalesce(looked_up(needle, [labels for labels, _ in arms]), F.lit(len(arms)))
        every = [v for _, v in arms] + [last]
        return Value(kind, choose(at, [cast(v, kind) for v in every]), needle.failed | choose(at, [v.failed for v in every]))
    value, failed = cast(last, kind), last.failed
    for labels, v in reversed(arms):
        hit = no()
        for x in labels:
            hit = hit | equal(needle, constant(x))
        value, failed = F.when(hit, cast(v, kind)).otherwise(value), F.when(hit, v.failed).otherwise(failed)
    return Value(kind, value, needle.failed | failed)


def increasing(c, stops: list) -> list[float] | list[Column]:
    """Stops of a rule, or columns of a shape's: those were checked when the shape was taken."""
    if stops and all(isinstance(s, list) and s[:2] == [PARAMETER, "number"] for s in stops):
        return [c.of(s).value for s in stops]
    if any(not isinstance(s, (int, float)) for s in stops) or any(a >= b for a, b in zip(stops, stops[1:], strict=False)):
        raise RuleError("stops must increase")
    return [float(s) for s in stops]


def _step(c, args, of, bound, depth):
    x, outs = of(args[0]), [of(a) for a in args[1::2]]
    stops, kind = increasing(c, args[2::2]), kind_of(outs)
    value, failed = cast(outs[-1], kind), outs[-1].failed
    for stop, v in reversed(list(zip(stops, outs[:-1], strict=True))):
        value, failed = F.when(x.value < stop, cast(v, kind)).otherwise(value), F.when(x.value < stop, v.failed).otherwise(failed)
    return Value(kind, value, failed | x.failed | x.value.isNull() if x.kind == "number" else F.lit(True))


def _interpolate(c, args, of, bound, depth):
    form, x = args[0], of(args[1])
    base = 1.0 if form[0] == "linear" else float(form[1])
    stops, outs = increasing(c, args[2::2]), [of(a) for a in args[3::2]]
    kind = kind_of(outs)
    if kind not in ("number", "string", "null") or x.kind != "number":
        return Value("number", F.lit(None).cast("double"), F.lit(True))
    value, failed = cast(outs[-1], kind), x.failed | x.value.isNull()
    for v in outs:
        failed = failed | v.failed | v.value.isNull()

    def between(a: Value, b: Value, t: Column) -> Column:
        return a.value + (b.value - a.value) * t if kind != "string" else C.lerp_color(a.value, b.value, t)

    def power(e: float | Column) -> float | Column:
        return F.pow(F.lit(base), e) if isinstance(e, Column) else base**e

    for k in range(len(stops) - 2, -1, -1):
        a, b = stops[k], stops[k + 1]
        t = (x.value - a) / (b - a) if base == 1 else (power(x.value - a) - 1) / (power(b - a) - 1)
        value = F.when(x.value < b, between(outs[k], outs[k + 1], t)).otherwise(value)
    value = F.when(x.value <= stops[0], outs[0].value).otherwise(value)
    # Texts between stops must be colours; at the ends any text stands as it is.
    return Value(kind, value, failed | value.isNull() if kind == "string" else failed)


def _parameter(c, args, of, bound, depth):
    if c.scope.parameters is None or args[0] not in c.scope.parameters:
        raise RuleError(f"unknown operator {PARAMETER}")
    return Value(args[0], F.get(c.scope.parameters[args[0]], F.lit(args[1])), no())


def _literal_or(c, args, of, bound, depth):
    """The first argument unless it failed or is null, else the second: how older functions fall back."""
    v, other = of(args[0]), of(args[1])
    kind = kind_of([v, other])
    good = ~v.failed & v.value.isNotNull()
    return Value(kind, F.when(good, cast(v, kind)).otherwise(cast(other, kind)), ~good & other.failed)


def _let(c, args, of, bound, depth):
    inner = dict(bound)
    for name, e in zip(args[:-1:2], args[1::2], strict=False):
        inner[name] = c.of(e, inner, depth + 1)
    return c.of(args[-1], inner, depth + 1)


def _var(c, args, of, bound, depth):
    if args[0] not in bound:
        raise RuleError(f"unknown variable {args[0]}")
    return bound[args[0]]


def _string(c, args, of, bound, depth):
    v = of(args[0])
    return Value("string", text_of(v), F.lit(True) if v.kind == "array" else v.failed)


def _fold(join):
    def run(c, args, of, bound, depth):
        values = [of(a) for a in args]
        if any(v.kind != "number" for v in values) or len(values) < 2:
            return Value("number", F.lit(None).cast("double"), F.lit(True))
        out, failed = values[0].value, values[0].failed
        for v in values[1:]:
            out, failed = join(out, v.value), failed | v.failed
        return Value("number", out, failed | F.coalesce(F.isnan(out) | (F.abs(out) == float("inf")), F.lit(True)) | out.isNull())

    return run


def _number(c, args, of, bound, depth):
    values = [v for v in map(of, args) if v.kind == "number"]
    out = F.coalesce(*[F.when(~v.failed, v.value) for v in values]) if values else F.lit(None).cast("double")
    return Value("number", out, out.isNull())


OPERATORS = {
    "literal": lambda c, a, of, b, d: constant(a[0]), "get": _get, "has": _has, "geometry-type": _geometry, "zoom": _zoom, "==": _same(False), "!=": _same(True),
    "<": _order(lambda a, b: a < b), "<=": _order(lambda a, b: a <= b), ">": _order(lambda a, b: a > b), ">=": _order(lambda a, b: a >= b), "!": _not, "all": _all(False), "any": _all(True), "in": _in, "case": _case,
    "coalesce": _coalesce, "concat": _concat, "format": _concat, "match": _match, "step": _step, "interpolate": _interpolate, "let": _let, "var": _var, "to-string": _string, "+": _fold(lambda a, b: a + b), "*": _fold(lambda a, b: a * b), "number": _number, "value-or": _literal_or, PARAMETER: _parameter,
}


def compile_expression(rule: Any, scope: Scope) -> Value:
    return Compiler(scope).of(rule)


def from_function(f: dict) -> list:
    """A function of the older form (stops, and on demand property, type, base, default) as an expression: categorical ones match their stops, interval ones and those whose
    outputs lie on no line step between them, all others are interpolated. Functions of a property fall back to the default where the property is no number."""
    stops, name, kind, base = f.get("stops"), f.get("property"), f.get("type", "exponential"), f.get("base", 1)
    pairs = isinstance(stops, list) and 0 < len(stops) <= MOST_ARGUMENTS // 2 and all(isinstance(s, list) and len(s) == 2 and not isinstance(s[0], (list, dict)) for s in stops)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    if not pairs or kind not in ("categorical", "interval", "exponential") or not number(base) or base <= 0 or (name is not None and (not isinstance(name, str) or not 0 < len(name) <= MOST_TEXT)):
        raise RuleError(f"no function: {str(f)[:60]}")
    x, other = ["zoom"] if name is None else ["get", name], ["literal", f.get("default")]
    outs = [["literal", v] for _, v in stops]
    if kind == "categorical" or not all(number(s) for s, _ in stops):
        arms = [part for (s, _), v in zip(stops, outs, strict=True) for part in (s, v)]
        return ["match", x, *arms, other]
    on_line = all(number(v) for _, v in stops) or all(isinstance(v, str) and C.is_color(v) for _, v in stops)
    if kind == "interval" or not on_line:
        run = ["step", x, outs[0], *[part for (s, _), v in zip(stops[1:], outs[1:], strict=True) for part in (s, v)]]
    else:
        run = ["interpolate", ["linear"] if base == 1 else ["exponential", base], x, *[part for (s, _), v in zip(stops, outs, strict=True) for part in (s, v)]]
    return run if name is None else ["value-or", run, other]


def from_legacy(f: list) -> list:
    """A filter of the older form as an expression."""
    name, args = f[0], f[1:]
    key = lambda k: ["geometry-type"] if k == "$type" else ["get", k]
    if name in ("all", "any"):
        return [name, *map(from_legacy, args)]
    if name == "none":
        return ["!", ["any", *map(from_legacy, args)]]
    if args and args[0] == "$id":
        raise RuleError("$id is not supported")
    if name == "has":
        return ["has", args[0]]
    if name == "!has":
        return ["!", ["has", args[0]]]
    if name in ("in", "!in"):
        hit = ["in", key(args[0]), ["literal", list(args[1:])]]
        return hit if name == "in" else ["!", hit]
    if name in ("==", "!=", "<", "<=", ">", ">="):
        return [name, key(args[0]), args[1]]
    raise RuleError(f"unknown filter {name}")


def is_legacy(f: list) -> bool:
    """Whether a filter is of the older form."""
    if f[0] in ("none", "!has", "!in") or (f[0] in ("==", "!=", "<", "<=", ">", ">=", "in", "has") and len(f) > 1 and isinstance(f[1], str)):
        return True
    inner = [x for x in f[1:] if isinstance(x, list) and x]
    return f[0] in ("all", "any") and any(x[0] in ("none", "!has", "!in") or (len(x) > 1 and isinstance(x[1], str) and x[0] not in ("get", "has", "!", "var", PARAMETER)) for x in inner)


def compile_filter(f: list | None, scope: Scope) -> tuple[Column, Column]:
    """(match, failed) of a filter in either form; no filter matches everything."""
    if f is None:
        return F.lit(True), no()
    value, failed = truth(compile_expression(from_legacy(f) if is_legacy(f) else f, scope))
    return value & ~failed, failed


def shape_of(rule: Any, numbers: list[float], texts: list[str]) -> Any:
    """rule with the constants that rules of one kind differ in taken out, into numbers and texts: values, and stops. Labels, names and lists stay. Rules of one shape are compiled once."""

    def walk(e: Any, depth: int = 0) -> Any:
        if depth > MOST_DEPTH:
            raise RuleError("the rule is too large")
        if isinstance(e, bool) or e is None or isinstance(e, str) and "{" in e:
            return e
        if isinstance(e, (int, float)):
            if not math.isfinite(e):
                raise RuleError("numbers must be finite")
            numbers.append(float(e))
            return [PARAMETER, "number", len(numbers) - 1]
        if isinstance(e, str):
            texts.append(e)
            return [PARAMETER, "string", len(texts) - 1]
        if isinstance(e, dict):
            return walk(from_function(e), depth)
        if not e or not isinstance(e[0], str) or e[0] == PARAMETER:
            raise RuleError(f"no expression: {str(e)[:60]}")
        name, args, down = e[0], e[1:], lambda x: walk(x, depth + 1)
        if name == "literal":
            return down(args[0]) if len(args) == 1 and not isinstance(args[0], (list, dict)) else e
        if name in ("get", "has", "var", "zoom", "geometry-type", "format"):
            return e
        if name == "match":
            return [name, down(args[0]), *[down(x) if k % 2 or k == len(args) - 2 else x for k, x in enumerate(args[1:])]]
        if name == "in":
            return [name, down(args[0]), *args[1:]]
        if name == "let":
            return [name, *[x if k % 2 == 0 and k < len(args) - 1 else down(x) for k, x in enumerate(args)]]
        if name in ("step", "interpolate"):
            head = 1 if name == "step" else 2
            stops = args[2::2]
            if any(isinstance(s, bool) or not isinstance(s, (int, float)) for s in stops) or any(a >= b for a, b in zip(stops, stops[1:], strict=False)):
                raise RuleError("stops must increase")
            return [name, *(args[:1] if head == 2 else []), *map(down, args[head - 1 :])]
        return [name, *map(down, args)]

    return walk(rule)
