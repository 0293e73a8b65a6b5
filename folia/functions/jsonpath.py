"""JSONPath and dotted paths as expressions over variants.

A path is compiled to a column: runs of keys and indexes are one ``variant_get``;
wildcards, slices and filters are array functions.  Only ``..`` needs Python, in
Arrow batches.  What isn't there (a missing key, an index out of range or below 0, a
step into a value of another kind, text that isn't JSON) gives no value, never an
error; a JSON null is a value.

    $.a.b[0]    $['odd key']    $.a[*].b    $.a.*    $.a[1:3]    $..b
    $.a[?(@.b > 3 && @.c == 'x')].d    $.a[?(@.b)]    $.a[?(!@.b || @.c != null)]
"""

from __future__ import annotations

import json
import operator
import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(
    r"""(?P<deep>\.\.)(?=[\w*\[])|\.?(?P<star>\*)|\.?(?P<key>[^.\[\]*'"?()\s][^.\[\]*]*)|\[\s*(?P<index>-?\d+)\s*\]|(?P<all>\[\s*\*\s*\])
    |\[\s*(?P<slice>-?\d*\s*:\s*-?\d*)\s*\]|\[\s*(?:'(?P<single>[^']*)'|"(?P<double>[^"]*)")\s*\]|\[\s*\?\s*\((?P<filter>(?:[^'")]|'[^']*'|"[^"]*")*)\)\s*\]""",
    re.X,
)
_TEST = re.compile(r"""^(?P<no>!)?\s*@(?P<path>[^=!<>]*?)\s*(?:(?P<op>==|!=|<=|>=|<|>)\s*(?P<value>.+))?$""")
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


@dataclass(frozen=True)
class Step:
    kind: str  # get, all, slice, filter or deep
    value: object = None


def parse(path: str) -> list[Step]:
    """The steps of a path; a path without ``$`` starts at the root too."""
    rest, out = path.strip().removeprefix("$"), []
    at = 0
    while at < len(rest):
        m = _STEP.match(rest, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read {rest[at:]!r} in the path {path!r}")
        at = m.end()
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind in ("key", "single", "double"):
            out.append(Step("get", value))
        elif kind == "index":
            out.append(Step("get", int(value)))
        elif kind in ("star", "all"):
            out.append(Step("all"))
        elif kind == "slice":
            lo, hi = (int(x) if x.strip() else None for x in value.split(":"))
            out.append(Step("slice", (lo, hi)))
        else:
            out.append(Step(kind, value))
    return out


def _spelled(keys: list[str | int]) -> str:
    """A path for variant_get."""
    out = "$"
    for k in keys:
        if isinstance(k, int):
            out += f"[{k}]"
        elif "'" not in k:
            out += f"['{k}']"
        elif '"' not in k:
            out += f'["{k}"]'
        else:
            raise ValueError(f"a key with both kinds of quotes: {k!r}")
    return out


def _get(v: Column, keys: list[str | int]) -> Column:
    if any(isinstance(k, int) and k < 0 for k in keys):
        return F.lit(None).cast("variant")
    return F.try_variant_get(v, _spelled(keys), "variant")


def _items(v: Column) -> Column:
    """The members of an array, or the values of an object by key; none of other values."""
    values = F.transform(F.array_sort(F.map_keys(_object(v))), lambda k: _object(v)[k])
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), values, F.array().cast("array<variant>"))


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _part(v: Column, lo: int | None, hi: int | None) -> Column:
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    n = F.size(items)
    bound = lambda x, other: other if x is None else F.lit(x) if x >= 0 else F.greatest(n + x, F.lit(0))
    return F.filter(items, lambda x, i: (i >= bound(lo, F.lit(0))) & (i < bound(hi, n)))


def _quoted(text: str) -> list[str]:
    """Pieces of a condition, cut at || and && outside quotes."""
    return re.findall(r"""\|\||&&|(?:[^|&'"]|'[^']*'|"[^"]*")+""", text)


def _condition(text: str, v: Column) -> Column:
    any_of, all_of = [], []
    for piece in [*_quoted(text), "||"]:
        if piece == "||":
            any_of.append(reduce(operator.and_, all_of))
            all_of = []
        elif piece != "&&":
            all_of.append(_test(piece.strip(), v))
    return reduce(operator.or_, any_of)


def _test(text: str, v: Column) -> Column:
    m = _TEST.match(text)
    steps = parse(m["path"]) if m else [Step("deep")]
    if any(s.kind != "get" for s in steps):
        raise ValueError(f"can't read the condition {text!r}")
    x = _get(v, [s.value for s in steps]) if steps else v
    if not m["op"]:
        return x.isNull() if m["no"] else x.isNotNull()
    value, compare = m["value"].strip(), _COMPARE[m["op"]]
    kind = F.schema_of_variant(x)
    if value == "null":
        return F.coalesce(compare(F.is_variant_null(x), F.lit(True)), F.lit(m["op"] == "!=")) & x.isNotNull()
    if value in ("true", "false"):
        got, of_kind = F.try_variant_get(x, "$", "boolean"), kind == "BOOLEAN"
        value = value == "true"
    elif value[0] in "'\"":
        got, of_kind, value = F.try_variant_get(x, "$", "string"), kind == "STRING", value[1:-1]
    else:
        got, of_kind, value = F.try_variant_get(x, "$", "double"), kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), float(value)
    # values of another kind differ, and are neither less nor greater
    return F.coalesce(of_kind & compare(got, F.lit(value)), F.lit(False)) | (x.isNotNull() & ~F.coalesce(of_kind, F.lit(False)) if m["op"] == "!=" else F.lit(False))


def _nodes(text: str | None) -> list[str]:
    """The JSON text of a value and of all below it, parents first."""
    try:
        todo, out = [json.loads(text)] if text is not None else [], []
    except ValueError:
        return []
    while todo:
        x = todo.pop()
        out.append(json.dumps(x, ensure_ascii=False))
        kids = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
        todo += reversed(kids)
    return out


def _below(v: Column) -> Column:
    @F.arrow_udf("array<string>")
    def every(texts: pa.Array) -> pa.Array:
        return pa.array([_nodes(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.transform(every(v), lambda t: F.try_parse_json(t))


# functions of one argument: a lambda's defaults would count as arguments of its own
def _getter(keys: list[str | int]):
    return lambda v: _get(v, keys)


def _slicer(lo: int | None, hi: int | None):
    return lambda v: _part(v, lo, hi)


def _chooser(condition: str):
    return lambda v: F.filter(_items(v), lambda x: _condition(condition, x))


def find_all(source: Column, path: str) -> Column:
    """array<variant>: everything the path finds in a column of JSON text, in order of the document."""
    steps = parse(path)
    if any(s.kind == "deep" for s in steps[1:]):
        raise ValueError(f"'..' is read at the start of a path only: {path!r}")
    found = F.array(F.try_parse_json(source))
    if steps and steps[0].kind == "deep":
        found, steps = _below(source), steps[1:]
    at = 0
    while at < len(steps):
        step, keys = steps[at], []
        while at < len(steps) and steps[at].kind == "get":
            keys.append(steps[at].value)
            at += 1
        if keys:
            found = F.transform(found, _getter(keys))
            continue
        at += 1
        if step.kind == "all":
            found = F.flatten(F.transform(found, _items))
        elif step.kind == "slice":
            found = F.flatten(F.transform(found, _slicer(*step.value)))
        else:
            found = F.flatten(F.transform(found, _chooser(step.value)))
    return F.filter(found, lambda v: v.isNotNull())


def find(source: Column, path: str) -> Column:
    """variant: the first value that the path finds, null if none."""
    steps = parse(path)
    if all(s.kind == "get" for s in steps):
        return _get(F.try_parse_json(source), [s.value for s in steps])
    return F.try_element_at(find_all(source, path), F.lit(1))


def dotted(source: Column, path: str) -> Column:
    """variant: a field of a record by names with dots; a number is an index in an array and else a key."""
    v = F.try_parse_json(source)
    for part in filter(None, path.replace("[", ".").replace("]", "").split(".")):
        v = F.coalesce(_get(v, [int(part)]), _get(v, [part])) if part.isdigit() else _get(v, [part])
    return v


def text(v: Column) -> Column:
    """A variant as text: strings as they are, other values as JSON."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))
