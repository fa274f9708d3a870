"""The condition language: boolean trees over transactions, as columns of fits.

A tree becomes one nullable double column: null is no match, a number in 0 to 1 how
well it fits. Trees that differ in their values only have one shape: it is built once
when the plan is made, and the values of each entry are columns. Transaction leaves read ``merchant, cents, date, account, institution``;
the leaves of the second pass read ``labels`` (array of names) and ``matched`` (array
of structs of the entries that a transaction already belongs to).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import ANCHOR_TOLERANCE, days_in_month

#: Leaves about the calendar, which the first pass checks before the rest of a tree.
TIMING = ("date_day_of_month", "recurrence_anchor")
PAYEE = ("payee_exact", "payee_contains", "payee_not_contains", "payee_starts_with", "payee_ends_with", "payee_regex", "imported_payee_one_of")
#: Type of the structs in ``matched``.
MATCHED = "array<struct<entry:string,label:string,direction:string,type:string,period:int,source:string,overall:double,merchant_fit:double,timing:double,amount:double,rate:double,anchor:string>>"


class ConditionError(ValueError):
    """A tree that cannot be compiled; its entry is left out, others go on."""


def yes(test: Column, fit: Column | float = 1.0) -> Column:
    return F.when(test, F.lit(fit) if isinstance(fit, float) else fit)


def _need(node: dict, name: str):
    if node.get(name) is None:
        raise ConditionError(f"{node.get('type')} lacks {name}")
    return node[name]


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _covered(needle: Column, low: float) -> Column:
    """Fit of a partial match: more for a needle that makes up more of the name."""
    share = F.octet_length(needle) / F.greatest(F.octet_length("merchant"), F.lit(1))
    return F.least(F.lit(1.0), F.lit(low) + F.lit(0.15) * share)


def _between(value: Column, low, high) -> Column:
    test = F.lit(True)
    if low is not None:
        test = test & (value >= _value(low))
    if high is not None:
        test = test & (value <= _value(high))
    return test


def _payee(node: dict) -> Column:
    name = F.lower("merchant")
    kind, value = node["type"], _need(node, "value")
    if kind == "imported_payee_one_of":
        names = value if isinstance(value, Column) else F.array(*(F.lit(str(v)) for v in value)).cast("array<string>")
        return yes(F.exists(names, lambda v: F.lower(v) == name))
    if kind == "payee_regex" and not isinstance(value, Column):
        try:
            re.compile(str(value))
        except re.error as e:
            raise ConditionError(f"bad pattern {value!r}: {e}") from e
    value = value if isinstance(value, Column) else F.lit(str(value))
    low = F.lower(value)
    if kind == "payee_exact":
        return yes(name == low)
    if kind == "payee_contains":
        return yes(name.contains(low), _covered(value, 0.75))
    if kind == "payee_not_contains":
        return yes(~name.contains(low))
    if kind == "payee_starts_with":
        return yes(name.startswith(low), _covered(value, 0.85))
    if kind == "payee_ends_with":
        return yes(name.endswith(low), _covered(value, 0.85))
    return yes(F.regexp_like("merchant", value))


def _anchor(anchor: str) -> tuple[str, list[int]]:
    """Kind and numbers of an anchor."""
    kind, _, rest = anchor.partition(":")
    numbers = [int(x) for x in rest.split(",")] if re.fullmatch(r"-?[0-9]+(,-?[0-9]+)*", rest) else []
    if kind not in ("dom", "dow", "interval") or not numbers:
        raise ConditionError(f"bad anchor {anchor!r}")
    return kind, numbers


def anchor_fits(kind: str, numbers: Column) -> Column:
    """Whether a date lies on its anchor: within the tolerance for days of month, exactly for weekdays."""
    if kind == "dow":
        return F.weekday("date") == F.get(numbers, F.lit(0))
    if kind == "interval":
        return F.lit(False)  # a matter of the entry's other transactions, see operators.match
    dim = days_in_month(F.col("date"))

    def near(n: Column) -> Column:
        day = F.when(n > 0, F.when(n <= dim, n)).when(dim + n + 1 >= 1, dim + n + 1)
        return F.coalesce(F.abs(F.dayofmonth("date") - day) < ANCHOR_TOLERANCE, F.lit(False))

    return F.exists(numbers, near)


def _recurrence(node: dict) -> Column:
    if "numbers" in node:
        return yes(anchor_fits(node["kind"], node["numbers"]))
    kind, numbers = _anchor(str(_need(node, "recurrence_anchor")))
    return yes(anchor_fits(kind, F.array(*map(F.lit, numbers))))


def _same_id(column: str, value) -> Column:
    """Equal ids; one that comes from a table of entries is text."""
    return F.col(column).cast("string") == value if isinstance(value, Column) else F.col(column) == F.lit(value)


def _direction(node: dict) -> Column:
    wanted = _need(node, "direction")
    has = lambda d: F.exists("matched", lambda m: m["direction"].isin(d, "mixed"))
    income, spend = (F.col("cents") > 0) | has("income"), (F.col("cents") < 0) | has("spend")
    if wanted == "mixed":
        return yes((F.size("matched") == 0) | (income & spend))
    if wanted not in ("income", "spend"):
        raise ConditionError(f"no direction: {wanted}")
    return yes((income if wanted == "income" else spend) & ~(spend if wanted == "income" else income))


def _fitness(node: dict) -> Column:
    """One entry must pass all gates ``score: {name: {min, max}}``; an unknown score fails."""
    names = {"overall": "overall", "merchant": "merchant_fit", "timing": "timing", "amount": "amount"}
    gates = [(names[k], g) for k, g in (node.get("score") or {}).items() if k in names and g]

    def all_gates(m: Column) -> Column:
        tests = [F.coalesce(_between(m[f], g.get("min"), g.get("max")), F.lit(False)) for f, g in gates]
        return functools.reduce(lambda a, b: a & b, tests, F.lit(True))

    return yes(F.exists("matched", all_gates))


def _any_between(name: str, low, high) -> Column:
    return yes(F.exists("matched", lambda m: F.coalesce(m[name].isNotNull() & _between(m[name], low, high), F.lit(False))))


def _any_equal(name: str, value) -> Column:
    return yes(F.exists("matched", lambda m: F.coalesce(m[name] == _value(value), F.lit(False))))


LEAVES: dict[str, Callable[[dict], Column]] = {
    **dict.fromkeys(PAYEE, _payee),
    "amount_range": lambda n: yes(_between(F.col("cents"), n.get("min_cents"), n.get("max_cents"))),
    "date_day_of_month": lambda n: yes(F.abs(F.dayofmonth("date") - _value(_need(n, "day")).cast("int")) <= _value(n.get("tolerance_days", 0)).cast("int")),
    "date_range": lambda n: yes(F.col("date").between(*(_value(_need(n, k)).cast("date") for k in ("start", "end")))),
    "recurrence_anchor": _recurrence,
    "account_id": lambda n: yes(_same_id("account", _need(n, "value"))),
    "institution_id": lambda n: yes(F.coalesce(_same_id("institution", _need(n, "value")), F.lit(False))),
    "label_matched": lambda n: yes(F.array_contains("labels", _value(_need(n, "label_id")))),
    "entry_direction": _direction,
    "entry_type": lambda n: _any_equal("type", _need(n, "entry_type")),
    "entry_source": lambda n: _any_equal("source", _need(n, "source")),
    "entry_recurrence_anchor": lambda n: _any_equal("anchor", _need(n, "recurrence_anchor")),
    "entry_period": lambda n: _any_between("period", n.get("min_days"), n.get("max_days")),
    "entry_projected_rate": lambda n: _any_between("rate", n.get("min"), n.get("max")),
    "entry_fitness": _fitness,
}
#: Other names of leaves.
ALIASES = {f"imported_{k}": k for k in ("payee_exact", "payee_contains", "payee_not_contains", "payee_starts_with", "payee_ends_with", "payee_regex")} | {"account": "account_id", "institution": "institution_id"}
#: Leaves that name something by id, and the field that holds the id.
NAMED = {"account_id": "value", "institution_id": "value", "label_matched": "label_id"}


#: Fields that a leaf cannot do without.
NEEDED = {
    **{kind: ("value",) for kind in (*PAYEE, "account_id", "institution_id")},
    "date_day_of_month": ("day",), "date_range": ("start", "end"), "recurrence_anchor": ("recurrence_anchor",), "label_matched": ("label_id",),
    "entry_direction": ("direction",), "entry_type": ("entry_type",), "entry_source": ("source",), "entry_recurrence_anchor": ("recurrence_anchor",),
}


def check_tree(node: dict) -> None:
    """Raise ConditionError for a tree that cannot be compiled; looks at values only, so it also runs inside tasks."""
    if not isinstance(node, dict):
        raise ConditionError(f"no condition: {node!r}")
    op, children = node.get("op"), node.get("children") or []
    if op is not None:
        if not (op in ("AND", "OR") or op == "NOT" and len(children) == 1 or op == "XOR" and len(children) == 2):
            raise ConditionError(f"{op} with {len(children)} conditions")
        for c in children:
            check_tree(c)
        return
    kind = ALIASES.get(node.get("type"), node.get("type"))
    if kind not in LEAVES:
        raise ConditionError(f"unknown condition {node.get('type')!r}")
    for name in NEEDED.get(kind, ()):
        _need(node, name)
    if kind == "payee_regex":
        try:
            re.compile(str(node["value"]))
        except re.error as e:
            raise ConditionError(f"bad pattern {node['value']!r}: {e}") from e
    if kind == "recurrence_anchor":
        _anchor(str(node["recurrence_anchor"]))
    if kind == "entry_direction" and node["direction"] not in ("income", "spend", "mixed"):
        raise ConditionError(f"no direction: {node['direction']}")


def compile_tree(node: dict, met: Callable[[dict], bool] = lambda leaf: False) -> Column:
    """The fit of a tree. Leaves for which ``met`` holds count as met, with fit 1."""
    if not isinstance(node, dict):
        raise ConditionError(f"no condition: {node!r}")
    op = node.get("op")
    if op is None:
        kind = ALIASES.get(node.get("type"), node.get("type"))
        if kind not in LEAVES:
            raise ConditionError(f"unknown condition {node.get('type')!r}")
        leaf = LEAVES[kind]({**node, "type": kind})
        return F.lit(1.0) if met(node) else leaf
    children = [compile_tree(c, met) for c in node.get("children") or []]
    if op == "AND":
        met_all = functools.reduce(lambda a, b: a & b, (c.isNotNull() for c in children), F.lit(True))
        return F.when(met_all, F.least(F.lit(1.0), F.lit(1.0), *children))
    if op == "OR":
        return F.greatest(F.lit(None).cast("double"), F.lit(None).cast("double"), *children)
    if op == "NOT" and len(children) == 1:
        return F.when(children[0].isNull(), 1.0)
    if op == "XOR" and len(children) == 2:
        a, b = children
        return F.when(a.isNull(), b).when(b.isNull(), a)
    raise ConditionError(f"{op} with {len(children)} conditions")


#: Fields of a leaf that may differ within a shape, and the type in which they come from text.
FIELDS = {
    **{kind: {"value": "string"} for kind in (*PAYEE, "account_id", "institution_id")},
    "imported_payee_one_of": {"value": "array<string>"},
    "amount_range": {"min_cents": "bigint", "max_cents": "bigint"},
    "date_day_of_month": {"day": "int", "tolerance_days": "int"},
    "date_range": {"start": "date", "end": "date"},
    "label_matched": {"label_id": "string"},
    "entry_type": {"entry_type": "string"},
    "entry_source": {"source": "string"},
    "entry_recurrence_anchor": {"recurrence_anchor": "string"},
    "entry_period": {"min_days": "int", "max_days": "int"},
    "entry_projected_rate": {"min": "double", "max": "double"},
}


def shape_of(tree: dict) -> tuple[str, list[str]]:
    """A tree without its values, as text, and these values in order. Values of other leaves stay in the shape."""
    values: list[str] = []

    def strip(leaf: dict) -> dict:
        kind = ALIASES.get(leaf.get("type"), leaf.get("type"))
        out = {**leaf, "type": kind}
        if kind == "recurrence_anchor" and leaf.get("recurrence_anchor") is not None:
            out["kind"], numbers = _anchor(str(out.pop("recurrence_anchor")))
            out["numbers"] = len(values)
            values.append(",".join(map(str, numbers)))
            return {k: out[k] for k in ("type", "kind", "numbers")}
        for name in FIELDS.get(kind, {}):
            if out.get(name) is not None:
                values.append("\x1f".join(map(str, out[name])) if isinstance(out[name], list) else str(out[name]))
                out[name] = len(values) - 1
        return {k: v for k, v in out.items() if k == "type" or v is not None}

    return json.dumps(map_leaves(tree, strip), sort_keys=True), values


def of_shape(shape: str, values: Column) -> dict:
    """A tree with columns in the places of its values."""

    def fill(leaf: dict) -> dict:
        if leaf["type"] == "recurrence_anchor" and "numbers" in leaf:
            return {**leaf, "numbers": F.split(F.get(values, F.lit(leaf["numbers"])), ",").cast("array<int>")}
        for name, kind in FIELDS.get(leaf["type"], {}).items():
            if name in leaf:
                text = F.get(values, F.lit(leaf[name]))
                leaf[name] = F.split(text, "\x1f") if kind == "array<string>" else text.cast(kind)
        return leaf

    return map_leaves(json.loads(shape), fill)


def leaves(node: dict, top_only: bool = False) -> list[dict]:
    """The leaves of a tree; or those that stand alone or directly below an AND at the top."""
    if node.get("op") is None:
        return [node]
    if top_only:
        return [c for c in node.get("children") or [] if node["op"] == "AND" and c.get("op") is None]
    return [x for c in node.get("children") or [] for x in leaves(c)]


def interval_of(node: dict) -> int | None:
    """Days of the interval anchor at the top of a tree; one further down cannot be evaluated and is an error."""

    def days(leaf: dict) -> int | None:  # of a tree with its values
        found = re.fullmatch(r"interval:([0-9]+)", str(leaf.get("recurrence_anchor"))) if leaf.get("type") == "recurrence_anchor" else None
        return int(found[1]) if found else None

    top = [d for d in map(days, leaves(node, True)) if d is not None]
    if len(top) != len([d for d in map(days, leaves(node)) if d is not None]):
        raise ConditionError("an interval anchor must stand at the top or below its AND")
    return top[0] if top else None


def map_leaves(node: dict, change: Callable[[dict], dict]) -> dict:
    """A tree with each leaf changed: ids to names, cents to dollars, and back."""
    if node.get("op") is not None:
        return {**node, "children": [map_leaves(c, change) for c in node.get("children") or []]}
    return change(dict(node))


def to_display(node: dict, names: dict[str, str]) -> dict:
    """Stored form to shown form: dollars for cents, names for ids."""

    def change(leaf: dict) -> dict:
        for k in ("min", "max"):
            if leaf.get("type") == "amount_range" and leaf.get(f"{k}_cents") is not None:
                leaf[k] = leaf.pop(f"{k}_cents") / 100
        if name := NAMED.get(ALIASES.get(leaf.get("type"), leaf.get("type"))):
            leaf[name] = names.get(leaf.get(name), leaf.get(name))
        return leaf

    return map_leaves(node, change)


def to_storage(node: dict, ids: dict[str, str]) -> dict:
    """Shown form to stored form; a name without an id is an error. Names are compared without case."""
    known = {k.lower(): v for k, v in ids.items()}

    def change(leaf: dict) -> dict:
        for k in ("min", "max"):
            if leaf.get("type") == "amount_range" and leaf.get(k) is not None:
                leaf[f"{k}_cents"] = round(leaf.pop(k) * 100)
        if name := NAMED.get(ALIASES.get(leaf.get("type"), leaf.get("type"))):
            if str(leaf.get(name)).lower() not in known:
                raise ConditionError(f"nothing is named {leaf.get(name)!r}")
            leaf[name] = known[str(leaf[name]).lower()]
        return leaf

    return map_leaves(node, change)
