"""Rules as text, compiled to columns; text outside the language is rejected.

A rule is ``lambda value, row=None: <expression>`` of comparisons, boolean and
arithmetic operators, membership, conditionals, string methods, ``len``,
``safe_float`` and full or partial pattern matches. Nothing is evaluated as
Python: each node becomes a column, and a null or failing rule is false.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracell.functions import numeric


class Rejected(ValueError):
    """Why a rule is not in the language."""


@dataclass(frozen=True)
class Rule:
    name: str
    column: str
    family: str
    text: str


_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_ARITH = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b}
_METHODS = {
    "strip": F.trim, "lower": F.lower, "upper": F.upper, "isdigit": lambda s: s.rlike(r"^\p{Nd}+$"), "isalpha": lambda s: s.rlike(r"^\p{L}+$"), "isalnum": lambda s: s.rlike(r"^[\p{L}\p{Nd}]+$"),
    "isupper": lambda s: (F.upper(s) == s) & s.rlike(r"\p{L}"), "islower": lambda s: (F.lower(s) == s) & s.rlike(r"\p{L}"), "isspace": lambda s: s.rlike(r"^\s+$"),
}


class _Compiler:
    def __init__(self, value: Column, columns: set[str]):
        self.value, self.columns = value, columns

    def column(self, node) -> Column:
        out = self(node)
        return out if isinstance(out, Column) else F.lit(out)

    def __call__(self, n):
        method = getattr(self, "on_" + type(n).__name__, None)
        if method is None:
            raise Rejected(f"{type(n).__name__} is not in the rule language")
        return method(n)

    def on_Constant(self, n):
        if n.value is Ellipsis:
            raise Rejected("the rule is a stub")
        return n.value

    def on_Name(self, n):
        if n.id == "value":
            return self.value
        raise Rejected(f"unknown name {n.id}")

    def on_Tuple(self, n):
        return [self(e) for e in n.elts]

    on_List = on_Set = on_Tuple

    def on_Subscript(self, n):
        if isinstance(n.value, ast.Name) and n.value.id == "row":
            return self._field(self(n.slice))
        if isinstance(n.slice, ast.Slice) and n.slice.step is None:
            s = self.column(n.value)
            lo, hi = (None if x is None else self(x) for x in (n.slice.lower, n.slice.upper))
            if any(isinstance(x, int) and x < 0 for x in (lo, hi)):
                raise Rejected("negative slices are not in the rule language")
            return F.substring(s, (lo or 0) + 1, 1 << 30 if hi is None else hi - (lo or 0))
        raise Rejected("only row fields and slices can be indexed")

    def _field(self, name):
        if name not in self.columns:
            raise Rejected(f"no column {name}")
        return F.col(f"`{name}`").cast("string")

    def on_UnaryOp(self, n):
        if isinstance(n.op, ast.Not):
            return ~F.coalesce(self.column(n.operand), F.lit(False))
        if isinstance(n.op, ast.USub):
            return -self(n.operand)
        raise Rejected("unknown sign")

    def on_BoolOp(self, n):
        parts = [F.coalesce(self.column(v), F.lit(False)) for v in n.values]
        return reduce((lambda a, b: a & b) if isinstance(n.op, ast.And) else (lambda a, b: a | b), parts)

    def on_BinOp(self, n):
        if type(n.op) not in _ARITH:
            raise Rejected("unknown operator")
        if isinstance(n.op, ast.Add) and any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (n.left, n.right)):
            return F.concat(self.column(n.left), self.column(n.right))
        return _ARITH[type(n.op)](self.column(n.left), self.column(n.right))

    def on_IfExp(self, n):
        return F.when(F.coalesce(self.column(n.test), F.lit(False)), self.column(n.body)).otherwise(self.column(n.orelse))

    def on_Compare(self, n):
        out, left = [], n.left
        for op, right in zip(n.ops, n.comparators):
            if isinstance(op, (ast.Is, ast.IsNot)):
                if not (isinstance(right, ast.Constant) and right.value is None):
                    raise Rejected("'is' only with None")
                c = self.column(left).isNull()
                out.append(c if isinstance(op, ast.Is) else ~c)
            elif isinstance(op, (ast.In, ast.NotIn)):
                items = self(right)
                c = self.column(left).isin(*items) if isinstance(items, list) else self.column(right).contains(self.column(left))
                out.append(c if isinstance(op, ast.In) else ~c)
            else:
                out.append(_COMPARE[type(op)](self.column(left), self.column(right)))
            left = right
        return reduce(lambda a, b: a & b, out)

    def on_Call(self, n):
        if n.keywords:
            raise Rejected("keyword arguments are not in the rule language")
        f = n.func
        if isinstance(f, ast.Name):
            if f.id in ("str", "parse") and len(n.args) == 1:
                return self.column(n.args[0]).cast("string")
            if f.id in ("float", "int", "safe_float") and len(n.args) == 1:
                return numeric.safe_float(self.column(n.args[0]))
            if f.id == "len" and len(n.args) == 1:
                return F.length(self.column(n.args[0]))
            if f.id == "bool" and len(n.args) == 1:
                arg = n.args[0]
                inner = self.column(arg)
                is_match = isinstance(arg, ast.Call) and isinstance(arg.func, ast.Attribute) and getattr(arg.func.value, "id", "") == "re"
                return inner if is_match or isinstance(arg, (ast.Compare, ast.BoolOp)) else F.coalesce(F.length(inner.cast("string")) > 0, F.lit(False))
            if f.id == "abs" and len(n.args) == 1:
                return F.abs(self.column(n.args[0]))
        if isinstance(f, ast.Attribute):
            owner = getattr(f.value, "id", None)
            if owner == "re" and f.attr in ("match", "fullmatch", "search") and len(n.args) == 2:
                pattern = self(n.args[0])
                if not isinstance(pattern, str):
                    raise Rejected("a pattern must be a literal")
                shaped = {"match": f"^(?:{pattern})", "fullmatch": f"^(?:{pattern})$", "search": pattern}[f.attr]
                return self.column(n.args[1]).rlike(shaped)
            if owner == "pd" and f.attr in ("isna", "isnull", "notna", "notnull"):
                c = self.column(n.args[0]).isNull()
                return c if f.attr.startswith("is") else ~c
            if owner == "row" and f.attr == "get":
                return self._field(self(n.args[0]))
            if f.attr in _METHODS and not n.args:
                return _METHODS[f.attr](self.column(f.value))
            if f.attr in ("startswith", "endswith") and len(n.args) == 1:
                s, arg = self.column(f.value), self(n.args[0])
                options = arg if isinstance(arg, list) else [arg]
                return reduce(lambda a, b: a | b, [getattr(s, f.attr)(o) for o in options])
            if f.attr == "replace" and len(n.args) == 2:
                return F.replace(self.column(f.value), self.column(n.args[0]), self.column(n.args[1]))
        raise Rejected("this call is not in the rule language")


def compile_rule(text: str, column: str, columns: list[str]) -> Column:
    """The rule as a boolean column, false where it can't be decided."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise Rejected(f"syntax: {e.msg}") from e
    if not isinstance(tree, ast.Lambda) or not tree.args.args or tree.args.args[0].arg != "value":
        raise Rejected("a rule is a lambda of value")
    out = _Compiler(F.col(f"`{column}`").cast("string"), set(columns))(tree.body)
    if not isinstance(out, Column):
        raise Rejected("the rule is constant")
    return F.coalesce(out.cast("boolean"), F.lit(False))


def outputs(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """row_idx and a boolean column for each rule, in one projection."""
    return df.select("row_idx", *[compile_rule(r.text, r.column, df.columns).alias(r.name) for r in rules])


def violation_rates(df: DataFrame, rules: list[Rule], clean: bool = True) -> DataFrame:
    """rule, n, n_violations, rate: all rules in one aggregation. A clean rule is
    violated where it is false, a dirty one where it is true."""
    hits = [F.count_if(~compile_rule(r.text, r.column, df.columns) if clean else compile_rule(r.text, r.column, df.columns)).alias(f"_{k}") for k, r in enumerate(rules)]
    one = df.agg(F.count("*").alias("n"), *hits)
    each = [F.struct(F.lit(r.name).alias("rule"), F.col("n"), F.col(f"_{k}").alias("n_violations")) for k, r in enumerate(rules)]
    return one.select(F.inline(F.array(*each))).withColumn("rate", F.col("n_violations") / F.col("n"))


def validate(df: DataFrame, rules: list[Rule], least: float = 0.5) -> list[tuple[Rule, str]]:
    """Each rule with ``accepted`` or the reason it is not."""
    good, out = [], []
    for r in rules:
        try:
            compile_rule(r.text, r.column, df.columns)
            good.append(r)
        except Rejected as e:
            out.append((r, str(e)))
    if good:
        rates = {x.rule: 1 - x.rate if x.n else 1.0 for x in violation_rates(df, good).collect()}  # a row a rule
        for r in good:
            p = rates[r.name]
            verdict = "accepted" if r.family == "missing" or p >= least else f"pass rate {p:.3f} below {least}"
            constant = r.family != "missing" and p in (0, 1)
            out.append((r, f"degenerate: {'never' if p == 0 else 'always'} true" if constant else verdict))
    return out


def provenance(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """row_idx, evaluated, failed and passed rule names, pass ratio."""
    items = [F.struct(F.lit(r.name).alias("rule"), compile_rule(r.text, r.column, df.columns).alias("ok")) for r in rules]
    d = df.select("row_idx", F.array(*items).alias("r"))
    names = lambda c: F.transform(c, lambda i: i["rule"])
    failed = F.filter("r", lambda i: ~i["ok"])
    return d.select("row_idx", F.size("r").alias("evaluated"), F.array_join(names(failed), ",").alias("failed"), F.array_join(names(F.filter("r", lambda i: i["ok"])), ",").alias("passed"),
                    (1 - F.size(failed) / F.size("r")).alias("pass_ratio"))


def pass_ratios(df: DataFrame, by_column: dict[str, list[Rule]]) -> DataFrame:
    """row_idx, column and the share of the column's rules that the row passes."""
    one = lambda r: compile_rule(r.text, r.column, df.columns).cast("int")
    each = [F.struct(F.lit(c).alias("column"), (sum((one(r) for r in rs), F.lit(0)) / len(rs)).alias("ratio")) for c, rs in by_column.items()]
    return df.select("row_idx", F.inline(F.array(*each)))


def fallback_rules(column: str, kind: str, low: float | None = None, high: float | None = None, lengths: tuple[int, int] | None = None, tokens: tuple[str, ...] = ()) -> list[Rule]:
    """Deterministic clean rules: completeness, range with 5 % to spare, lengths."""
    out = [Rule(f"{column}_complete", column, "missing", f"lambda value, row=None: value is not None and value.strip().lower() not in {tuple(sorted(set(tokens) | {''}))!r}")]
    if kind == "numeric" and low is not None and high is not None:
        slack = 0.05 * (high - low)
        out.append(Rule(f"{column}_range", column, "outlier", f"lambda value, row=None: {low - slack!r} <= safe_float(value) <= {high + slack!r}"))
    elif lengths:
        out.append(Rule(f"{column}_length", column, "outlier", f"lambda value, row=None: {max(0, lengths[0] - 2)} <= len(str(value)) <= {lengths[1] + 4}"))
    return out


def dirty_fallbacks(column: str, low: float | None = None, high: float | None = None, tokens: tuple[str, ...] = ()) -> list[Rule]:
    out = [Rule(f"{column}_token", column, "missing", f"lambda value, row=None: value is None or value.strip().lower() in {tuple(sorted(set(tokens) | {''}))!r}")]
    if low is not None and high is not None and high > 1000:
        out.append(Rule(f"{column}_large", column, "outlier", f"lambda value, row=None: safe_float(value) > {0.5 * high!r}"))
    if low is not None and low >= 0:
        out.append(Rule(f"{column}_negative", column, "outlier", "lambda value, row=None: safe_float(value) < 0"))
    return out


GUESSES = (("zip", r"[0-9]{5}"), ("phone", r"[0-9]{10}"), ("damaged_code", r"[0-9x]{5}"), ("short_code", r"[0-9.]{3,5}"), ("digits", r"[0-9]+"))


def guess_pattern(samples: list[str]) -> str:
    """What kind of code a column's samples (at most 20 are asked) look like."""
    few = [s for s in samples if s][:20]
    if not few:
        return "none"
    kind = next((k for k, p in GUESSES if all(re.fullmatch(p, s) for s in few[:10])), "unclear")
    return f"{kind}:{'even' if len({len(s) for s in few}) <= 2 else 'mixed'}" if kind == "digits" else kind


def pattern_fallbacks(column: str, samples: list[str], guess: str | None = None) -> list[Rule]:
    """Clean rules of form: a postal code, a telephone number, or one fixed length."""
    guess, low = guess or guess_pattern(samples), column.lower()
    rule = lambda name, body: [Rule(f"{column}_{name}", column, "pattern", f"lambda value, row=None: {body}")]
    if guess == "zip" or "zip" in low or "postal" in low:
        return rule("postal", "bool(re.fullmatch(r'[0-9]{5}', value.strip()))")
    if guess == "phone" or "phone" in low:
        return rule("phone", "bool(re.fullmatch(r'([^0-9]*[0-9]){10}[^0-9]*', value))")
    sizes = {len(s.strip()) for s in samples if s and s.strip()}
    return rule("length", f"len(value.strip()) == {sizes.pop()}") if len(sizes) == 1 else []


def relation_rules(relations: list[tuple[str, str, str]]) -> list[Rule]:
    """Clean rules of (column, other column, kind); a missing side passes."""
    body = {
        "prefix_match": "value.strip().lower().startswith(row[{o!r}].strip().lower())",
        "contains": "row[{o!r}].strip().lower() in value.strip().lower()",
        "stateavg_format": "value.strip().lower().startswith(row[{o!r}].strip().lower() + '_')",
        "zip_prefix": "value.strip()[0:3] == row[{o!r}].strip()[0:3]",
    }
    text = "lambda value, row=None: True if value is None or row[{o!r}] is None else "
    return [Rule(f"{c}_{kind}_{o}", c, "relationship", (text + body[kind]).format(o=o)) for c, o, kind in relations]


def order_rule(first: str, then: str) -> Rule:
    """A clean rule: of two dates written year first the second isn't earlier."""
    return Rule(f"{then}_not_before_{first}", then, "relationship", f"lambda value, row=None: True if value is None or row[{first!r}] is None else value >= row[{first!r}]")


def typo_rules(column: str, typos: list[str], most: int = 5) -> list[Rule]:
    """Dirty rules from values known as typos: one for each length, then one of all."""
    groups: dict[int, list[str]] = {}
    for t in sorted({t.strip().lower() for t in typos if t.strip()}):
        groups.setdefault(len(t), []).append(t)
    out = []
    for n, own in sorted(groups.items()):
        kind = "value.strip().isdigit() and " if all(t.isdigit() for t in own) else "value.strip().isalpha() and " if all(t.isalpha() for t in own) else ""
        out.append(Rule(f"{column}_typo_{n}", column, "typo", f"lambda value, row=None: {kind}len(value.strip()) == {n} and value.strip().lower() in {tuple(own)!r}"))
    every = tuple(t for own in groups.values() for t in own)[:20]
    return [*out[: most - 1], Rule(f"{column}_typo", column, "typo", f"lambda value, row=None: value.strip().lower() in {every!r}")] if every else []


def pattern_negation(column: str, patterns: list[str], samples: list[str] = ()) -> list[Rule]:
    """A dirty rule: the value has none of the patterns, or, without any, isn't a
    number of the samples' length."""
    if patterns:
        either = "|".join(f"(?:{p})" for p in patterns)
        return [Rule(f"{column}_off_pattern", column, "pattern", f"lambda value, row=None: value is not None and not bool(re.fullmatch({either!r}, value.strip()))")]
    few = [s for s in samples if s][:10]
    if few and all(s.isdigit() for s in few):
        return [Rule(f"{column}_off_digits", column, "pattern", f"lambda value, row=None: value is not None and not (value.isdigit() and len(value) == {len(few[0])})")]
    return [Rule(f"{column}_blank", column, "pattern", "lambda value, row=None: len(value.strip()) == 0")] if few else []


DUAL_MISSING = ("", "n/a", "na", "nan", "none", "null", "unknown")


def dual_fallbacks(column: str, kind: str, top_values: tuple[str, ...] = (), bound: float = 1e9) -> tuple[list[Rule], list[Rule]]:
    """A clean rule that accepts what is plausible and a dirty one that takes the
    rest: numbers within a bound, known values, or anything that isn't missing."""
    gone = f"value.strip().lower() in {DUAL_MISSING!r}"
    if kind == "numeric":
        ok, bad = f"-{bound!r} <= safe_float(value) <= {bound!r}", f"safe_float(value) < -{bound!r} or safe_float(value) > {bound!r}"
    elif kind == "categorical" and top_values:
        known = tuple(sorted({v.strip().lower() for v in top_values if v.strip()}))
        ok, bad = f"value.strip().lower() in {known!r}", f"value.strip().lower() not in {known!r}"
    else:
        ok, bad = "len(value.strip()) > 0", "len(value.strip()) == 0"
    return ([Rule(f"{column}_plausible", column, "dual", f"lambda value, row=None: value is not None and not ({gone}) and ({ok})")],
            [Rule(f"{column}_implausible", column, "dual", f"lambda value, row=None: value is None or {gone} or ({bad})")])


FAMILY = {"completeness": "missing", "accuracy": "outlier", "pattern_consistency": "pattern", "column_relationship": "relationship"}


def rule_pool(df: DataFrame, proposals: dict[str, list[tuple[str, str]]], least: float = 0.5) -> tuple[dict[str, list[Rule]], list[dict]]:
    """The accepted rules of each column, and every proposal with its verdict.

    ``proposals`` has (agent, rule text) by column; an agent decides the family,
    unknown ones are left out. All rules are judged in one aggregation.
    """
    named = [(agent, Rule(f"{c}_{agent}_{k}", c, FAMILY[agent], text)) for c, own in proposals.items() for k, (agent, text) in enumerate(own) if agent in FAMILY]
    verdicts = {r.name: v for r, v in validate(df, [r for _, r in named], least)}
    pool: dict[str, list[Rule]] = {}
    for _, r in named:
        if verdicts[r.name] == "accepted":
            pool.setdefault(r.column, []).append(r)
    return pool, [{"column": r.column, "agent": a, "family": r.family, "rule": r.name, "text": r.text, "verdict": verdicts[r.name]} for a, r in named]


def shown(value, most: int = 80) -> str:
    """A rule's value for display."""
    text = str(value)
    return text if len(text) <= most else text[: most - 3] + "..."
