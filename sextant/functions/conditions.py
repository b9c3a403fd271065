"""Three-valued conditions: `cfg` predicates, C `#if` expressions and Python platform tests.

Each evaluator gives True, False or None (unknown); an unknown condition excludes nothing.
They are small parsers over short strings, so as columns they are Arrow UDFs over the distinct
conditions, joined back; `and`, `or` and `not` of boolean columns are SQL's own.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(values: list[bool | None]) -> bool | None:
    return False if False in values else None if None in values else True


def any_of(values: list[bool | None]) -> bool | None:
    return True if True in values else None if None in values else False


def not_(value: bool | None) -> bool | None:
    return None if value is None else not value


class _Tokens:
    def __init__(self, text: str, pattern: str):
        self.items, self.at = re.findall(pattern, text), 0

    def peek(self) -> str:
        return self.items[self.at] if self.at < len(self.items) else ""

    def next(self) -> str:
        self.at += 1
        return self.items[self.at - 1] if self.at <= len(self.items) else ""


def cfg(text: str, host: dict[str, set[str] | bool]) -> bool | None:
    """A `cfg` predicate: all(..), any(..), not(..), a name, or name = "value". `host` tells what
    it decides: True or False for a bare name, the set of values of a key. Others are unknown."""
    tokens = _Tokens(text, r'"[^"]*"|\w+|[(),=]')

    def one() -> bool | None:
        name = tokens.next()
        if tokens.peek() == "(":
            tokens.next()
            inner = []
            while tokens.peek() not in (")", ""):
                inner.append(one())
                if tokens.peek() == ",":
                    tokens.next()
            tokens.next()
            return {"all": all_of, "any": any_of, "not": lambda v: not_(v[0]) if len(v) == 1 else None}.get(name, lambda v: None)(inner)
        if tokens.peek() == "=":
            tokens.next()
            value = tokens.next().strip('"')
            known = host.get(name)
            return value in known if isinstance(known, set) else None
        if name in ("true", "false"):
            return name == "true"
        known = host.get(name)
        return known if isinstance(known, bool) else bool(known) if isinstance(known, set) else None

    return one() if tokens.items else None


_LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
_U64 = (1 << 64) - 1


def c_if(text: str, macros: dict[str, str | None], depth: int = 0) -> int | None:
    """Value of a C `#if` expression in 64-bit arithmetic, signed unless an operand is unsigned.
    `macros` holds each known macro's text, or None where it is known not to be defined; a
    macro it does not hold is unknown, and so is what depends on it."""
    got = _c_value(text, macros, depth)
    return None if got is None else got[0]


def _wrap(value: int, unsigned: bool) -> tuple[int, bool]:
    value &= _U64
    return (value if unsigned or value < 1 << 63 else value - (1 << 64)), unsigned


def _c_value(text: str, macros: dict[str, str | None], depth: int) -> tuple[int, bool] | None:
    text = re.sub(r"/\*.*?\*/|//.*", " ", text)
    tokens = _Tokens(text, r"0[xX][0-9a-fA-F]+[uUlL]*|0[bB][01]+[uUlL]*|\d+[uUlL]*|'(?:\\.|[^'\\])'|\w+|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%<>!~&|^?:(),]")

    def primary():
        t = tokens.next()
        if t == "(":
            v = ternary()
            tokens.next()
            return v
        if t in ("!", "~", "-", "+"):
            v = primary()
            if v is None:
                return None
            return (int(not v[0]), False) if t == "!" else _wrap({"~": ~v[0], "-": -v[0], "+": v[0]}[t], v[1])
        if t == "defined":
            bracket = tokens.peek() == "("
            if bracket:
                tokens.next()
            name = tokens.next()
            if bracket:
                tokens.next()
            return None if name not in macros else (int(macros[name] is not None), False)
        if re.match(r"\d", t):
            digits = t.rstrip("uUlL")
            base = 8 if re.fullmatch(r"0[0-7]+", digits) else 0
            return _wrap(int(digits, base), "u" in t[len(digits):].lower())
        if t.startswith("'"):
            return ord(ast.literal_eval(t)), False
        if re.match(r"[A-Za-z_]", t):
            if t in ("true", "false"):
                return int(t == "true"), False
            if tokens.peek() == "(":  # a function-like macro
                level = 0
                while tokens.peek():
                    level += {"(": 1, ")": -1}.get(tokens.next(), 0)
                    if not level:
                        break
                return None
            if t not in macros:
                return None
            if macros[t] is None:
                return 0, False
            return _c_value(macros[t], macros, depth + 1) if depth < 16 and macros[t].strip() else None
        return None

    def binary(level: int):
        if level == len(_LEVELS):
            return primary()
        left = binary(level + 1)
        while tokens.peek() in _LEVELS[level] and tokens.peek():
            op = tokens.next()
            left = _c_apply(op, left, binary(level + 1))
        return left

    def ternary():
        test = binary(0)
        if tokens.peek() != "?":
            return test
        tokens.next()
        one = ternary()
        tokens.next()
        two = ternary()
        return None if test is None else one if test[0] else two

    return ternary() if tokens.items else None


def _c_apply(op: str, a, b):
    if op in ("&&", "||"):
        known = [None if v is None else bool(v[0]) for v in (a, b)]
        got = all_of(known) if op == "&&" else any_of(known)
        return None if got is None else (int(got), False)
    if a is None or b is None:
        return None
    unsigned = a[1] or b[1]
    x, y = _wrap(a[0], unsigned)[0], _wrap(b[0], unsigned)[0]
    if op in ("==", "!=", "<", ">", "<=", ">="):
        return int({"==": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]), False
    if op in ("<<", ">>"):
        return _wrap(a[0] << (b[0] & 63) if op == "<<" else a[0] >> (b[0] & 63), a[1])
    if op in ("/", "%"):
        if not y:
            return None
        q = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        return _wrap(q if op == "/" else x - q * y, unsigned)
    return _wrap({"+": x + y, "-": x - y, "*": x * y, "&": x & y, "|": x | y, "^": x ^ y}[op], unsigned)


def python_if(text: str, host: dict[str, object]) -> bool | None:
    """A Python platform test: `host` holds the values of names such as sys.platform, os.name,
    sys.version_info (a tuple) and TYPE_CHECKING; tests of anything else are unknown."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError):
        return None
    missing = object()

    def value(node):
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Tuple | ast.List):
            items = [value(e) for e in node.elts]
            return missing if missing in items else tuple(items)
        if isinstance(node, ast.Name | ast.Attribute):
            name = ast.unparse(node)
            return host.get(name, host.get(name.rpartition(".")[2] if name.startswith("typing.") else name, missing))
        if isinstance(node, ast.Subscript) and (base := value(node.value)) is not missing and isinstance(base, tuple | str):
            try:
                return base[ast.literal_eval(node.slice)]
            except (ValueError, IndexError, TypeError):
                return base[: node.slice.upper.value] if isinstance(node.slice, ast.Slice) and node.slice.lower is None and isinstance(node.slice.upper, ast.Constant) else missing
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("startswith", "endswith", "lower") and not node.keywords:
            base, args = value(node.func.value), [value(a) for a in node.args]
            return getattr(base, node.func.attr)(*args) if isinstance(base, str) and missing not in args else missing
        return missing

    def truth(node) -> bool | None:
        if isinstance(node, ast.BoolOp):
            return (all_of if isinstance(node.op, ast.And) else any_of)([truth(v) for v in node.values])
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return not_(truth(node.operand))
        if isinstance(node, ast.Compare):
            left, out = value(node.left), []
            for op, right_node in zip(node.ops, node.comparators, strict=True):
                right = value(right_node)
                if missing in (left, right) if not isinstance(left, tuple) and not isinstance(right, tuple) else left is missing or right is missing:
                    return None
                try:
                    out.append({ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: lambda a, b: a is b, ast.IsNot: lambda a, b: a is not b}[type(op)](left, right))
                except (TypeError, KeyError):
                    return None
                left = right
            return all_of(out)
        got = value(node)
        return None if got is missing else bool(got)

    return truth(tree)


def evaluated(df: DataFrame, condition: str, evaluate: Callable[[str], bool | None], name: str) -> DataFrame:
    """`df` with a nullable boolean of its condition column, each distinct condition evaluated once."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else (None if (v := evaluate(t)) is None else bool(v)) for t in texts], dtype=object)

    known = df.select(condition).where(F.col(condition).isNotNull()).distinct().withColumn(name, of(F.col(condition)))
    return df.join(known, condition, "left")


def kept(condition: Column) -> Column:
    """Whether a branch may be live: true or unknown."""
    return F.coalesce(condition, F.lit(True))
