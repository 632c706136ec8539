"""What Column expressions cannot say: Unicode normal forms, canonical JSON, sequence matching, numerals, expression checks."""

from __future__ import annotations

import ast
import difflib
import hashlib
import json
import operator
import re
import unicodedata
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nfkc_text(text: str | None) -> str | None:
    return None if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def canonical(value: str | None, compact: bool = True) -> str | None:
    """JSON with sorted keys and no escapes; null for null or broken input."""
    try:
        return json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":") if compact else None)
    except (TypeError, ValueError):
        return None


def sequence_ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio()


#: Numerals and their worth.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
POWERS = {"十": 10, "百": 100, "千": 1000}


def numeral(text: str | None) -> int | None:
    """A whole number in digits or Chinese numerals up to 99,999,999; null for anything else."""
    if not text:
        return None
    if text.isascii() and text.isdigit():
        return int(text)
    total = part = digit = 0
    for c in text:
        if c in DIGITS:
            digit = DIGITS[c]
        elif c in POWERS:
            part += (digit or 1) * POWERS[c]
            digit = 0
        elif c == "万":
            total += (part + digit) * 10_000
            part = digit = 0
        else:
            return None
    return total + part + digit


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}


def evaluate(expression: str) -> Fraction:
    """An exact value of + - * / ** (small whole powers) and parentheses; ValueError for anything else."""

    def of(node: ast.AST) -> Fraction:
        if isinstance(node, ast.Expression):
            return of(node.body)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return Fraction(str(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub | ast.UAdd):
            return -of(node.operand) if isinstance(node.op, ast.USub) else of(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
            return _OPERATORS[type(node.op)](of(node.left), of(node.right))
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow) and (p := of(node.right)).denominator == 1 and 0 <= p <= 64:
            return of(node.left) ** int(p)
        raise ValueError("not an arithmetic expression")

    text = unicodedata.normalize("NFKC", expression).translate(str.maketrans("×÷−", "*/-")).replace("^", "**")
    try:
        return of(ast.parse(text.strip(), mode="eval"))
    except (SyntaxError, ZeroDivisionError, RecursionError) as e:
        raise ValueError(str(e)) from e


def quadratic_roots(a: int, b: int, c: int) -> list[int]:
    """Whole roots of a x^2 + b x + c, ascending."""
    if a == 0:
        return [-c // b] if b and c % b == 0 else []
    d = b * b - 4 * a * c
    if d < 0:
        return []
    r = int(d**0.5)
    while r * r > d:
        r -= 1
    while (r + 1) * (r + 1) <= d:
        r += 1
    return sorted({n // (2 * a) for n in (-b - r, -b + r) if n % (2 * a) == 0}) if r * r == d else []


class Validators:
    """Three-valued checks by id: each gives (status, evidence); an unknown id is unsupported, a second registration an error."""

    def __init__(self):
        self.known = {}

    def register(self, name: str):
        if name in self.known:
            raise ValueError(f"{name} is registered already")

        def add(f):
            self.known[name] = f
            return f

        return add

    def run(self, name: str, stem: str | None, answer: str | None) -> tuple[str, str]:
        check = self.known.get(name)
        return ("unsupported", "unknown_validator") if check is None else check(stem or "", answer or "")


VALIDATORS = Validators()


def _answer_value(answer: str) -> Fraction | None:
    try:
        return evaluate(answer)
    except ValueError:
        return None


@VALIDATORS.register("arithmetic")
def _arithmetic(stem: str, answer: str) -> tuple[str, str]:
    """An expression before an equals sign and blank, against the answer."""
    found = re.search(r"([-\d.+*/×÷^() −]+)=\s*[?？_]*\s*$", stem)
    if not found:
        return "unsupported", "no_expression"
    try:
        value = evaluate(found[1])
    except ValueError:
        return "unsupported", "no_expression"
    given = _answer_value(answer)
    return ("unsupported", "no_numeric_answer") if given is None else ("pass" if given == value else "fail", f"computed {value}")


@VALIDATORS.register("triangle")
def _triangle(stem: str, answer: str) -> tuple[str, str]:
    """Whether three whole lengths make a triangle, against yes or no."""
    sides = sorted(map(int, re.findall(r"\d+", stem)))
    said = {"yes": True, "no": False, "能": True, "不能": False}.get(answer.strip().lower())
    if len(sides) != 3 or said is None:
        return "unsupported", "not_three_sides_and_a_verdict"
    makes = sides[0] + sides[1] > sides[2]
    return ("pass" if makes == said else "fail"), f"computed {makes}"


@VALIDATORS.register("isosceles_perimeter")
def _isosceles(stem: str, answer: str) -> tuple[str, str]:
    """All perimeters of an isosceles triangle with two given sides, as a set."""
    sides = list(map(int, re.findall(r"\d+", stem)))
    if len(sides) != 2:
        return "unsupported", "not_two_sides"
    a, b = sides
    real = {x + x + y for x, y in ((a, b), (b, a)) if 2 * x > y}
    given = set(map(int, re.findall(r"\d+", answer)))
    return ("unsupported", "no_numeric_answer") if not given else ("pass" if given == real else "fail", f"computed {sorted(real)}")


@VALIDATORS.register("quadratic")
def _quadratic(stem: str, answer: str) -> tuple[str, str]:
    found = re.search(r"(-?\d*)x\^2([+-]\d*)x([+-]\d+)=0", stem.replace(" ", ""))
    if not found:
        return "unsupported", "no_equation"
    one = lambda s: int(s + "1") if s in ("", "+", "-") else int(s)
    roots = quadratic_roots(one(found[1]), one(found[2]), int(found[3]))
    if not roots:
        return "unsupported", "no_whole_roots"
    return ("pass" if sorted(set(map(int, re.findall(r"-?\d+", answer)))) == roots else "fail"), f"computed {roots}"


def repair_json(text: str | None) -> str | None:
    """The outermost JSON of a text with code fences or stray backslashes, canonical; null if there is none."""
    if text is None:
        return None
    body = re.sub(r"```[a-zA-Z]*", "", text)
    at = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    end = max(body.rfind("}"), body.rfind("]"))
    if at < 0 or end < at:
        return None
    body = body[at : end + 1]
    return canonical(body) or canonical(re.sub(r'\\(?![\\/"bfnrtu])', r"\\\\", body))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(nfkc_text)


@F.pandas_udf(T.StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (c := canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest())


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(repair_json)


@F.pandas_udf(T.DoubleType())
def similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.LongType())
def numeral_value(text: pd.Series) -> pd.Series:
    return text.map(numeral).astype("Int64")


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("evidence", T.StringType())]))
def validate(name: pd.Series, stem: pd.Series, answer: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([VALIDATORS.run(*x) for x in zip(name, stem, answer, strict=True)], columns=["status", "evidence"])
