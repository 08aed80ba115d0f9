"""Worksheet formulas: syntax trees, evaluation of whole workbooks, and translation of references.

A workbook is the unit of work: its cells come together in one task, where formulas are evaluated in the
order of their references. Row-wise formulas over columns of large tables are plain Columns instead
(``leafmill.functions.numbers``, ``leafmill.operators.aggregates``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RANGE = 200_000
VALUES = "book string, sheet int, row int, col int, kind string, num double, text string, bool boolean, error string"


class SheetError(Exception):
    """An error value such as ``#DIV/0!``; ``UNSUP`` and ``#PARSE`` mean that a formula cannot be evaluated at all."""

    def __init__(self, code: str) -> None:
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Ref:
    """A cell or a range of a sheet; ``sheet`` is a name or None for the formula's own."""

    sheet: str | None
    r0: int
    c0: int
    r1: int
    c1: int
    one: bool


@dataclass
class Node:
    op: str
    args: list = field(default_factory=list)
    value: Any = None


class Range(list):
    """Values of a range, row by row."""


# ---------------------------------------------------------------- syntax

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<str>"(?:[^"]|"")*"?)
    |(?P<ref>(?:(?:'[^']+'|[A-Za-z_][\w.]*)!)?\$?[A-Za-z]{1,3}\$?\d+(?::\$?[A-Za-z]{1,3}\$?\d+)?(?![\w(]))
    |(?P<num>\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)
    |(?P<word>[A-Za-z_][\w.]*)
    |(?P<op><>|<=|>=|[-+*/^&=<>(),;%])""",
    re.VERBOSE,
)
_CELL = re.compile(r"\$?([A-Za-z]+)\$?(\d+)$")
#: Operators by binding strength; all associate to the left.
_BINARY = ({"=", "<>", "<", ">", "<=", ">="}, {"&"}, {"+", "-"}, {"*", "/"}, {"^"})


def letters_to_index(name: str) -> int:
    n = 0
    for c in name.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def index_to_letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def tokenize(formula: str) -> list[tuple[str, str]]:
    at, out = 0, []
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if not m:
            raise SheetError("#PARSE")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


def parse_ref(text: str) -> Ref:
    sheet, _, cells = text.rpartition("!")
    a, _, b = cells.partition(":")
    (ca, ra), (cb, rb) = (_CELL.match(x).groups() for x in (a, b or a))
    rows, cols = sorted((int(ra) - 1, int(rb) - 1)), sorted((letters_to_index(ca), letters_to_index(cb)))
    return Ref(sheet.strip("'") or None, rows[0], cols[0], rows[1], cols[1], not b)


class Parser:
    """Operator precedence: comparison, ``&``, sums, products, powers, then signs, then ``%``; all to the left."""

    def __init__(self, formula: str) -> None:
        self.tokens = tokenize(formula)
        self.at = 0

    def parse(self) -> Node:
        node = self.binary(0)
        if self.at < len(self.tokens):
            raise SheetError("#PARSE")
        return node

    def eat(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def binary(self, level: int) -> Node:
        if level == len(_BINARY):
            return self.signed()
        node = self.binary(level + 1)
        while op := self.eat(*_BINARY[level]):
            node = Node(op, [node, self.binary(level + 1)])
        return node

    def signed(self) -> Node:
        if op := self.eat("-", "+"):
            return Node("neg" if op == "-" else "pos", [self.signed()])
        node = self.primary()
        while self.eat("%"):
            node = Node("percent", [node])
        return node

    def primary(self) -> Node:
        if self.at >= len(self.tokens):
            raise SheetError("#PARSE")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Node("value", value=float(text))
        if kind == "str":
            closed = len(text) > 1 and text.endswith('"')
            return Node("value", value=text[1 : -1 if closed else None].replace('""', '"'))
        if kind == "ref":
            return Node("ref", value=parse_ref(text))
        if text == "(":
            node = self.binary(0)
            if not self.eat(")"):
                raise SheetError("#PARSE")
            return node
        if kind == "word":
            word = text.upper()
            if word in ("TRUE", "FALSE"):
                return Node("value", value=word == "TRUE")
            if self.eat("("):
                return Node("call", self.arguments(), word)
            return Node("name", value=word)
        raise SheetError("#PARSE")

    def arguments(self) -> list[Node]:
        out: list[Node] = []
        if self.eat(")"):
            return out
        while True:
            if self.at < len(self.tokens) and self.tokens[self.at][1] in (",", ";", ")") and self.tokens[self.at][0] == "op":
                out.append(Node("value", value=""))
            else:
                out.append(self.binary(0))
            if not self.eat(",", ";"):
                break
        if not self.eat(")"):
            raise SheetError("#PARSE")
        return out


@lru_cache(50_000)
def parse(formula: str) -> Node:
    """The tree of a formula; trees are only read, so workbooks of equal formulas share them."""
    return Parser(formula.removeprefix("=")).parse()


def references(node: Node) -> Iterator[Ref]:
    if node.op == "ref":
        yield node.value
    for a in node.args:
        yield from references(a)


# ---------------------------------------------------------------- values

_NUMERIC = re.compile(r"-?\d+(\.\d+)?([eE][-+]?\d+)?$")


def to_number(v: Any) -> float | None:
    """A number out of any value; blanks are 0; None if the text is no number."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, (int, float)):
        return float(v)
    s = re.sub(r"[\s ]", "", str(v))
    if not s:
        return 0.0
    if _NUMERIC.match(s):
        return float(s)
    if re.match(r"-?\d+,\d+$", s):
        return float(s.replace(",", "."))
    if re.match(r"-?\d+(\.\d+)?%$", s):
        return float(s[:-1]) / 100
    return None


def is_numeric(v: Any) -> bool:
    return not isinstance(v, bool) and (isinstance(v, (int, float)) or (isinstance(v, str) and v.strip() != "" and to_number(v) is not None))


def first(v: Any) -> Any:
    return (v[0] if v else "") if isinstance(v, Range) else v


def number(v: Any) -> float:
    v = first(v)
    if isinstance(v, str) and v.startswith("#"):
        raise SheetError(v)
    n = to_number(v)
    if n is None:
        raise SheetError("#VALUE!")
    return n


def show(n: float) -> str:
    """A number as text, without a point where it is whole."""
    return str(int(n)) if n == math.floor(n) and abs(n) < 1e21 else repr(n)


def text(v: Any) -> str:
    v = first(v)
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    return show(v) if isinstance(v, (int, float)) else v


def truth(v: Any) -> bool:
    v = first(v)
    if isinstance(v, str):
        if v.upper() in ("TRUE", "FALSE", ""):
            return v.upper() == "TRUE"
    return number(v) != 0


def compare(a: Any, b: Any, op: str) -> bool:
    a, b = first(a), first(b)
    if isinstance(a, str) and isinstance(b, str):
        x, y = a.lower(), b.lower()
    else:
        # a number against text that is none: nothing holds but <>
        x, y = (float("nan") if (isinstance(v, str) and to_number(v) is None) else (to_number(v)) for v in (a, b))
    return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def criterion(condition: Any) -> Callable[[Any], bool]:
    """A10: a comparison and a value; no wildcards."""
    op, rhs = re.match(r"(<>|<=|>=|=|<|>)?(.*)$", text(condition), re.DOTALL).groups()
    op = op or "="
    return lambda v: compare(number(v), number(rhs), op) if is_numeric(rhs) and is_numeric(v) else compare(text(v), rhs, op)


def flat(args: list) -> list[tuple[Any, bool]]:
    return [(x, True) if isinstance(a, Range) else (a, False) for a in args for x in (a if isinstance(a, Range) else (a,))]


def numbers(args: list) -> list[float]:
    """Numeric cells of ranges and all literals as numbers; an error in a range is raised."""
    out = []
    for v, cell in flat(args):
        if not cell:
            out.append(number(v))
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(float(v))
        elif isinstance(v, str) and v.startswith("#"):
            raise SheetError(v)
    return out


def _average(values: list[float]) -> float:
    if not values:
        raise SheetError("#DIV/0!")
    return sum(values) / len(values)


def _conditional(args: list) -> list[float]:
    holds = criterion(args[1])
    tested = args[0] if isinstance(args[0], Range) else Range([args[0]])
    taken = args[2] if len(args) > 2 and isinstance(args[2], Range) else tested
    return [number(taken[i]) for i, v in enumerate(tested) if holds(v) and i < len(taken) and is_numeric(taken[i])]


def _power_of_ten(args: list) -> float:
    return 10.0 ** (number(args[1]) if len(args) > 1 else 0)


def _away(x: float) -> float:
    return -1.0 if x < 0 else 1.0


def _sqrt(x: float) -> float:
    if x < 0:
        raise SheetError("#NUM!")
    return math.sqrt(x)


def _mod(a: float, b: float) -> float:
    if b == 0:
        raise SheetError("#DIV/0!")
    return a - b * math.floor(a / b)


def _units(s: str) -> list[str]:
    """UTF-16 code units of ``s``."""
    b = s.encode("utf-16-le", "surrogatepass")
    return [b[i : i + 2].decode("utf-16-le", "surrogatepass") for i in range(0, len(b), 2)]


def _join(units: list[str]) -> str:
    return "".join(units).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _mid(s: str, start: float, n: float) -> str:
    u = _units(s)
    at = int(start) - 1
    at = max(len(u) + at, 0) if at < 0 else at
    return _join(u[at : at + max(int(n), 0)])


FUNCTIONS: dict[str, Callable[[list], Any]] = {
    "SUM": lambda a: float(sum(numbers(a))),
    "AVERAGE": lambda a: _average(numbers(a)),
    "MIN": lambda a: min(numbers(a), default=0.0),
    "MAX": lambda a: max(numbers(a), default=0.0),
    "COUNT": lambda a: float(sum((isinstance(v, (int, float)) and not isinstance(v, bool)) or (not cell and is_numeric(v)) for v, cell in flat(a))),
    "COUNTA": lambda a: float(sum(v != "" for v, _ in flat(a))),
    "COUNTBLANK": lambda a: float(sum(v == "" for v, _ in flat(a))),
    "IF": lambda a: (a[1] if len(a) > 1 else True) if truth(a[0]) else (a[2] if len(a) > 2 else False),
    "AND": lambda a: all(truth(v) for v, _ in flat(a)),
    "OR": lambda a: any(truth(v) for v, _ in flat(a)),
    "NOT": lambda a: not truth(a[0]),
    "ROUND": lambda a: math.floor(number(a[0]) * _power_of_ten(a) + 0.5) / _power_of_ten(a),
    "ROUNDUP": lambda a: _away(number(a[0])) * math.ceil(abs(number(a[0])) * _power_of_ten(a)) / _power_of_ten(a),
    "ROUNDDOWN": lambda a: _away(number(a[0])) * math.floor(abs(number(a[0])) * _power_of_ten(a)) / _power_of_ten(a),
    "ABS": lambda a: abs(number(a[0])),
    "SQRT": lambda a: _sqrt(number(a[0])),
    "INT": lambda a: float(math.floor(number(a[0]))),
    "MOD": lambda a: _mod(number(a[0]), number(a[1])),
    "POWER": lambda a: _pow(number(a[0]), number(a[1])),
    "PI": lambda a: math.pi,
    "CONCAT": lambda a: "".join(text(v) for v, _ in flat(a)),
    "LEN": lambda a: float(len(_units(text(a[0])))),
    "UPPER": lambda a: text(a[0]).upper(),
    "LOWER": lambda a: text(a[0]).lower(),
    "TRIM": lambda a: re.sub(r"\s+", " ", text(a[0]).strip()),
    "LEFT": lambda a: _join(_units(text(a[0]))[: max(int(number(a[1])), 0) if len(a) > 1 else 1]),
    "RIGHT": lambda a: _right(text(a[0]), int(number(a[1])) if len(a) > 1 else 1),
    "MID": lambda a: _mid(text(a[0]), number(a[1]), number(a[2])),
    "SUMIF": lambda a: float(sum(_conditional(a))),
    "COUNTIF": lambda a: float(sum(v != "" and criterion(a[1])(v) for v in (a[0] if isinstance(a[0], Range) else [a[0]]))),
    "AVERAGEIF": lambda a: _average(_conditional(a)),
}
FUNCTIONS["CONCATENATE"] = FUNCTIONS["CONCAT"]


def _right(s: str, n: int) -> str:
    u = _units(s)
    return _join(u[max(len(u) - n, 0) :])


def _pow(a: float, b: float) -> float:
    try:
        out = a**b
    except ZeroDivisionError:
        return math.inf
    except OverflowError:
        return math.inf
    return out if isinstance(out, float) else math.nan


def evaluate(node: Node, look: Callable[[Ref], Any]) -> Any:
    """The value of a tree; ``look`` resolves references. All arguments of a call are evaluated, but the first of IFERROR is guarded."""
    op = node.op
    if op == "value":
        return node.value
    if op == "ref":
        return look(node.value)
    if op == "name":
        raise SheetError("#NAME?")
    if op == "call":
        if node.value == "IFERROR":
            try:
                value, failed = evaluate(node.args[0], look), False
            except SheetError as e:
                if e.code in ("UNSUP", "#PARSE"):
                    raise
                value, failed = None, True
            rest = [evaluate(a, look) for a in node.args[1:]]
            return (rest[0] if rest else "") if failed else value
        args = [evaluate(a, look) for a in node.args]
        if node.value not in FUNCTIONS:
            raise SheetError("UNSUP")
        try:
            return FUNCTIONS[node.value](args)
        except IndexError:
            raise SheetError("#VALUE!") from None
    args = [evaluate(a, look) for a in node.args]
    if op == "neg":
        return -number(args[0])
    if op == "pos":
        return number(args[0])
    if op == "percent":
        return number(args[0]) / 100
    if op == "&":
        return text(args[0]) + text(args[1])
    if op in _BINARY[0]:
        return compare(args[0], args[1], op)
    a, b = number(args[0]), number(args[1])
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "^":
        return _pow(a, b)
    if b == 0:
        raise SheetError("#DIV/0!")
    return a / b


# ---------------------------------------------------------------- workbooks


class Workbook:
    """Cells of one workbook; ``values`` evaluates formulas in the order of their references, cycles as ``#CIRC!``."""

    def __init__(self, cells: Iterator[dict]) -> None:
        self.names: dict[str, int] = {}
        self.raw: dict[tuple[int, int, int], Any] = {}
        self.formulas: dict[tuple[int, int, int], Node | SheetError] = {}
        for c in cells:
            at = (c["sheet"], c["row"], c["col"])
            if c.get("sheet_name"):
                self.names[c["sheet_name"].lower()] = c["sheet"]
            raw = c["raw"] if c["raw"] is not None else ""
            if c.get("formula"):
                try:
                    self.formulas[at] = parse(c["formula"])
                except SheetError as e:
                    self.formulas[at] = e
            elif raw in ("TRUE", "FALSE"):
                raw = raw == "TRUE"
            elif c.get("kind") in (None, "n", "num") and is_numeric(raw):
                raw = to_number(raw)
            self.raw[at] = raw
        self.done: dict[tuple[int, int, int], Any] = {}

    def keys(self, ref: Ref, own: int) -> list[tuple[int, int, int]]:
        sheet = own
        if ref.sheet is not None:
            if ref.sheet.lower() not in self.names:
                raise SheetError("#REF!")
            sheet = self.names[ref.sheet.lower()]
        if not ref.one and (ref.r1 - ref.r0 + 1) * (ref.c1 - ref.c0 + 1) > MAX_RANGE:
            raise SheetError("#NUM!")
        return [(sheet, r, c) for r in range(ref.r0, ref.r1 + 1) for c in range(ref.c0, ref.c1 + 1)]

    def _known(self, key: tuple[int, int, int]) -> Any:
        value = self.done[key] if key in self.formulas else self.raw.get(key, "")
        if isinstance(value, SheetError):
            raise value
        return value

    def _compute(self, key: tuple[int, int, int]) -> Any:
        node = self.formulas[key]
        if isinstance(node, SheetError):
            return node

        def look(ref: Ref) -> Any:
            values = [self._known(k) for k in self.keys(ref, key[0])]
            return values[0] if ref.one else Range(values)

        try:
            return first(evaluate(node, look))
        except SheetError as e:
            return e

    def _needs(self, key: tuple[int, int, int]) -> list[tuple[int, int, int]]:
        node = self.formulas[key]
        out: list[tuple[int, int, int]] = []
        if isinstance(node, Node):
            for ref in references(node):
                try:
                    out += [k for k in self.keys(ref, key[0]) if k in self.formulas]
                except SheetError:
                    pass
        return out

    def values(self) -> dict[tuple[int, int, int], Any]:
        """Values of the formula cells; a SheetError stands for an error value."""
        state: dict[tuple[int, int, int], int] = {}
        for start in self.formulas:
            if start in self.done:
                continue
            stack = [(start, iter(self._needs(start)))]
            state[start] = 1
            while stack:
                key, needs = stack[-1]
                for k in needs:
                    if k in self.done:
                        continue
                    if state.get(k) == 1:  # on the way here: every cell of the cycle
                        for other, _ in stack[[s for s, _ in stack].index(k) :]:
                            self.done[other] = SheetError("#CIRC!")
                        continue
                    state[k] = 1
                    stack.append((k, iter(self._needs(k))))
                    break
                else:
                    stack.pop()
                    state[key] = 2
                    if key not in self.done:
                        self.done[key] = self._compute(key)
        return self.done


_VALUE_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string())
_AT_ONCE = 20_000


def _values_of(book: str | None, cells: list[dict]) -> Iterator[tuple]:
    for (sheet, row, col), v in Workbook(iter(cells)).values().items():
        if isinstance(v, SheetError):
            if v.code in ("UNSUP", "#PARSE"):
                continue  # the stored result is left alone
            yield (book, sheet, row, col, "error", None, None, None, v.code)
        elif isinstance(v, bool):
            yield (book, sheet, row, col, "bool", None, None, v, None)
        elif isinstance(v, (int, float)):
            yield (book, sheet, row, col, "num", float(v), None, None, None)
        elif v.startswith("#"):
            yield (book, sheet, row, col, "error", None, None, None, v)
        else:
            yield (book, sheet, row, col, "str", None, v, None, None)


def _recalculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Workbooks of a partition sorted by book, one after the other; the last one of a batch may go on in the next."""
    names = [c.split()[0] for c in VALUES.split(", ")]
    out: list[tuple] = []
    held: list[dict] = []

    def full() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 9, _VALUE_TYPES)], names=names)
        out.clear()
        return made

    for batch in batches:
        for cell in batch.to_pylist():
            if held and held[0]["book"] != cell["book"]:
                out.extend(_values_of(held[0]["book"], held))
                held = []
            held.append(cell)
        if len(out) >= _AT_ONCE:
            yield full()
    if held:
        out.extend(_values_of(held[0]["book"], held))
    yield full()


def recalculate(cells: DataFrame) -> DataFrame:
    """one row per formula cell of every workbook with its value.

    ``cells``: book, sheet, sheet_name, row, col, raw, kind, formula. Formulas that cannot be parsed or call an unknown function give no
    row, so that their stored results stay. A null raw value is blank; empty input gives no rows. Of a cell that stands twice one row counts.
    Books are brought together by one shuffle and sort; a task holds one workbook at a time.
    """
    own = cells.select("book", "sheet", "sheet_name", "row", "col", "raw", "kind", "formula")
    return own.repartition("book").sortWithinPartitions("book", "sheet", "row", "col").mapInArrow(_recalculate, VALUES)


# ---------------------------------------------------------------- formulas of one row as Columns


def to_column(formula: str, columns: dict[str, Column]) -> Column:
    """A formula over columns of one row as a Column of double: names stand for ``columns``; arithmetic, comparison and scalar functions.

    Division by zero and roots of negative numbers give null, as errors do. The arguments of IF are worked out before it chooses, so an
    error in the branch that is not taken is its result too; an empty column is no error. Range functions are in ``aggregates``.
    """
    from leafmill.functions import numbers as N

    def failed(nodes: list[Node], args: list[Column]) -> Column:
        """Whether any argument that is worked out is an error."""
        out = F.lit(False)
        for n, a in zip(nodes, args):
            if n.op != "value" and not (n.op == "call" and n.value == "COL"):
                out = out | a.isNull()
        return out

    def one(node: Node) -> Column:
        if node.op == "value":
            return F.lit(node.value)
        if node.op in ("name", "ref"):
            raise SheetError("#NAME?")
        if node.op == "call" and node.value == "COL":
            name = node.args[0].value
            if name not in columns:
                raise SheetError("#NAME?")
            return columns[name]
        args = [one(a) for a in node.args]
        if node.op == "call":
            digits = int(node.args[1].value) if node.value.startswith("ROUND") and len(node.args) > 1 else 0
            calls = {
                "ROUND": lambda: N.round_half_up(args[0], digits), "ROUNDUP": lambda: N.round_up(args[0], digits), "ROUNDDOWN": lambda: N.round_down(args[0], digits), "ABS": lambda: F.abs(args[0]),
                "INT": lambda: F.floor(args[0]).cast("double"), "MOD": lambda: N.modulo(args[0], args[1]), "SQRT": lambda: F.when(args[0] >= 0, F.sqrt(args[0])), "POWER": lambda: F.pow(args[0], args[1]), "PI": lambda: F.lit(math.pi),
                "IF": lambda: F.when(~failed(node.args, args), F.when(args[0], args[1]).otherwise(args[2] if len(args) > 2 else F.lit(0.0))), "NOT": lambda: ~args[0], "MIN": lambda: F.least(*args), "MAX": lambda: F.greatest(*args), "LEN": lambda: N.utf16_length(args[0]),
                "TRIM": lambda: N.squeeze(args[0]), "UPPER": lambda: F.upper(args[0]), "LOWER": lambda: F.lower(args[0]), "CONCAT": lambda: F.concat(*args),
            }
            if node.value not in calls:
                raise SheetError("UNSUP")
            return calls[node.value]()
        if len(args) == 1:
            return {"neg": -args[0], "pos": args[0], "percent": args[0] / 100}[node.op]
        a, b = args
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.try_divide(a, b), "^": lambda: F.pow(a, b), "&": lambda: F.concat(a.cast("string"), b.cast("string")),
            "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
        }[node.op]()

    return one(parse(formula))


# ---------------------------------------------------------------- translation

_MOVED = re.compile(r'"(?:[^"]|"")*"|(?<![\w.])(\$?)([A-Za-z]{1,3})(\$?)(\d+)(?![\w(])')


def translate(formula: str, rows: int, cols: int) -> str:
    """relative references moved by ``rows`` and ``cols``, ``$`` kept, texts skipped; nothing goes beyond A1."""

    def moved(m: re.Match) -> str:
        if m[2] is None:
            return m[0]
        col = m[2].upper() if m[1] else index_to_letters(max(letters_to_index(m[2]) + cols, 0))
        row = m[4] if m[3] else str(max(int(m[4]) + rows, 1))
        return f"{m[1]}{col}{m[3]}{row}"

    return _MOVED.sub(moved, formula)


@F.pandas_udf(T.StringType())
def translated(formula, rows, cols):
    """F20 as an Arrow UDF: regular expressions with callbacks have no built-in form."""
    return formula.combine(rows.combine(cols, lambda r, c: (r, c)), lambda f, d: None if f is None else translate(f, int(d[0]), int(d[1])))


def unshare(cells: DataFrame) -> DataFrame:
    """Q15: shared formulas (``si``) written out in every cell of the group, translated from the master, the cell that has the text."""
    master = cells.where("si is not null and formula is not null").select("book", "sheet", "si", F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("formula").alias("shared"))
    joined = cells.join(master, ["book", "sheet", "si"], "left")
    moved = F.when(joined["formula"].isNull() & joined["shared"].isNotNull(), translated(joined["shared"], joined["row"] - joined["row0"], joined["col"] - joined["col0"])).otherwise(joined["formula"])
    return joined.withColumn("formula", moved).drop("row0", "col0", "shared")
