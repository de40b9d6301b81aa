r"""Chat formatting: a compiler for a sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and every node
becomes a Python closure.  Rendering calls the closures; ``{% generation %}``
blocks mark the spans of code points that a loss mask covers.

The language has ``{{ expression }}``, ``{% for x in e %}``, ``{% if e %}`` with
``elif`` and ``else``, ``{% set x = e %}``, ``{% generation %}``, each closed by
its ``end`` tag, and ``{# comments #}``.  Expressions have strings, integers,
names, ``.name`` and ``['name']`` on the messages' own fields, ``loop.index``
and the like, filters, ``+ ~ == != < <= > >= in not and or`` and ``a if c else
b``.  There is nothing else to reach: no calls, no attributes of Python objects,
no imports, and loops run over the given lists only.

Control strings in texts are escaped with backslashes, so turns can be read back
exactly.

Defined results: null texts and roles are empty; turns of one number are ordered
by role, then text; null turns come first; rows with a null conversation id form
one conversation; an empty table gives no rows (the query still adds its own
conversation); other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that the language does not have."""


# ------------------------------------------------------------------ syntax tree


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Filter:
    of: Any
    name: str


@dataclass
class Unary:
    op: str
    of: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Choice:
    test: Any
    yes: Any
    no: Any


@dataclass
class Emit:
    value: Any


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class If:
    arms: list  # (test, body)
    other: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class Generation:
    body: list


# ------------------------------------------------------------------ escaping

CONTROL = ("</turn>", "<turn>", "###")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Backslashes doubled, a backslash before each control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, "\\" + c)
    return text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def escape_line(text: str) -> str:
    """``escape`` for what must stay on one line."""
    return escape(text).replace("\n", "\\n")


def unescape_line(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "lower": lambda x: str(x).lower(),
    "upper": lambda x: str(x).upper(),
    "length": len,
    "string": str,
    "escape": lambda x: escape(str(x)),
    "escape_line": lambda x: escape_line(str(x)),
}

# ------------------------------------------------------------------ parsing

_PART = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(==|!=|<=|>=|[-+~<>().|\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise TemplateError(f"unexpected text in an expression: {text[at:at + 20]!r}")
            at = m.end()
            self.tokens.append(next((kind, x) for kind, x in zip(("int", "name", "str", "op"), m.groups()) if x is not None))
        self.at = 0

    def peek(self) -> str:
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        return "" if kind == "str" else x

    def take(self, x: str) -> bool:
        if self.peek() == x and x:
            self.at += 1
            return True
        return False

    def need(self, x: str) -> None:
        if not self.take(x):
            raise TemplateError(f"{x!r} is missing")

    def whole(self) -> Any:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Any:
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = Choice(test, node, self.choice() if self.take("else") else Const(""))
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Unary("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.summed()
        while True:
            op = next((x for x in ("==", "!=", "<=", ">=", "<", ">", "in") if self.take(x)), None)
            if op is None and self.peek() == "not":
                self.at += 1
                self.need("in")
                op = "not in"
            if op is None:
                return node
            node = Binary(op, node, self.summed())

    def summed(self) -> Any:
        node = self.postfix()
        while op := next((x for x in ("+", "-", "~") if self.take(x)), None):
            node = Binary(op, node, self.postfix())
        return node

    def postfix(self) -> Any:
        node = self.atom()
        while True:
            if self.take("."):
                node = Item(node, Const(self.name()))
            elif self.take("["):
                node = Item(node, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = Filter(node, name)
            else:
                return node

    def name(self) -> str:
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name" or x.startswith("_"):
            raise TemplateError(f"a name is needed, not {x!r}")
        self.at += 1
        return x

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, x = self.tokens[self.at]
        if kind == "int":
            self.at += 1
            return Const(int(x))
        if kind == "str":
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), x[1:-1], flags=re.S))
        if kind == "name" and x in _WORDS:
            self.at += 1
            return Const(_WORDS[x])
        if kind == "name":
            return Name(self.name())
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Unary("-", self.atom())
        raise TemplateError(f"unexpected {x!r}")


def parse(source: str) -> list:
    """The tree of a template."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for m in _PART.finditer(source):
        body = stack[-1][2]
        if m.start() > at:
            body.append(Emit(Const(source[at : m.start()])))
        at = m.end()
        if m[1] is not None:
            body.append(Emit(_Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "for":
                if not (f := re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                    raise TemplateError(f"not a loop: {rest!r}")
                body.append(node := For(f[1], _Expression(f[2]).whole(), []))
                stack.append(("for", node, node.body))
            elif word == "if":
                body.append(node := If([(_Expression(rest).whole(), [])], []))
                stack.append(("if", node, node.arms[-1][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                node = stack.pop()[1]
                if word == "elif":
                    node.arms.append((_Expression(rest).whole(), []))
                stack.append(("if", node, node.arms[-1][1] if word == "elif" else node.other))
            elif word == "set":
                if not (f := re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)):
                    raise TemplateError(f"not an assignment: {rest!r}")
                body.append(Set(f[1], _Expression(f[2]).whole()))
            elif word == "generation":
                body.append(node := Generation([]))
                stack.append(("generation", node, node.body))
            elif word.startswith("end") and len(stack) > 1 and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected tag {m[2].strip()!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    if at < len(source):
        root.append(Emit(Const(source[at:])))
    return root


# ------------------------------------------------------------------ folding

_OPS: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def fold(node: Any) -> Any:
    """The node with constant parts computed."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(_text(out[-1].value.value) + _text(y.value.value)))
                        continue
                    if _text(y.value.value) == "":
                        continue
                out.append(y)
        return out
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, Unary):
        of = fold(node.of)
        return Const(not of.value if node.op == "not" else -of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        if node.op in ("and", "or") and isinstance(left, Const):
            return right if bool(left.value) == (node.op == "and") else left
        if isinstance(left, Const) and isinstance(right, Const) and node.op in _OPS:
            try:
                return Const(_OPS[node.op](left.value, right.value))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Binary(node.op, left, right)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Choice):
        test, yes, no = fold(node.test), fold(node.yes), fold(node.no)
        return (yes if test.value else no) if isinstance(test, Const) else Choice(test, yes, no)
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for test, body in ((fold(t), fold(b)) for t, b in node.arms):
            if isinstance(test, Const):
                if test.value:
                    return If(arms, body) if arms else body
                continue
            arms.append((test, body))
        return If(arms, fold(node.other)) if arms else fold(node.other)
    return node


# ------------------------------------------------------------------ closures


@dataclass
class Output:
    """What has been written: pieces, code points so far, spans under the loss mask."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _value(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _value(node.of), _value(node.key)

        def item(scope: dict) -> Any:
            x, k = of(scope), key(scope)
            if isinstance(x, dict):
                return x.get(k)
            if isinstance(x, list) and isinstance(k, int) and -len(x) <= k < len(x):
                return x[k]
            return None

        return item
    if isinstance(node, Filter):
        inner, f = _value(node.of), FILTERS[node.name]
        return lambda scope: f("" if (x := inner(scope)) is None else x)
    if isinstance(node, Unary):
        inner = _value(node.of)
        return (lambda scope: not inner(scope)) if node.op == "not" else (lambda scope: -inner(scope))
    if isinstance(node, Choice):
        test, yes, no = map(_value, (node.test, node.yes, node.no))
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if isinstance(node, Binary):
        left, right = _value(node.left), _value(node.right)
        if node.op == "and":
            return lambda scope: left(scope) and right(scope)
        if node.op == "or":
            return lambda scope: left(scope) or right(scope)
        op = _OPS[node.op]
        return lambda scope: op(left(scope), right(scope))
    raise TemplateError(f"no expression: {node!r}")


def _statement(node: Any) -> Callable[[dict, Output], None]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda scope, out: out.write(text)
        value = _value(node.value)
        return lambda scope, out: out.write(_text(value(scope)))
    if isinstance(node, Set):
        name, bound = node.name, _value(node.value)
        return lambda scope, out: scope.__setitem__(name, bound(scope))
    body: Callable[[dict, Output], None]
    if isinstance(node, Generation):
        body = _body(node.body)

        def generation(scope: dict, out: Output) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return generation
    if isinstance(node, If):
        arms, other = [(_value(t), _body(b)) for t, b in node.arms], _body(node.other)

        def branch(scope: dict, out: Output) -> None:
            next((b for t, b in arms if t(scope)), other)(scope, out)

        return branch
    if isinstance(node, For):
        over, body, name = _value(node.over), _body(node.body), node.name

        def loop(scope: dict, out: Output) -> None:
            items = over(scope)
            if not isinstance(items, list):
                raise TemplateError("a loop needs a list")
            inner = dict(scope)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                body(inner, out)

        return loop
    raise TemplateError(f"no statement: {node!r}")


def _body(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_statement(x) for x in nodes]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to the rendered text and the loss mask's spans (code points)."""
    run = _body(fold(parse(source)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(variables), out)
        return "".join(out.pieces), out.spans

    return render


# ------------------------------------------------------------------ conversations

TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
_SCAN = re.compile(r"\\.|(<turn>)|(</turn>)", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a text that ``TEMPLATE`` rendered."""
    turns, start = [], 0
    for m in _SCAN.finditer(formatted):
        if m[1]:
            start = m.end()
        elif m[2]:
            role, _, text = formatted[start : m.start()].partition("\n")
            turns.append((unescape_line(role), unescape(text)))
    return turns


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row a conversation: conv_id, formatted, spans (start, end) under the loss mask.

    Turns are gathered with map-side partial lists, so a conversation with many
    turns reaches its reducer as one row per task.
    """
    compile_template(template)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        for b in batches:
            done = [render({"messages": [x if isinstance(x, dict) else x.asDict() for x in ms]}) for ms in b["messages"]]
            yield pd.DataFrame({"conv_id": b["conv_id"], "formatted": [t for t, _ in done], "spans": [[{"start": s, "end": e} for s, e in spans] for _, spans in done]})

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return grouped.mapInPandas(run, f"conv_id {kind}, formatted string, spans array<struct<start:long,end:long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, marked in zip(texts, spans):
            turns = read_back(t)
            loss = "".join(unescape(t[s["start"] : s["end"]]) for s in marked)
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), _sha(said), len(loss), _sha(loss), len(t)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("_r", read("formatted", "spans")).select("conv_id", "_r.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


OWN_TEXT = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(OWN_TEXT).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(rows.unionByName(own)))


_ESC = r"replace(replace(replace(replace({}, '\', '\\'), '</turn>', '\</turn>'), '<turn>', '\<turn>'), '###', '\###')"
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length({_ESC.format("text")}) + length(replace({_ESC.format("role")}, chr(10), '\n')) + 15 AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
