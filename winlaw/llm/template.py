"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                         output
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}            with loop.index, loop.index0, loop.first, loop.last
    {% set name = e %}
    {% generation %} {% endgeneration %}     what is written between is marked as generated
    {# comment #}

Expressions: strings, integers, true, false, none; names, a.b and a['b']; + ~ == != < > <= >= in;
not, and, or; e if c else e; filters e|name of FILTERS. There are no calls, no attributes of
Python objects and no imports: names are looked up in the given data, and a.b only in dicts.

parse() gives a syntax tree, fold() computes what is constant in it, and compile_template()
turns it into closures that write chunks as they go, so a list of messages may be a stream.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# ---- syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    arg: Any


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body); the condition of else is Const(True)


@dataclass(frozen=True)
class For:
    name: str
    items: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


MARK = "<|"


def escape(text: str) -> str:
    r"""Reversible; the result has no `<|` and no line break that unescape() can't tell: `\` -> `\\`, `<|` -> `<\|`."""
    return text.replace("\\", "\\\\").replace(MARK, "<\\|")


def escape_line(text: str) -> str:
    r"""escape(), and a line break -> `\n`."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable[[str], Any]] = {
    "escape": escape,
    "escape_line": escape_line,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "length": len,
}

# ---- parser

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.\[\]()]))", re.S)
_BINARY = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "~")]
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expr:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return text if kind in ("op", "name") else None

    def take(self, *texts: str) -> bool:
        if self.peek() in texts:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} expected")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return text

    def end(self, value: Any) -> Any:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return value

    def whole(self) -> Any:
        value = self.binary(0)
        if self.take("if"):
            cond = self.binary(0)
            self.need("else")
            value = Op("if", (cond, value, self.whole()))
        return value

    def binary(self, level: int) -> Any:
        if level == len(_BINARY):
            return self.unary()
        if level == 2 and self.take("not"):
            return Op("not", (self.binary(level),))
        left = self.binary(level + 1)
        while (op := self.peek()) in _BINARY[level]:
            self.at += 1
            left = Op(op, (left, self.binary(level + 1)))
        return left

    def unary(self) -> Any:
        value = self.primary()
        while True:
            if self.take("."):
                value = Item(value, Const(self.name()))
            elif self.take("["):
                value = Item(value, self.whole())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                value = Filter(name, value)
            else:
                return value

    def primary(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, text = self.tokens[self.at]
        if self.take("("):
            value = self.whole()
            self.need(")")
            return value
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name":
            low = {"true": True, "false": False, "none": None}
            return Const(low[text.lower()]) if text.lower() in low else Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    parts = _TAG.split(source)
    for i, p in enumerate(parts):  # {%- and -%} drop the white space beside them
        if i % 2 and len(p) > 4:
            if p[2] == "-":
                parts[i - 1] = parts[i - 1].rstrip()
            if p[-3] == "-":
                parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal at
        out = []
        while at < len(parts):
            p, is_tag = parts[at], at % 2
            at += 1
            if not is_tag:
                if p:
                    out.append(Text(p))
                continue
            if p.startswith("{#"):
                continue
            inner = p[2:-2].strip("-").strip()
            if p.startswith("{{"):
                e = _Expr(inner)
                out.append(Output(e.end(e.whole())))
                continue
            word, _, rest = inner.partition(" ")
            if word in ends:
                return tuple(out), word, rest
            out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", ""

    def expr(source: str) -> Any:
        e = _Expr(source)
        return e.end(e.whole())

    def statement(word: str, rest: str) -> Any:
        if word == "if":
            arms, cond = [], expr(rest)
            while True:
                inner, end, more = body("elif", "else", "endif")
                arms.append((cond, inner))
                if end == "endif":
                    return If(tuple(arms))
                cond = expr(more) if end == "elif" else Const(True)
        if word == "for":
            e = _Expr(rest)
            name = e.name()
            e.need("in")
            items = e.end(e.whole())
            return For(name, items, body("endfor")[0])
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"can't read set {rest!r}")
            return Set(name.strip(), expr(value))
        if word == "generation":
            return Generation(body("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")

    return body()[0]


# ---- folding


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


_OPS: dict[str, Callable[..., Any]] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "if": lambda c, a, b: a if c else b,
}


def fold_expr(e: Any) -> Any:
    if isinstance(e, Op):
        args = tuple(fold_expr(a) for a in e.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_OPS[e.op](*(a.value for a in args)))
        if isinstance(args[0], Const):
            first = args[0].value
            if e.op == "and":
                return args[1] if first else args[0]
            if e.op == "or":
                return args[0] if first else args[1]
            if e.op == "if":
                return args[1] if first else args[2]
        return Op(e.op, args)
    if isinstance(e, Filter):
        arg = fold_expr(e.arg)
        return Const(FILTERS[e.name](_text(arg.value))) if isinstance(arg, Const) else Filter(e.name, arg)
    if isinstance(e, Item):
        return Item(fold_expr(e.of), fold_expr(e.key))
    return e


def fold(body: tuple) -> tuple:
    """The same output with constants computed, dead arms gone, and neighbouring texts joined."""
    out: list = []

    def put(node: Any) -> None:
        if isinstance(node, Text):
            if node.text and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + node.text)
            elif node.text:
                out.append(node)
        else:
            out.append(node)

    for node in body:
        if isinstance(node, Output):
            value = fold_expr(node.value)
            put(Text(_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, If):
            arms = []
            for cond, inner in node.arms:
                cond = fold_expr(cond)
                if isinstance(cond, Const) and not cond.value:
                    continue
                arms.append((cond, fold(inner)))
                if isinstance(cond, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for x in arms[0][1]:
                    put(x)
            elif arms:
                put(If(tuple(arms)))
        elif isinstance(node, For):
            put(For(node.name, fold_expr(node.items), fold(node.body)))
        elif isinstance(node, Set):
            put(Set(node.name, fold_expr(node.value)))
        elif isinstance(node, Generation):
            put(Generation(fold(node.body)))
        else:
            put(node)
    return tuple(out)


# ---- closures

Emit = Callable[[str, bool], None]


@dataclass
class Frame:
    """What a run reads and writes: values by name, where chunks go, and how deep in generation it is."""

    values: dict[str, Any]
    emit: Emit
    depth: int = field(default=0)


def _expr(e: Any) -> Callable[[Frame], Any]:
    if isinstance(e, Const):
        return lambda f, v=e.value: v
    if isinstance(e, Name):
        return lambda f, n=e.name: f.values.get(n)
    if isinstance(e, Item):
        of, key = _expr(e.of), _expr(e.key)

        def item(f: Frame) -> Any:
            v, k = of(f), key(f)
            if isinstance(v, dict):
                return v.get(k)
            if isinstance(v, list) and isinstance(k, int):
                return v[k] if k < len(v) else None
            return None

        return item
    if isinstance(e, Filter):
        fn, arg = FILTERS[e.name], _expr(e.arg)
        return lambda f: fn(_text(arg(f)))
    if e.op in ("and", "or", "if"):
        args = [_expr(a) for a in e.args]
        if e.op == "if":
            return lambda f: args[1](f) if args[0](f) else args[2](f)
        if e.op == "and":
            return lambda f: args[0](f) and args[1](f)
        return lambda f: args[0](f) or args[1](f)
    fn, args = _OPS[e.op], [_expr(a) for a in e.args]
    if len(args) == 1:
        return lambda f: fn(args[0](f))
    left, right = args
    return lambda f: fn(left(f), right(f))


def _ahead(items: Iterable) -> Iterator[tuple[Any, bool]]:
    """Each item and whether it is the last; reads one ahead, so streams stay streams."""
    it = iter(items)
    try:
        held = next(it)
    except StopIteration:
        return
    for x in it:
        yield held, False
        held = x
    yield held, True


def _node(n: Any) -> Callable[[Frame], None]:
    if isinstance(n, Text):
        return lambda f, t=n.text: f.emit(t, f.depth > 0)
    if isinstance(n, Output):
        value = _expr(n.value)
        return lambda f: f.emit(_text(value(f)), f.depth > 0)
    if isinstance(n, Set):
        value = _expr(n.value)

        def put(f: Frame) -> None:
            f.values[n.name] = value(f)

        return put
    if isinstance(n, If):
        arms = [(_expr(c), _body(b)) for c, b in n.arms]

        def choose(f: Frame) -> None:
            for cond, run in arms:
                if cond(f):
                    run(f)
                    return

        return choose
    if isinstance(n, Generation):
        run = _body(n.body)

        def mark(f: Frame) -> None:
            f.depth += 1
            run(f)
            f.depth -= 1

        return mark
    items, run, name = _expr(n.items), _body(n.body), n.name

    def loop(f: Frame) -> None:
        outer = (f.values.get(name), f.values.get("loop"))
        for i, (x, last) in enumerate(_ahead(items(f) or ())):
            f.values[name], f.values["loop"] = x, {"index0": i, "index": i + 1, "first": i == 0, "last": last}
            run(f)
        f.values[name], f.values["loop"] = outer

    return loop


def _body(body: tuple) -> Callable[[Frame], None]:
    steps = [_node(n) for n in body]

    def run(f: Frame) -> None:
        for s in steps:
            s(f)

    return run


def compile_template(source: str) -> Callable[[dict[str, Any], Emit], None]:
    """render(values, emit): calls emit(chunk, generated) for each chunk of the output, in order."""
    run = _body(fold(parse(source)))
    return lambda values, emit: run(Frame(dict(values), emit))


def render(source: str, **values: Any) -> tuple[str, list[tuple[int, int]]]:
    """The output, and the spans of code points that are marked as generated."""
    chunks: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0

    def emit(text: str, generated: bool) -> None:
        nonlocal at
        chunks.append(text)
        if generated and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        at += len(text)

    compile_template(source)(values, emit)
    return "".join(chunks), spans
