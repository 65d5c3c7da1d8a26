"""The part of Jinja that chat templates use, with trim_blocks and lstrip_blocks; anything else is an error when compiled.

Statements: for (if, else, break, continue), if, set (also of blocks and namespaces), macro, call,
filter, raw, generation.  Expressions are compiled to closures over a scope.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime
from typing import Any

from .errors import TokenizerError

#: Scalars that no template writes, around what generation blocks render.
OPEN, CLOSE = "\ufdd2", "\ufdd3"
_TAG = re.compile(r"\{([{%#])([-+]?)(.*?)([-+]?)(?:\}\}|%\}|#\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<op>\*\*|//|==|!=|<=|>=|[-+*/%~<>()\[\]{}.,:|=]))", re.S)


def _fail(message: str) -> TokenizerError:
    return TokenizerError("chatTemplate", message)


class Undefined:
    """What a missing name is: empty as text, false, and an error when used further."""

    def __init__(self, name: str = "") -> None:
        self.name = name

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __iter__(self):
        return iter(())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None  # type: ignore[assignment]


class Namespace(dict):
    pass


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


Scope = dict[str, Any]
Expr = Callable[[Scope], Any]


def _attribute(value: Any, key: Any) -> Any:
    if isinstance(value, Undefined):
        raise _fail(f"{value.name!r} is undefined")
    if isinstance(value, dict):
        if key in value:
            return value[key]
        if key in ("items", "keys", "values", "get"):
            return getattr(value, key)
        return Undefined(str(key))
    if isinstance(key, int | slice) and isinstance(value, str | list | tuple):
        try:
            return value[key]
        except IndexError:
            return Undefined(str(key))
    if isinstance(value, str) and key in ("strip", "lstrip", "rstrip", "split", "startswith", "endswith", "upper", "lower", "replace", "title", "capitalize", "join", "removeprefix", "removesuffix", "find"):
        return getattr(value, key)
    if isinstance(value, list) and key == "append":
        return value.append
    return Undefined(str(key))


def _text(value: Any) -> str:
    return value if isinstance(value, str) else str(value)


def _to_json(value: Any, indent: int | None = None, **_: Any) -> str:
    return json.dumps(value, ensure_ascii=False, indent=indent)


def _default(value: Any, other: Any = "", falsy: bool = False) -> Any:
    return other if isinstance(value, Undefined) or falsy and not value else value


def _select(keep: bool) -> Callable:
    def run(values: Any, key: str, test: str | None = None, *args: Any) -> list:
        return [v for v in values if bool(_test(test, _attribute(v, key), args) if test else _attribute(v, key)) == keep]

    return run


def _map(values: Any, name: str | None = None, attribute: str | None = None, default: Any = None) -> list:
    if attribute is not None:
        return [default if isinstance(x := _attribute(v, attribute), Undefined) and default is not None else x for v in values]
    return [FILTERS[name](v) for v in values]


FILTERS: dict[str, Callable] = {
    "trim": lambda v, c=None: _text(v).strip(c), "tojson": _to_json, "length": len, "count": len, "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(),
    "join": lambda v, sep="", attribute=None: sep.join(_text(x if attribute is None else _attribute(x, attribute)) for x in v), "default": _default, "d": _default,
    "replace": lambda v, a, b, n=-1: _text(v).replace(a, b, n), "first": lambda v: next(iter(v), Undefined()), "last": lambda v: v[-1] if v else Undefined(), "list": list,
    "items": lambda v: list(v.items()), "dictsort": lambda v: sorted(v.items()), "string": _text, "safe": lambda v: v, "int": lambda v, d=0: int(v), "float": float, "abs": abs,
    "title": lambda v: _text(v).title(), "capitalize": lambda v: _text(v).capitalize(), "reverse": lambda v: v[::-1], "sort": lambda v: sorted(v), "unique": lambda v: list(dict.fromkeys(v)),
    "selectattr": _select(True), "rejectattr": _select(False), "map": _map, "indent": lambda v, n=4, first=False: ("" if not first else " " * n) + _text(v).replace("\n", "\n" + " " * n),
    "select": lambda v, t, *a: [x for x in v if _test(t, x, a)], "reject": lambda v, t, *a: [x for x in v if not _test(t, x, a)],
}

TESTS: dict[str, Callable] = {
    "defined": lambda v: not isinstance(v, Undefined), "undefined": lambda v: isinstance(v, Undefined), "none": lambda v: v is None, "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict), "iterable": lambda v: isinstance(v, list | tuple | dict | str), "sequence": lambda v: isinstance(v, list | tuple | str),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "float": lambda v: isinstance(v, float), "true": lambda v: v is True, "false": lambda v: v is False, "odd": lambda v: v % 2 == 1, "even": lambda v: v % 2 == 0,
    "equalto": lambda v, x: v == x, "eq": lambda v, x: v == x, "ne": lambda v, x: v != x, "in": lambda v, x: v in x, "divisibleby": lambda v, n: v % n == 0,
}


def _test(name: str, value: Any, args: Any) -> bool:
    if name not in TESTS:
        raise _fail(f"unknown test {name!r}")
    return bool(TESTS[name](value, *args))


def _raise(message: str) -> None:
    raise _fail(message)


GLOBALS: Scope = {"range": lambda *a: list(range(*a)), "namespace": lambda *a, **k: Namespace(*a, **k), "dict": lambda **k: dict(k), "raise_exception": _raise, "strftime_now": lambda f: datetime.now().strftime(f)}
BINARY: list[dict[str, Callable]] = [
    {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b},
    {"~": lambda a, b: _text(a) + _text(b)},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"*": lambda a, b: a * b, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: a % b},
]


class _Expressions:
    """A recursive descent over the tokens of one tag."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise _fail(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][0] in ("op", "name") and self.tokens[self.i][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise _fail(f"{value!r} is missing")

    def name(self) -> str:
        if self.i >= len(self.tokens) or self.tokens[self.i][0] != "name":
            raise _fail("a name is missing")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def end(self) -> None:
        if self.i < len(self.tokens):
            raise _fail(f"unexpected {self.tokens[self.i][1]!r}")

    def whole(self) -> Expr:
        out = self.expression()
        if self.take(","):
            parts = [out]
            while self.i < len(self.tokens):
                parts.append(self.expression())
                if not self.take(","):
                    break
            out = lambda s: tuple(p(s) for p in parts)
        self.end()
        return out

    def expression(self) -> Expr:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expression() if self.take("else") else lambda s: Undefined()
            return lambda s: value(s) if test(s) else other(s)
        return value

    def either(self) -> Expr:
        left = self.both()
        while self.take("or"):
            left = (lambda a, b: lambda s: a(s) or b(s))(left, self.both())
        return left

    def both(self) -> Expr:
        left = self.negated()
        while self.take("and"):
            left = (lambda a, b: lambda s: a(s) and b(s))(left, self.negated())
        return left

    def negated(self) -> Expr:
        if self.take("not"):
            inner = self.negated()
            return lambda s: not inner(s)
        return self.compared()

    def compared(self) -> Expr:
        left = self.binary(1)
        while True:
            if self.take("in"):
                left = (lambda a, b: lambda s: a(s) in b(s))(left, self.binary(1))
            elif self.peek("not") and self.i + 1 < len(self.tokens) and self.tokens[self.i + 1][1] == "in":
                self.i += 2
                left = (lambda a, b: lambda s: a(s) not in b(s))(left, self.binary(1))
            elif op := self.take(*BINARY[0]):
                left = (lambda f, a, b: lambda s: f(a(s), b(s)))(BINARY[0][op], left, self.binary(1))
            else:
                return left

    def binary(self, level: int) -> Expr:
        if level == len(BINARY):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*BINARY[level]):
            left = (lambda f, a, b: lambda s: f(a(s), b(s)))(BINARY[level][op], left, self.binary(level + 1))
        return left

    def unary(self) -> Expr:
        if self.take("-"):
            inner = self.unary()
            return lambda s: -inner(s)
        value = self.postfix(self.atom())
        if self.take("**"):
            power = self.unary()
            base = value
            value = lambda s: base(s) ** power(s)
        return self.tested(value)

    def tested(self, value: Expr) -> Expr:
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise _fail(f"unknown filter {name!r}")
                args, named = self.arguments() if self.take("(") else ([], {})
                value = (lambda v, f, a, k: lambda s: f(v(s), *[x(s) for x in a], **{n: x(s) for n, x in k.items()}))(value, FILTERS[name], args, named)
            elif self.take("is"):
                flip = bool(self.take("not"))
                name = self.name()
                if name not in TESTS:
                    raise _fail(f"unknown test {name!r}")
                args = self.arguments()[0] if self.take("(") else [self.unary()] if name in ("equalto", "eq", "ne", "in", "divisibleby") else []
                value = (lambda v, n, a, f: lambda s: _test(n, v(s), [x(s) for x in a]) != f)(value, name, args, flip)
            else:
                return value

    def arguments(self) -> tuple[list[Expr], dict[str, Expr]]:
        args: list[Expr] = []
        named: dict[str, Expr] = {}
        while not self.take(")"):
            if self.i + 1 < len(self.tokens) and self.tokens[self.i][0] == "name" and self.tokens[self.i + 1] == ("op", "="):
                name = self.name()
                self.need("=")
                named[name] = self.expression()
            else:
                args.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return args, named

    def postfix(self, value: Expr) -> Expr:
        while True:
            if self.take("."):
                kind, key = self.tokens[self.i]
                self.i += 1
                value = (lambda v, k: lambda s: _attribute(v(s), k))(value, int(key) if kind == "num" else key)
            elif self.take("["):
                value = self.subscript(value)
            elif self.take("("):
                args, named = self.arguments()
                value = (lambda v, a, k: lambda s: _call(v(s), [x(s) for x in a], {n: x(s) for n, x in k.items()}))(value, args, named)
            else:
                return value

    def subscript(self, value: Expr) -> Expr:
        parts: list[Expr | None] = []
        current: Expr | None = None
        while not self.take("]"):
            if self.take(":"):
                parts.append(current)
                current = None
            else:
                current = self.expression()
        parts.append(current)
        if len(parts) == 1:
            key = parts[0]
            return lambda s: _attribute(value(s), key(s))
        return lambda s: value(s)[slice(*[None if p is None else p(s) for p in parts])]

    def atom(self) -> Expr:
        if self.take("("):
            if self.take(")"):
                return lambda s: ()
            parts = [self.expression()]
            comma = False
            while self.take(","):
                comma = True
                if self.peek(")"):
                    break
                parts.append(self.expression())
            self.need(")")
            return (lambda s: tuple(p(s) for p in parts)) if comma else self.postfix(parts[0])
        if self.take("["):
            items: list[Expr] = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return lambda s: [x(s) for x in items]
        if self.take("{"):
            pairs: list[tuple[Expr, Expr]] = []
            while not self.take("}"):
                key = self.expression()
                self.need(":")
                pairs.append((key, self.expression()))
                if not self.peek("}"):
                    self.need(",")
            return lambda s: {k(s): v(s) for k, v in pairs}
        if self.i >= len(self.tokens):
            raise _fail("an expression is missing")
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            number = float(value) if "." in value else int(value)
            return lambda s: number
        if kind == "str":
            text = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1], flags=re.S)
            while self.i < len(self.tokens) and self.tokens[self.i][0] == "str":  # strings side by side are one
                text += self.tokens[self.i][1][1:-1]
                self.i += 1
            return lambda s: text
        if kind == "name":
            constant = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            if value in constant:
                return lambda s: constant[value]
            return lambda s: s[value] if value in s else GLOBALS.get(value, Undefined(value))
        raise _fail(f"unexpected {value!r}")


def _call(f: Any, args: list, named: dict) -> Any:
    if not callable(f):
        raise _fail(f"{getattr(f, 'name', f)!r} can't be called")
    return f(*args, **named)


Node = Callable[[Scope, list[str]], None]


class Template:
    """A compiled template.  render() gives the text; ranges() also what generation blocks wrote."""

    def __init__(self, source: str) -> None:
        self.generates = False
        self.parts = list(self._tags(source.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")))
        self.at = 0
        self.body = self._block(())
        if self.at < len(self.parts):
            raise _fail(f"unexpected {self.parts[self.at][1]!r}")

    @staticmethod
    def _tags(source: str):
        """("text" | "out" | "tag", content), with white space gone where the tags say so."""
        at, strip_next, eat_line = 0, False, False
        while True:
            m = _TAG.search(source, at)
            end = m.start() if m else len(source)
            text = source[at:end]
            if strip_next:
                text = text.lstrip()
            elif eat_line and text.startswith("\n"):
                text = text[1:]
            if m and m[1] in "%#":
                if m[2] == "-":
                    text = text.rstrip()
                elif m[2] != "+":  # a tag alone at the start of its line takes the space before it
                    line = text.rsplit("\n", 1)[-1]
                    if not line.strip(" \t") and ("\n" in text or not at):
                        text = text[: len(text) - len(line)]
            elif m and m[2] == "-":
                text = text.rstrip()
            if text:
                yield "text", text
            if not m:
                return
            inner, closing = m[3], m[4]
            at, strip_next, eat_line = m.end(), closing == "-", m[1] in "%#" and closing != "+"
            if m[1] == "{":
                yield "out", inner
            elif m[1] == "%":
                if inner.strip() == "raw":
                    stop = re.compile(r"\{%([-+]?)\s*endraw\s*([-+]?)%\}").search(source, at)
                    if not stop:
                        raise _fail("raw has no end")
                    raw = source[at : stop.start()]
                    raw = raw.lstrip() if strip_next else raw[1:] if raw.startswith("\n") else raw
                    yield "text", raw.rstrip() if stop[1] == "-" else raw
                    at, strip_next, eat_line = stop.end(), stop[2] == "-", True
                else:
                    yield "tag", inner.strip()

    def _next(self, words: tuple[str, ...]) -> str:
        """The tag that ends a block, which has been read up to it."""
        if self.at >= len(self.parts):
            raise _fail(f"{words[0]} is missing")
        self.at += 1
        return self.parts[self.at - 1][1]

    def _block(self, ends: tuple[str, ...]) -> Node:
        nodes: list[Node] = []
        while self.at < len(self.parts):
            kind, content = self.parts[self.at]
            if kind == "tag" and content.split(None, 1)[0].rstrip("(") in ends:
                break
            self.at += 1
            if kind == "text":
                nodes.append(lambda s, out, t=content: out.append(t))
            elif kind == "out":
                nodes.append(lambda s, out, e=_Expressions(content).whole(): out.append(_text(e(s))))
            else:
                nodes.append(self._statement(content))

        def run(s: Scope, out: list[str]) -> None:
            for node in nodes:
                node(s, out)

        return run

    def _statement(self, content: str) -> Node:
        word, _, rest = content.partition(" ")
        if m := re.match(r"(call|set|macro)\b(.*)", content, re.S):
            word, rest = m[1], m[2].strip()
        make = getattr(self, f"_do_{word}", None)
        if make is None:
            raise _fail(f"unknown statement {word!r}")
        return make(rest)

    def _do_if(self, rest: str) -> Node:
        branches: list[tuple[Expr, Node]] = []
        test: Expr = _Expressions(rest).whole()
        while True:
            branches.append((test, self._block(("elif", "else", "endif"))))
            end = self._next(("endif",))
            if end == "endif":
                break
            test = _Expressions(end[4:]).whole() if end.startswith("elif") else lambda s: True

        def run(s: Scope, out: list[str]) -> None:
            for condition, body in branches:
                if condition(s):
                    return body(s, out)

        return run

    def _do_for(self, rest: str) -> Node:
        names, _, source = rest.partition(" in ")
        targets = [n.strip() for n in names.strip("() ").split(",")]
        only: Expr | None = None
        reader = _Expressions(source)
        values = reader.either()
        if reader.take("if"):
            only = reader.expression()
        reader.take("recursive")
        reader.end()
        body = self._block(("else", "endfor"))
        other: Node | None = None
        if self._next(("endfor",)) == "else":
            other = self._block(("endfor",))
            self._next(("endfor",))

        def bound(s: Scope, item: Any) -> Scope:
            return {**s, **(dict(zip(targets, item, strict=True)) if len(targets) > 1 else {targets[0]: item})}

        def run(s: Scope, out: list[str]) -> None:
            items = [x for x in values(s) if only is None or only(bound(s, x))]
            for i, item in enumerate(items):
                inner = bound(s, item)
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items), "revindex": len(items) - i, "revindex0": len(items) - i - 1, "previtem": items[i - 1] if i else Undefined(), "nextitem": items[i + 1] if i + 1 < len(items) else Undefined()}
                try:
                    body(inner, out)
                except _Continue:
                    continue
                except _Break:
                    break
            if not items and other:
                other(s, out)

        return run

    def _do_break(self, rest: str) -> Node:
        def run(s: Scope, out: list[str]) -> None:
            raise _Break

        return run

    def _do_continue(self, rest: str) -> Node:
        def run(s: Scope, out: list[str]) -> None:
            raise _Continue

        return run

    def _do_set(self, rest: str) -> Node:
        m = re.match(r"([\w.]+(?:\s*,\s*\w+)*)\s*(=(?!=)|\||$)", rest)
        if not m:
            raise _fail(f"set {rest!r}")
        names = [n.strip() for n in m[1].split(",")]

        def store(s: Scope, value: Any) -> None:
            for name, v in zip(names, value if len(names) > 1 else [value], strict=True):
                space, _, key = name.partition(".")
                if key:
                    if not isinstance(s.get(space), Namespace):
                        raise _fail(f"{space!r} is no namespace")
                    s[space][key] = v
                else:
                    s[name] = v

        if m[2] == "=":
            value = _Expressions(rest[m.end() :]).whole()
            return lambda s, out: store(s, value(s))
        change = _Expressions("__body " + rest[m.end(1) :]).whole()
        body = self._block(("endset",))
        self._next(("endset",))

        def run(s: Scope, out: list[str]) -> None:
            inner: list[str] = []
            body(s, inner)
            store(s, change({**s, "__body": "".join(inner)}))

        return run

    def _signature(self, source: str) -> list[tuple[str, Expr | None]]:
        reader, out = _Expressions(source), []
        while not reader.take(")"):
            name = reader.name()
            out.append((name, reader.expression() if reader.take("=") else None))
            if not reader.peek(")"):
                reader.need(",")
        return out

    def _do_macro(self, rest: str) -> Node:
        name, _, signature = rest.partition("(")
        parameters = self._signature(signature)
        body = self._block(("endmacro",))
        self._next(("endmacro",))

        def define(s: Scope, out: list[str]) -> None:
            def macro(*args: Any, **named: Any) -> str:
                inner = {**s, "caller": named.pop("caller", Undefined("caller"))}
                for i, (p, default) in enumerate(parameters):
                    inner[p] = args[i] if i < len(args) else named[p] if p in named else default(inner) if default else Undefined(p)
                made: list[str] = []
                body(inner, made)
                return "".join(made)

            s[name.strip()] = macro

        return define

    def _do_call(self, rest: str) -> Node:
        parameters: list[tuple[str, Expr | None]] = []
        if rest.startswith("("):
            signature, rest = rest[1:].split(")", 1)
            parameters = self._signature(signature + ")")
        reader = _Expressions(rest)
        target = reader.atom()
        args: list[Expr] = []
        named: dict[str, Expr] = {}
        while not reader.peek("("):
            reader.need(".")
            target = (lambda v, k: lambda s: _attribute(v(s), k))(target, reader.name())
        reader.need("(")
        args, named = reader.arguments()
        body = self._block(("endcall",))
        self._next(("endcall",))

        def run(s: Scope, out: list[str]) -> None:
            def caller(*values: Any) -> str:
                made: list[str] = []
                body({**s, **{p: v for (p, _), v in zip(parameters, values, strict=False)}}, made)
                return "".join(made)

            out.append(_text(_call(target(s), [a(s) for a in args], {k: v(s) for k, v in named.items()} | {"caller": caller})))

        return run

    def _do_filter(self, rest: str) -> Node:
        change = _Expressions("__body | " + rest).whole()
        body = self._block(("endfilter",))
        self._next(("endfilter",))

        def run(s: Scope, out: list[str]) -> None:
            inner: list[str] = []
            body(s, inner)
            out.append(_text(change({**s, "__body": "".join(inner)})))

        return run

    def _do_generation(self, rest: str) -> Node:
        self.generates = True
        body = self._block(("endgeneration",))
        self._next(("endgeneration",))

        def run(s: Scope, out: list[str]) -> None:
            out.append(OPEN)
            body(s, out)
            out.append(CLOSE)

        return run

    def ranges(self, **context: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the stretches of it (in scalars) that generation blocks wrote."""
        out: list[str] = []
        try:
            self.body(dict(context), out)
        except (_Break, _Continue) as e:
            raise _fail("break or continue outside of a loop") from e
        except (TypeError, KeyError, ValueError, AttributeError, IndexError) as e:
            if isinstance(e, TokenizerError):
                raise
            raise _fail(str(e)) from e
        parts, found, n, depth, start = re.split(f"([{OPEN}{CLOSE}])", "".join(out)), [], 0, 0, 0
        text = []
        for part in parts:
            if part == OPEN:
                if not depth:
                    start = n
                depth += 1
            elif part == CLOSE:
                depth -= 1
                if not depth:
                    found.append((start, n))
            else:
                text.append(part)
                n += len(part)
        return "".join(text), found

    def render(self, **context: Any) -> str:
        return self.ranges(**context)[0]
