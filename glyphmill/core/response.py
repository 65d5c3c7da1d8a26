"""Structured replies: a declarative template of regions, and the parser that reads text by it, whole or in pieces.

A template is a dict: fields by name, each with an opening and a closing delimiter (literals or a
pattern), how its text becomes a value, and how values gather; one field may lack an opening and
takes the text outside all others.  Events are ("open", field), ("chunk", field, text, dirty) and
("close", field, value).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import regex

from .errors import ResponseParsingError

PLACEHOLDER = regex.compile(r"\{\w+(?:\.\w+)*\}")
FIELD_KEYS = {"open", "open_pattern", "close", "close_pattern", "content", "content_args", "repeats", "join", "optional", "transform", "transform_each"}
TEMPLATE_KEYS = {"version", "defaults", "fields", "start_anchor", "start_anchor_pattern"}
Event = tuple


def _bad(message: str) -> ResponseParsingError:
    return ResponseParsingError("invalidTemplate", message)


def _content(message: str) -> ResponseParsingError:
    return ResponseParsingError("content", message)


# --- delimiters ---


@dataclass(frozen=True)
class Delimiter:
    pattern: regex.Pattern
    literals: tuple[str, ...] = ()

    @classmethod
    def of(cls, spec: dict, key: str, scope: str) -> Delimiter | None:
        literal, pattern = spec.get(key), spec.get(f"{key}_pattern")
        if literal is not None and pattern is not None:
            raise _bad(f"{scope}: both {key} and {key}_pattern")
        if literal is not None:
            many = [literal] if isinstance(literal, str) else literal
            if not isinstance(many, list) or not many or not all(isinstance(x, str) and x for x in many):
                raise _bad(f"{scope}: {key} is a string or a list of strings that aren't empty")
            ordered = tuple(sorted(dict.fromkeys(many), key=len, reverse=True))
            return cls(regex.compile("|".join(map(regex.escape, ordered))), ordered)
        if pattern is None:
            return None
        try:
            return cls(regex.compile(pattern, regex.DOTALL))
        except (regex.error, TypeError) as e:
            raise _bad(f"{scope}: {key}_pattern: {e}") from e

    @property
    def names(self) -> list[str]:
        return sorted(self.pattern.groupindex)

    def find(self, text: str, start: int, ended: bool) -> tuple[regex.Match | None, int]:
        """The first match that more text can't change, and where text begins that it still could."""
        if ended:
            return self.pattern.search(text, start), len(text)
        found = self.pattern.search(text, start, partial=True)
        if found is None:
            return None, len(text)
        grows = found.end() == len(text) and (any(x != found.group() and x.startswith(found.group()) for x in self.literals) if self.literals else True)
        return (None, found.start()) if found.partial or grows else (found, len(text))


# --- contents ---


def _json(text: str, args: dict) -> Any:
    work, strings = text, []
    for opening, closing in args.get("string_delims") or []:
        if "\x01" in text or "\x02" in text:
            raise _content("json: the text has reserved characters")

        def keep(m: regex.Match) -> str:
            strings.append(m.group(1))
            return f"\x01{len(strings) - 1}\x02"

        work = regex.sub(regex.escape(opening) + "(.*?)" + regex.escape(closing), keep, work, flags=regex.DOTALL)
    if args.get("unquoted_keys"):
        work = regex.sub(r"(?<=[{,])(\w+):", r'"\1":', work)
    for i, s in enumerate(strings):
        work = work.replace(f"\x01{i}\x02", json.dumps(s, ensure_ascii=False))
    try:
        return json.loads(work)
    except RecursionError as e:
        raise _content("json: too deep") from e
    except ValueError as e:
        if args.get("allow_non_json"):
            return text.strip() if args.get("strip", True) else text
        raise _content(f"json: {e}: {text!r}") from e


def _xml(text: str, args: dict) -> dict:
    pattern, inner, out = args["tag_pattern"], args.get("value_parser"), {}
    if "key" not in pattern.groupindex and pattern.search(text):
        raise _content("xml-inline: tag_pattern needs a group named key")
    for m in pattern.finditer(text):
        raw = m.group("value") if "value" in pattern.groupindex else ""
        if raw is None and inner:
            raise _content("xml-inline: the group named value has no match")
        value = inner(raw) if inner and raw is not None else raw
        key = m.group("key")
        if args.get("merge_duplicates") and key in out:
            out[key] = [*out[key], value] if isinstance(out[key], list) else [out[key], value]
        else:
            out[key] = value
    return out


def _lines(text: str, args: dict) -> dict:
    out, strip, inner = {}, args.get("strip", True), args.get("value_parser")
    for line in text.split(args.get("line_sep", "\n")):
        key, sep, value = (line.strip() if strip else line).partition(args.get("kv_sep", ":"))
        if sep:
            key, value = (key.strip(), value.strip()) if strip else (key, value)
            out[key] = inner(value) if inner else value
    return out


def _number(kind: type, text: str) -> Any:
    try:
        return kind(text)
    except ValueError as e:
        raise _content(str(e)) from e


PARSERS = {
    "text": lambda t, a: t.strip() if a.get("strip", True) else t,
    "int": lambda t, a: _number(int, t),
    "float": lambda t, a: _number(float, t),
    "bool": lambda t, a: (t.strip() if a.get("strip", True) else t).lower() in ("true", "1"),
    "json": _json,
    "xml-inline": _xml,
    "kv-lines": _lines,
}
STREAMED = ("text", "int", "float", "bool")  # chunks of these are clean


def _parser(name: Any, args: dict, scope: str):
    if name not in PARSERS:
        raise _bad(f"{scope}: unknown content parser {name!r}")
    args = dict(args)
    if name == "json" and not all(isinstance(p, list) and len(p) == 2 and all(isinstance(x, str) for x in p) for p in args.get("string_delims") or []):
        raise _bad(f"{scope}: string_delims are pairs of strings")
    if name == "xml-inline":
        try:
            args["tag_pattern"] = regex.compile(args["tag_pattern"], regex.DOTALL)
        except (KeyError, TypeError, regex.error) as e:
            raise _bad(f"{scope}: tag_pattern: {e}") from e
    if name == "kv-lines" and ("" in (args.get("line_sep"), args.get("kv_sep"))):
        raise _bad(f"{scope}: separators can't be empty")
    if name in ("xml-inline", "kv-lines") and args.get("value_parser") is not None:
        inner = args["value_parser"]
        if not isinstance(inner, dict):
            raise _bad(f"{scope}: value_parser is a dict")
        args["value_parser"] = _parser(inner.get("name", "text"), inner.get("args") or {}, scope)
    return lambda text: PARSERS[name](text, args)


# --- transforms ---


def _checked(spec: Any, scope: str) -> Any:
    if isinstance(spec, dict):
        return {k: _checked(v, scope) for k, v in spec.items()}
    if isinstance(spec, list):
        return [_checked(v, scope) for v in spec]
    if isinstance(spec, str) and not PLACEHOLDER.fullmatch(spec) and PLACEHOLDER.search(spec):
        raise _bad(f"{scope}: {spec!r} mixes a placeholder with text")
    return spec


def _apply(spec: Any, scope: dict) -> Any:
    if isinstance(spec, dict):
        return {k: _apply(v, scope) for k, v in spec.items()}
    if isinstance(spec, list):
        return [_apply(v, scope) for v in spec]
    if not isinstance(spec, str) or not PLACEHOLDER.fullmatch(spec):
        return spec
    value: Any = scope
    for key in spec[1:-1].split("."):
        if not isinstance(value, dict) or key not in value:
            raise _content(f"transform placeholder {spec} has nothing at {key!r}")
        value = value[key]
    return value


# --- templates ---


@dataclass(frozen=True)
class Field:
    name: str
    open: Delimiter | None
    close: Delimiter | None
    parse: Any
    streams: bool
    repeats: bool
    join: str | None
    optional: bool
    transform: Any
    each: bool

    def value(self, body: str, captures: dict[str, str]) -> Any:
        parsed = self.parse(body)
        if self.transform is None:
            return parsed
        if not self.each:
            return _apply(self.transform, {**captures, "content": parsed})
        if not isinstance(parsed, list) or not all(isinstance(x, dict) for x in parsed):
            raise _content(f"{self.name}: transform_each needs a list of dicts")
        return [_apply(self.transform, {**captures, **x}) for x in parsed]


def _field(name: str, spec: Any) -> Field:
    scope = f"field {name!r}"
    if not isinstance(spec, dict) or not FIELD_KEYS.issuperset(spec):
        raise _bad(f"{scope}: not a dict, or unknown keys")
    opening, closing = Delimiter.of(spec, "open", scope), Delimiter.of(spec, "close", scope)
    join, repeats, each = spec.get("join"), bool(spec.get("repeats")), spec.get("transform_each", False)
    if join is not None and not (isinstance(join, str) and repeats):
        raise _bad(f"{scope}: join is a string and goes with repeats")
    if not isinstance(each, bool) or each and spec.get("transform") is None:
        raise _bad(f"{scope}: transform_each is a bool and goes with transform")
    if spec.get("transform") is None and any(d and d.names for d in (opening, closing)):
        raise _bad(f"{scope}: named groups are for a transform")
    args = spec.get("content_args", {})
    if not isinstance(args, dict):
        raise _bad(f"{scope}: content_args is a dict")
    kind = spec.get("content", "text")
    return Field(name, opening, closing, _parser(kind, args, scope), kind in STREAMED, repeats, join, bool(spec.get("optional", True)), _checked(spec.get("transform"), scope), each)


class ResponseTemplate:
    def __init__(self, spec: dict | str) -> None:
        if isinstance(spec, str):
            try:
                spec = json.loads(spec)
            except ValueError as e:
                raise _bad(str(e)) from e
        if not isinstance(spec, dict) or spec.get("version", 1) != 1 or not TEMPLATE_KEYS.issuperset(spec):
            raise _bad("not a dict, a version other than 1, or unknown keys")
        if not isinstance(spec.get("defaults", {}), dict) or not isinstance(spec.get("fields"), dict) or not spec["fields"]:
            raise _bad("defaults and fields are dicts, fields not empty")
        self.defaults = spec.get("defaults", {})
        self.fields = {name: _field(name, f) for name, f in spec["fields"].items()}
        implicit = [f for f in self.fields.values() if f.open is None]
        if len(implicit) > 1:
            raise _bad("more than one field without an opening")
        self.implicit = implicit[0] if implicit else None
        anchor = Delimiter.of(spec, "start_anchor", "response_template")
        if anchor is None:
            raise _bad("no start_anchor")
        self.anchor = anchor

    def after_anchor(self, prefix: str) -> str:
        last = 0
        for m in self.anchor.pattern.finditer(prefix):
            last = m.end()
        return prefix[last:]


# --- tool arguments ---


def _types(schema: Any) -> list[str]:
    if not isinstance(schema, dict):
        return []
    kind = schema.get("type")
    out = [kind] if isinstance(kind, str) else [k for k in kind if isinstance(k, str)] if isinstance(kind, list) else []
    for union in ("anyOf", "oneOf"):
        for choice in schema.get(union) or []:
            out += _types(choice)
    return [*out, "null"] if schema.get("nullable") and "null" not in out else out


def coerced(raw: str, types: list[str]) -> Any:
    """raw as the first of the JSON types that it can be; else itself."""
    text = raw.strip()
    for kind in types:
        try:
            if kind == "integer":
                try:
                    return int(raw)
                except ValueError:
                    if (number := float(raw)) == int(number):
                        return int(number)
            elif kind == "number":
                number = float(raw)
                if number - number == 0:
                    return int(number) if number == int(number) and "." not in raw else number
            elif kind == "boolean" and text.lower() in ("true", "1", "false", "0"):
                return text.lower() in ("true", "1")
            elif kind == "null" and text in ("null", "None"):
                return None
            elif kind in ("object", "array") and isinstance(value := json.loads(raw), dict if kind == "object" else list):
                return value
        except (ValueError, OverflowError):
            continue
    return raw


def _typed(value: Any, tools: dict[str, dict]) -> Any:
    if isinstance(value, list):
        return [_typed(v, tools) for v in value]
    function = value.get("function") if isinstance(value, dict) else None
    if not isinstance(function, dict) or not isinstance(function.get("arguments"), dict) or not isinstance(function.get("name"), str):
        return value
    properties, arguments = tools.get(function["name"]) or {}, {}
    for key, argument in function["arguments"].items():
        types = _types(properties.get(key))
        if types and isinstance(argument, str):
            argument = coerced(argument, types)  # noqa: PLW2901
        elif types and isinstance(argument, list) and "array" not in types:
            argument = [coerced(x, types) if isinstance(x, str) else x for x in argument]  # noqa: PLW2901
        arguments[key] = argument
    return {**value, "function": {**function, "arguments": arguments}}


def _tool_parameters(tools: list[dict] | None) -> dict[str, dict]:
    out = {}
    for tool in tools or []:
        function = tool.get("function", tool) if isinstance(tool, dict) else {}
        if isinstance(function, dict) and isinstance(function.get("name"), str):
            out[function["name"]] = (function.get("parameters") or {}).get("properties") or {}
    return out


# --- the parser ---


@dataclass
class ResponseParser:
    """feed() text as it comes, then finalize(); events come as soon as no later text can change them."""

    template: ResponseTemplate
    prefix: str = ""
    tools: list[dict] | None = None
    text: str = ""
    done: bool = False
    initial_events: list[Event] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.parameters = _tool_parameters(self.tools)
        self.output = dict(self.template.defaults)
        self._leave()
        if rest := self.template.after_anchor(self.prefix):
            self.text = rest
            self.initial_events = self._read(False)

    def _leave(self) -> None:
        self.region, self.captures, self.body, self.opened = self.template.implicit, {}, [], False

    def state(self) -> tuple:
        """All that later text depends on, as plain values: what is not read yet, the message so far and the open region."""
        return self.text, self.output, self.region and self.region.name, self.captures, "".join(self.body), self.opened, self.done

    def resume(self, state: tuple) -> ResponseParser:
        """Goes on from a state() of a parser of the same template, prefix and tools."""
        self.text, self.output, name, self.captures, body, self.opened, self.done = state
        self.region = None if name is None else self.template.fields[name]
        self.body = [body] if body else []
        self.initial_events = []
        return self

    def feed(self, text: str) -> list[Event]:
        if self.done:
            raise ResponseParsingError("alreadyFinalized")
        self.text += text
        return self._read(False)

    def finalize(self) -> tuple[dict, list[Event]]:
        if self.done:
            raise ResponseParsingError("alreadyFinalized")
        events = self._read(True)
        missing = [f.name for f in self.template.fields.values() if not f.optional and f.name not in self.output]
        if missing:
            raise ResponseParsingError("missingRequiredFields", ", ".join(missing))
        self.done = True
        empty = (None, "", [], {})
        return {k: v for k, v in self.output.items() if k in self.template.defaults or not any(v == e and type(v) is type(e) for e in empty)}, events

    def _watched(self) -> list[tuple[bool, Field, Delimiter]]:
        """(is a close, field, delimiter) of what can come next."""
        if self.region is not None and self.region is not self.template.implicit:
            return [(True, self.region, self.region.close)] if self.region.close else []
        out = [(False, f, f.open) for f in self.template.fields.values() if f.open]
        inner = self.template.implicit
        return [*out, (True, inner, inner.close)] if inner and inner.close else out

    def _next(self, ended: bool) -> tuple[tuple | None, int]:
        """The delimiter that comes first (the longest, an opening, the least name of those at one place), and where to wait."""
        hold, found = len(self.text), []
        for closes, f, delimiter in self._watched():
            match, wait = delimiter.find(self.text, 0, ended)
            hold = min(hold, wait)
            if match:
                found.append(((match.start(), -len(match.group()), closes, f.name), closes, f, match))
        best = min(found, key=lambda x: x[0], default=None)
        return (None if best and not ended and best[3].start() >= hold else best), hold

    def _take(self, n: int, events: list[Event]) -> None:
        part, self.text = self.text[:n], self.text[n:]
        if part and self.region is not None:
            if not self.opened:
                self.opened = True
                events.append(("open", self.region.name))
            self.body.append(part)
            events.append(("chunk", self.region.name, part, not self.region.streams))

    def _close(self, events: list[Event]) -> None:
        f = self.region
        if f is not None and self.opened:
            value = f.value("".join(self.body), self.captures)
            if self.parameters:
                value = _typed(value, self.parameters)
            before = self.output.get(f.name)
            if f.join is not None:
                if not isinstance(value, str) or not (before is None or isinstance(before, str)):
                    raise _content(f"{f.name}: join is for strings")
                self.output[f.name] = value if before is None else before + f.join + value
            elif f.repeats:
                if f.name in self.output and not isinstance(before, list):
                    raise _content(f"{f.name}: its default isn't a list")
                self.output[f.name] = [*(before or []), value]
            else:
                self.output[f.name] = value
            events.append(("close", f.name, value))
        self._leave()

    def _read(self, ended: bool) -> list[Event]:
        events: list[Event] = []
        while True:
            best, hold = self._next(ended)
            if best is None:
                self._take(len(self.text) if ended else hold, events)
                if ended:
                    self._close(events)
                return events
            _, closes, f, match = best
            self._take(match.start(), events)
            self.text = self.text[len(match.group()) :]
            was_open = self.opened
            self._close(events)
            if closes:
                if not was_open and not match.group():
                    return events  # an empty close of an empty region would come for ever
            else:
                self.region, self.opened = f, True
                self.captures = {k: v for k, v in match.groupdict().items() if v is not None}
                events.append(("open", f.name))


def parse_response(text: str, template: ResponseTemplate, prefix: str = "", tools: list[dict] | None = None) -> dict:
    parser = ResponseParser(template, prefix, tools)
    parser.feed(text)
    return parser.finalize()[0]
