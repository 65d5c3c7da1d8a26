"""Chat templates: selection, rendering, encoding, continuation of the last message, assistant masks."""

from __future__ import annotations

import functools
from typing import Any

from .config import token_text
from .errors import TokenizerError
from .jinja import Template
from .tokenizer import SPECIALS, Tokenizer

MARK = "CONTINUE_FINAL_MESSAGE_TAG"
#: The order of keys in tools and messages; others follow as they come.
KEY_ORDER = ("role", "type", "function", "name", "description", "parameters", "properties", "required", "content", "tool_calls", "arguments")


@functools.lru_cache(16)
def compiled(source: str) -> Template:
    return Template(source)


def select(tokenizer: Tokenizer, template: str | None = None, tools: list | None = None) -> str:
    """The source of a template: a literal one, one by name, tool_use where there are tools, default, or the only one."""
    stored = tokenizer.config.get("chat_template")
    if isinstance(stored, list):
        stored = {t["name"]: t["template"] for t in stored if isinstance(t, dict) and "name" in t and "template" in t}
    if isinstance(stored, dict):
        name = template if template in stored else None
        if template is not None and name is None:
            return template
        name = name or ("tool_use" if tools and "tool_use" in stored else "default")
        if name in stored:
            return stored[name]
    elif template is not None:
        return template
    elif isinstance(stored, str):
        return stored
    raise TokenizerError("missingChatTemplate")


def ordered(value: Any, named: bool = False) -> Any:
    """Keys in the order of their schema; those that users name (below properties and arguments) by alphabet."""
    if isinstance(value, list | tuple):
        return [ordered(v) for v in value]
    if not isinstance(value, dict):
        return value
    rank = {k: i for i, k in enumerate(KEY_ORDER)}
    keys = sorted(value) if named else sorted(value, key=lambda k: rank.get(k, len(rank)))
    return {k: ordered(value[k], not named and k in ("properties", "arguments")) for k in keys}


def _context(tokenizer: Tokenizer, messages: list[dict], add_generation_prompt: bool, tools: list | None, extra: dict | None) -> dict:
    out: dict[str, Any] = {"messages": [ordered(m) for m in messages], "add_generation_prompt": add_generation_prompt}
    if tools is not None:
        out["tools"] = [ordered(t) for t in tools]
    for kind in SPECIALS:
        token = token_text(tokenizer.config.get(f"{kind}_token"))
        if token is not None:
            out[f"{kind}_token"] = token
    return out | (extra or {})


def render(tokenizer: Tokenizer, messages: list[dict], template: str | None = None, add_generation_prompt: bool = False, tools: list | None = None, extra: dict | None = None) -> str:
    extra = dict(extra or {})
    continues = extra.get("continue_final_message") is True
    if continues:
        del extra["continue_final_message"]
        if add_generation_prompt:
            raise TokenizerError("chatTemplate", "a final message is either continued or followed by a new one")
        messages, final = _marked(messages)
    text = compiled(select(tokenizer, template, tools)).render(**_context(tokenizer, messages, add_generation_prompt, tools, extra))
    return _until_mark(text, final) if continues else text


def _marked(messages: list[dict]) -> tuple[list[dict], str]:
    """The messages with a mark at the end of the last one's text, and that text."""
    last = dict(messages[-1]) if messages else {}
    content = last.get("content")
    if isinstance(content, str):
        return [*messages[:-1], {**last, "content": f"{content}{MARK} "}], content
    places = [i for i, p in enumerate(content) if isinstance(p, dict) and isinstance(p.get("text"), str)] if isinstance(content, list) else []
    if not places:
        raise TokenizerError("chatTemplate", "there is no final text to continue")
    text = content[places[-1]]["text"]
    parts = [{**p, "text": f"{text}{MARK} "} if i == places[-1] else p for i, p in enumerate(content)]
    return [*messages[:-1], {**last, "content": parts}], text


def _until_mark(rendered: str, final: str) -> str:
    head, mark, tail = rendered.rpartition(MARK)
    if not mark or not head.rstrip().endswith(final.strip()):
        raise TokenizerError("chatTemplate", "the template hides or changes the final message")
    return head if tail.startswith(" ") else head.rstrip()


def apply(tokenizer: Tokenizer, messages: list[dict], max_length: int | None = None, **options: Any) -> list[int]:
    """Ids of the rendered messages, which bring their own special tokens; cut to the lesser of max_length and the model's, if a limit is given."""
    most = limit(tokenizer, max_length)
    return tokenizer.encode(render(tokenizer, messages, **options), add_special_tokens=False)[:most]


def limit(tokenizer: Tokenizer, max_length: int | None) -> int | None:
    """The lesser of max_length and the model's, if a limit is given."""
    if max_length is None:
        return None
    if max_length < 0:
        raise TokenizerError("invalidConfiguration", "max_length is negative")
    own = tokenizer.config.get("model_max_length")
    return min(max_length, own) if isinstance(own, int) and own > 0 else max_length


def apply_with_mask(tokenizer: Tokenizer, messages: list[dict], **options: Any) -> tuple[list[int], list[bool]]:
    """ids, and which of them overlap with what generation blocks wrote."""
    extra = options.pop("extra", None)
    source = compiled(select(tokenizer, options.pop("template", None), options.get("tools")))
    if not source.generates:
        raise TokenizerError("chatTemplate", "the template has no generation block")
    text, ranges = source.ranges(**_context(tokenizer, messages, options.get("add_generation_prompt", False), options.get("tools"), extra))
    starts = [0]
    for c in text:
        starts.append(starts[-1] + len(c.encode()))
    spans = [(starts[a], starts[b]) for a, b in ranges]
    encoding = tokenizer.encode_with_offsets(text, add_special_tokens=False)
    return encoding.ids, [o is not None and any(o[0] < b and a < o[1] for a, b in spans) for o in encoding.offsets]
