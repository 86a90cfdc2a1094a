"""A pluggable chat client. No numeric result needs one; without a network the replay client answers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from ..functions.calendar import salvage_json, schema_errors


class ChatClient(Protocol):
    """M1."""

    model: str

    def chat(self, messages: list[dict], **options) -> str: ...


class Transient(Exception):
    """Worth another attempt."""


class BadRequest(Exception):
    """The provider refuses an option."""


@dataclass
class ReplayClient:
    """Answers from a mapping of the last message to a text; else from a rule."""

    answers: dict[str, str] = field(default_factory=dict)
    rule: Callable[[list[dict]], str] = lambda messages: "{}"
    model: str = "replay"

    def chat(self, messages: list[dict], **options) -> str:
        return self.answers.get(messages[-1]["content"]) or self.rule(messages)


def chat(client: ChatClient, messages: list[dict], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, **options) -> str:
    """M2 to M4: a bounded number of attempts; refused options are dropped, pauses grow up to a minute."""
    for n in range(1, attempts + 1):
        try:
            return client.chat(messages, **options)
        except BadRequest:
            options.pop("response_format", None)
            options.pop("extra_body", None)
        except Transient:
            if n == attempts:
                raise
            sleep(min(60.0, 2.0 * n) + random.random())
    return client.chat(messages, **options)


def chat_json(client: ChatClient, messages: list[dict], schema: dict, repairs: int = 2, **options) -> dict:
    """M6: an object that fits the schema; what is wrong is told back, up to repairs times."""
    said = list(messages)
    for _ in range(repairs + 1):
        text = chat(client, said, **options)
        found = salvage_json(text)
        wrong = schema_errors(found, schema) if found is not None else ["no JSON object"]
        if not wrong:
            return found
        said += [{"role": "assistant", "content": text}, {"role": "user", "content": "Errors: " + "; ".join(wrong)}]
    raise ValueError("; ".join(wrong))


def loose(client: ChatClient, messages: list[dict], **options) -> dict:
    """M24."""
    found = salvage_json(chat(client, messages, **options))
    return found if isinstance(found, dict) else {"summary": str(found)}


class Empty(Exception):
    """A response without text; reason says why it ended."""

    def __init__(self, reason: str) -> None:
        super().__init__(f"no text in the response: {reason}")
        self.reason = reason


def _of(value, name: str, default=None):
    return value.get(name, default) if isinstance(value, dict) else getattr(value, name, default)


def text_of(content) -> str:
    """The text of a message's content: a string, a part with text, or a list of these."""
    if isinstance(content, str):
        return content
    if isinstance(content, (list, tuple)):
        return "".join(map(text_of, content))
    found = _of(content, "text") if content is not None else None
    return found if isinstance(found, str) else ""


def response_text(response) -> tuple[str, str]:
    """Text and finish reason (lower case) of a response: choices with messages, plain texts or deltas, or candidates with parts; objects or mappings."""
    several = _of(response, "choices") or _of(response, "candidates") or []
    if not several:
        return "", "none"
    first = several[0]
    places = [_of(_of(first, "message"), "content"), _of(_of(first, "content"), "parts"), first, _of(_of(first, "delta"), "content")]
    reason = _of(first, "finish_reason", "")
    reason = _of(reason, "name") or reason
    return next((t for p in places if p is not None and (t := text_of(p))), "").strip(), "length" if str(reason).lower() in ("2", "max_tokens", "length") else str(reason).lower()


@dataclass(frozen=True)
class ModelSpec:
    """What a provider's requests need."""

    model: str
    roles: str = "system"  # "system": a message like the others; "apart": an instruction of its own, and the assistant is called model
    json_answers: bool = True
    extra: dict = field(default_factory=dict)


def request_of(spec: ModelSpec, messages: list[dict], temperature: float = 0.0, max_tokens: int | None = None, as_json: bool = False, **options) -> dict:
    """The request for messages; options that the model doesn't take are left out."""
    out = {"model": spec.model, "temperature": temperature} | spec.extra | options
    if max_tokens is not None:
        out["max_tokens"] = max_tokens
    if as_json and spec.json_answers:
        out["response_format"] = {"type": "json_object"}
    if spec.roles != "apart":
        return out | {"messages": messages}
    told = [m["content"] for m in messages if m["role"] == "system"]
    rest = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [m["content"]]} for m in messages if m["role"] != "system"]
    return out | {"system_instruction": "\n\n".join(told) or None, "contents": rest}


@dataclass
class ProviderClient:
    """A client over a function that sends a request and returns the provider's response. The function is the caller's: the engine has no network.

    M3: a response that ended for its length without text is asked for again with long tokens; one that has still none once more, as one flat message
    with flat tokens; then Empty is raised.
    """

    spec: ModelSpec
    send: Callable[[dict], object]
    long: int = 65_536
    flat: int = 16_384

    @property
    def model(self) -> str:
        return self.spec.model

    def chat(self, messages: list[dict], **options) -> str:
        text, reason = response_text(self.send(request_of(self.spec, messages, **options)))
        if not text and reason == "length":
            text, reason = response_text(self.send(request_of(self.spec, messages, **options | {"max_tokens": self.long})))
        if not text:
            told = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
            asked = next((m["content"] for m in reversed(messages) if m["role"] == "user"), "")
            one = [{"role": "user", "content": "\n\n".join(x for x in (told, asked) if x)}]
            text, reason = response_text(self.send(request_of(self.spec, one, **options | {"max_tokens": self.flat})))
        if not text:
            raise Empty(reason)
        return text


@dataclass
class CallLog:
    """Stage, model, latency, tokens and cost of every call."""

    client: ChatClient
    stage: str = ""
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)  # USD for 1,000 tokens in and out, by model
    calls: list[dict] = field(default_factory=list)

    @property
    def model(self) -> str:
        return self.client.model

    def chat(self, messages: list[dict], **options) -> str:
        began = time.time()
        text = self.client.chat(messages, **options)
        n_in, n_out = (max(1, len(t) // 4) for t in ("".join(m["content"] for m in messages), text))
        price = self.prices.get(self.model, (0.0, 0.0))
        self.calls.append({"stage": self.stage, "model": self.model, "latency_sec": time.time() - began, "tokens_in": n_in, "tokens_out": n_out, "cost_usd": n_in / 1000 * price[0] + n_out / 1000 * price[1]})
        return text

    def frame(self, spark):
        return spark.createDataFrame([tuple(c.values()) for c in self.calls], "stage string, model string, latency_sec double, tokens_in long, tokens_out long, cost_usd double")
