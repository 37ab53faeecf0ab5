"""Translation providers and the stage that calls them.

A provider is a small picklable description; what it needs to run (a client, a loop) is made in the worker. The
stage never fails for a unit: an error is a value in its row, and the source stands in for the translation.
"""

from __future__ import annotations

import asyncio
import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texmill.operators.batching import WAITS

META = "provider string, mode string, variant string, cache_hit boolean, cached_tokens long, prompt_tokens long, completion_tokens long, total_tokens long, cache_creation_tokens long"


@dataclass(frozen=True)
class Reply:
    text: str
    usage: dict | None = None


@dataclass(frozen=True)
class Provider:
    """Base: `complete` answers a list of {role, content}; stateful ones are called in order within a document."""

    model: str = "offline"
    stateful: bool = False
    name: str = "base"

    async def complete(self, messages: list[dict]) -> Reply:
        raise NotImplementedError

    async def warm_up(self) -> None:
        """Called once in a worker before its first request."""

    async def ping(self) -> str:
        return (await self.complete([{"role": "user", "content": "ping"}])).text


@dataclass(frozen=True)
class Offline(Provider):
    """Answers without a network and always the same: a mark before the text, and before each numbered passage."""

    name: str = "offline"
    mark: str = "T:"
    fail_on: str = ""

    async def complete(self, messages: list[dict]) -> Reply:
        import re

        text = messages[-1]["content"]
        if self.fail_on and self.fail_on in text:
            raise RuntimeError(f"refused: {self.fail_on}")
        passages = re.split(r"(?m)^(?=\[\d+\] )", text) if re.match(r"\[1\] ", text) else None
        said = "".join(re.sub(r"^(\[\d+\] )", rf"\g<1>{self.mark}", p) for p in passages) if passages else self.mark + text
        return Reply(said, {"prompt_tokens": sum(len(m["content"]) for m in messages) * 2 // 5, "completion_tokens": len(said) * 2 // 5})


@dataclass(frozen=True)
class Http(Provider):
    """A chat-completions endpoint over HTTP. The key comes from an environment variable, never from the plan."""

    name: str = "http"
    url: str = ""
    key_variable: str = ""
    temperature: float = 0.1
    max_tokens: int = 4096
    timeout: float = 300.0
    shape: str = "openai"  # or "anthropic"
    cache_blocks: bool = False
    extra: dict = field(default_factory=dict, hash=False)

    def body(self, messages: list[dict]) -> dict:
        base = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, **self.extra}
        if self.shape == "anthropic":
            system = [{"type": "text", "text": m["content"], **({"cache_control": {"type": "ephemeral"}} if self.cache_blocks else {})} for m in messages if m["role"] == "system"]
            return base | {"system": system, "messages": [m for m in messages if m["role"] != "system"]}
        if self.cache_blocks:
            messages = [{"role": m["role"], "content": [{"type": "text", "text": m["content"], "cache_control": {"type": "ephemeral"}}]} if m["role"] == "system" else m for m in messages]
        return base | {"messages": messages}

    def _send(self, url: str, body: dict) -> dict:
        import os

        if not self.url:
            raise RuntimeError("this provider needs an endpoint")
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        headers = {"Content-Type": "application/json"} | ({"x-api-key": key, "anthropic-version": "2023-06-01"} if self.shape == "anthropic" else {"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def _reply(self, answer: dict) -> Reply:
        text = "".join(b.get("text", "") for b in answer["content"]) if self.shape == "anthropic" else answer["choices"][0]["message"]["content"]
        return Reply(text.strip(), answer.get("usage"))

    def _post(self, messages: list[dict]) -> Reply:
        return self._reply(self._send(self.url, self.body(messages)))

    async def complete(self, messages: list[dict]) -> Reply:
        return await asyncio.to_thread(self._post, messages)


class VariantContexts:
    """Remote prompt contexts by variant that a worker holds for `ttl` seconds and makes anew after a failure."""

    def __init__(self, make: Callable[[str], str], ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.ttl, self.clock, self.lock = make, ttl, clock, threading.Lock()
        self.held: dict[str, tuple[str, float]] = {}

    def get(self, variant: str) -> tuple[str, bool]:
        """(context id, whether it was held); one caller at a time, so that a context is made once."""
        with self.lock:
            at = self.held.get(variant)
            if at and self.clock() - at[1] < self.ttl:
                return at[0], True
            made = self.make(variant)
            self.held[variant] = (made, self.clock())
            return made, False

    def drop(self, variant: str) -> None:
        with self.lock:
            self.held.pop(variant, None)


#: Contexts that this worker holds, by endpoint, model and key variable.
_CONTEXTS: dict[tuple, VariantContexts] = {}


@dataclass(frozen=True)
class Contextual(Http):
    """Http, with the prompt (all messages but the last) kept by the endpoint as a context that requests refer to.

    A context lives `ttl` seconds in a worker; one that is refused is made anew once; where none can be made, or the
    request fails again, the whole conversation goes the ordinary way.
    """

    name: str = "ark"
    context_url: str = ""
    ttl: float = 300.0

    def _contexts(self) -> VariantContexts:
        key = (self.url, self.context_url, self.model, self.key_variable)
        if key not in _CONTEXTS:
            made = lambda prompt: self._send(self._at("/context/create"), {"model": self.model, "messages": json.loads(prompt), "mode": "common_prefix", "ttl": int(self.ttl)})["id"]
            _CONTEXTS[key] = VariantContexts(made, self.ttl)
        return _CONTEXTS[key]

    def _at(self, route: str) -> str:
        return (self.context_url or self.url.removesuffix("/chat/completions")) + route

    def _post(self, messages: list[dict]) -> Reply:
        prompt, last = json.dumps(messages[:-1]), messages[-1:]
        for _ in range(2 if len(messages) > 1 else 0):
            try:
                context, _held = self._contexts().get(prompt)
                answer = self._send(self._at("/context/chat/completions"), {"model": self.model, "context_id": context, "messages": last, "temperature": self.temperature, "max_tokens": self.max_tokens})
                return self._reply(answer)
            except Exception:  # noqa: BLE001  any refusal: the context may be gone, or contexts may not be known there
                self._contexts().drop(prompt)
        return super()._post(messages)


_MAKERS: dict[str, Callable[..., Provider]] = {
    "offline": Offline,
    "http": Http,
    "openai": lambda **k: Http(name="openai", **k),
    "openai-coding": lambda **k: Http(name="openai-coding", stateful=True, **k),
    "anthropic": lambda **k: Http(name="anthropic", shape="anthropic", cache_blocks=True, **k),
    "anthropic-coding": lambda **k: Http(name="anthropic-coding", shape="anthropic", cache_blocks=True, stateful=True, **k),
    "ark": lambda **k: Contextual(name="ark", **k),
    "bailian": lambda **k: Http(name="bailian", cache_blocks=True, **k),
}


def provider(name: str, **options) -> Provider:
    """The provider of that name; ValueError for any other."""
    if name not in _MAKERS:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(_MAKERS))}")
    return _MAKERS[name](**options)


def usage_meta(usage: Column, name: str) -> Column:
    """A provider's usage JSON as a struct; a positive number of cached tokens is a hit; null usage stays null."""
    pick = lambda *paths: F.coalesce(*(F.get_json_object(usage, f"$.{p}").try_cast("long") for p in paths), F.lit(0).cast("long"))
    cached = pick("prompt_tokens_details.cached_tokens", "cache_read_input_tokens", "cached_tokens")
    prompt, completion = pick("prompt_tokens", "input_tokens"), pick("completion_tokens", "output_tokens")
    total = F.coalesce(F.get_json_object(usage, "$.total_tokens").try_cast("long"), prompt + completion)
    return F.when(
        usage.isNotNull(),
        F.struct(
            F.lit(name).alias("provider"),
            (cached > 0).alias("cache_hit"),
            cached.alias("cached_tokens"),
            prompt.alias("prompt_tokens"),
            completion.alias("completion_tokens"),
            total.alias("total_tokens"),
            pick("prompt_tokens_details.cache_creation_input_tokens", "cache_creation_input_tokens").alias("cache_creation_tokens"),
        ),
    )


def wait_seconds(kind: str, attempt: int, base: float = 1.0) -> float:
    least, times, power = WAITS[kind]
    return max(least, base * times * power**attempt)


def kind_of(error: Exception) -> str:
    said = str(error).lower()
    return "timeout" if isinstance(error, TimeoutError) else "rate_limit" if "429" in said or "rate limit" in said else "generic"


async def call(p: Provider, messages: list[dict], tries: int, per_call: float, base: float) -> tuple[Reply | None, str | None, int, float]:
    """(reply, error, tries used, seconds): retries with the wait that the kind of failure asks for; none after the last."""
    began, said = time.monotonic(), None
    for attempt in range(tries):
        try:
            return await asyncio.wait_for(p.complete(messages), per_call), None, attempt + 1, time.monotonic() - began
        except Exception as error:  # noqa: BLE001
            said = f"{type(error).__name__}: {error}"
            if attempt + 1 < tries:
                await asyncio.sleep(wait_seconds(kind_of(error), attempt, base))
    return None, said, tries, time.monotonic() - began


def complete(requests: DataFrame, p: Provider, concurrency: int = 50, tries: int = 5, per_call: float = 150.0, base_delay: float = 1.0, tasks: int = 8) -> DataFrame:
    """request_id, reply, usage (JSON), error, tries, seconds of every request (request_id, messages).

    The requests are spread over at most `tasks` tasks, which share the `concurrency` calls that may be open at once,
    so that is the bound over the whole cluster. The first call of a partition goes alone, so that a
    prompt cache is warm before the rest. The stage is not deterministic in Spark's sense; store its result before it
    is used twice, and keep speculation off, or calls are paid for again.
    """

    tasks = max(1, min(tasks, concurrency))
    each = max(1, concurrency // tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        async def all_of(frame: pd.DataFrame, first: bool) -> list:
            gate = asyncio.Semaphore(each)

            async def one(messages) -> tuple:
                async with gate:
                    return await call(p, [{"role": m["role"], "content": m["content"]} for m in messages], tries, per_call, base_delay)

            todo = list(frame.messages)
            if first and todo:
                await p.warm_up()
                head = [await one(todo[0])]
                return head + list(await asyncio.gather(*map(one, todo[1:])))
            return list(await asyncio.gather(*map(one, todo)))

        for k, frame in enumerate(frames):
            done = asyncio.run(all_of(frame, k == 0))
            yield pd.DataFrame(
                {
                    "request_id": frame.request_id,
                    "reply": [r.text.strip() if r else None for r, *_ in done],
                    "usage": [json.dumps(r.usage) if r and r.usage is not None else None for r, *_ in done],
                    "error": [e for _, e, *_ in done],
                    "tries": [n for _, _, n, _ in done],
                    "seconds": [s for *_, s in done],
                }
            )

    return requests.select("request_id", "messages").repartition(tasks).mapInPandas(run, "request_id string, reply string, usage string, error string, tries int, seconds double")


def complete_in_order(units: DataFrame, p: Provider, group: str = "doc_id", order: str = "ord", tries: int = 5, per_call: float = 150.0, base_delay: float = 1.0) -> DataFrame:
    """For stateful providers: a group's units one after the other, each with the exchanges before it.

    units has request_id, system and user; a failed unit leaves no trace in the history. A group is a document.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        past, rows = [], []
        for r in frame.sort_values(order).itertuples():
            asked = {"role": "user", "content": r.user}
            reply, error, n, seconds = asyncio.run(call(p, [{"role": "system", "content": r.system}, *past, asked], tries, per_call, base_delay))
            if reply:
                past += [asked, {"role": "assistant", "content": reply.text.strip()}]
            rows.append((r.request_id, reply.text.strip() if reply else None, json.dumps(reply.usage) if reply and reply.usage is not None else None, error, n, seconds))
        return pd.DataFrame(rows, columns=["request_id", "reply", "usage", "error", "tries", "seconds"])

    return units.groupBy(group).applyInPandas(run, "request_id string, reply string, usage string, error string, tries int, seconds double")
