"""Clients of chat and embedding services over HTTP; they pickle, so that tasks may call them.

Two dialects are spoken, described by what differs between them: path, authorization, and where an answer's text stands.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

#: The two public dialects, timeouts in seconds, and words of an error that mean that an input is too long
DIALECTS = {
    "openai": {"path": "/v1/chat/completions", "auth": ("Authorization", "Bearer {}"), "headers": {}, "body": {}, "at": ("choices", 0, "message", "content"), "signs": ("messages", "model")},
    "anthropic": {"path": "/v1/messages", "auth": ("x-api-key", "{}"), "headers": {"anthropic-version": "2023-06-01"}, "body": {"max_tokens": 1024}, "at": ("content",), "signs": ("anthropic", "messages", "max_tokens")},
}
DETECT_TIMEOUT, EMBED_TIMEOUT, CHAT_TIMEOUT, TEMPERATURE = 10, 30, 300, 0.2
EMBED_BATCH = 16
TOO_LONG = (("too large",), ("too long",), ("maximum context",), ("batch size",), ("token", "limit"))


@dataclass(frozen=True)
class Reply:
    status: int
    text: str

    @property
    def data(self) -> dict:
        try:
            found = json.loads(self.text)
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    @property
    def too_long(self) -> bool:
        """An error whose message says that the input is too long."""
        low = self.text.lower()
        return self.status >= 400 and any(all(w in low for w in words) for words in TOO_LONG)


def post(url: str, body: dict, headers: dict[str, str], timeout: float) -> Reply:
    """An HTTP error is a reply; a failed connection is a RuntimeError."""
    call = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(call, timeout=timeout) as r:
            return Reply(r.status, r.read().decode("utf-8", "replace"))
    except urllib.error.HTTPError as e:
        return Reply(e.code, e.read().decode("utf-8", "replace"))
    except OSError as e:
        raise RuntimeError(f"no answer from {url}: {e}") from e


def text_at(data: dict, path: tuple) -> str:
    """Text at a path of keys and numbers; a list of parts is joined; nothing there is empty."""
    def step(x: object, key: object) -> object:
        try:
            return x[key]
        except (KeyError, IndexError, TypeError):
            return ""

    found = reduce(step, path, data)
    if isinstance(found, list):
        return "".join(str(p.get("text", "")) for p in found if isinstance(p, dict)).strip()
    return "" if found is None else str(found)


@dataclass(frozen=True)
class ChatModel:
    base_url: str
    model: str
    api_key: str | None = None
    dialect: str = "auto"
    max_tokens: int | None = None

    def _ask(self, dialect: str, prompt: str, timeout: float, **more: object) -> Reply:
        d = DIALECTS[dialect]
        headers = d["headers"] | ({d["auth"][0]: d["auth"][1].format(self.api_key)} if self.api_key else {})
        return post(self.base_url.rstrip("/") + d["path"], {"model": self.model, "messages": [{"role": "user", "content": prompt}], **d["body"], **more}, headers, timeout)

    def detected(self) -> ChatModel:
        """The same with its dialect found by a short question, where it is auto."""
        return self if self.dialect in DIALECTS else _detected(self)

    def __call__(self, prompt: str) -> str:
        me = self.detected()
        more = {"max_tokens": self.max_tokens} if self.max_tokens is not None and me.dialect == "openai" else {}
        r = me._ask(me.dialect, prompt, CHAT_TIMEOUT, temperature=TEMPERATURE, **more)
        text = text_at(r.data, DIALECTS[me.dialect]["at"])
        if r.status >= 400 or not text:
            raise RuntimeError(f"status {r.status} without text: {r.text[:200]}")
        return text


@lru_cache(maxsize=64)
def _detected(model: ChatModel) -> ChatModel:
    """Asked once in a process: a failure is not kept."""
    for name, d in DIALECTS.items():
        r = model._ask(name, "ping", DETECT_TIMEOUT, max_tokens=8)
        if d["at"][0] in r.data or r.status not in (404, 405) and any(s in r.text.lower() for s in d["signs"]):
            return replace(model, dialect=name)
    raise RuntimeError(f"{model.base_url} speaks neither dialect: {', '.join(DIALECTS)}")


def pieces_of(text: str, chars: int = 900, overlap: int = 120) -> list[str]:
    """Overlapping pieces of a trimmed text; the last ends with it."""
    t = text.strip()
    step = chars - overlap
    return [t[k * step : k * step + chars] for k in range(max(1, -(-(len(t) - overlap) // step)))] if t else []


def mean_of(vectors: list[list[float]]) -> list[float]:
    if len({len(v) for v in vectors}) != 1:
        raise ValueError("vectors of different lengths, or none")
    return [sum(x) / len(vectors) for x in zip(*vectors, strict=True)]


@dataclass(frozen=True)
class EmbeddingModel:
    base_url: str
    model: str
    api_key: str | None = None

    def _post(self, texts: str | list[str]) -> Reply:
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        return post(self.base_url.rstrip("/") + "/v1/embeddings", {"model": self.model, "input": texts}, headers, EMBED_TIMEOUT)

    def one(self, text: str) -> list[float]:
        r = self._post(text)
        found = r.data.get("data")
        if r.status < 400 and found:
            return [float(x) for x in found[0]["embedding"]]
        pieces = pieces_of(text)
        if r.too_long and len(pieces) > 1:
            return mean_of([self.one(p) for p in pieces])
        raise RuntimeError(f"status {r.status} without a vector: {r.text[:200]}")

    def __call__(self, texts: list[str]) -> list[list[float]]:
        """Vectors of texts, EMBED_BATCH of them in a request; where a service doesn't take several at once, or one is too long, each is asked for alone."""
        out: list[list[float]] = []
        for at in range(0, len(texts), EMBED_BATCH):
            some = texts[at : at + EMBED_BATCH]
            r = self._post(some) if len(some) > 1 else None
            found = r.data.get("data") if r is not None and r.status < 400 else None
            if isinstance(found, list) and len(found) == len(some):
                ordered = sorted(found, key=lambda x: x.get("index", 0)) if all("index" in x for x in found) else found
                out += [[float(v) for v in x["embedding"]] for x in ordered]
            else:
                out += map(self.one, some)
        return out
