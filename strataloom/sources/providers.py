"""Embedders and language models as batch functions over columns. HTTP ones need a server; tests use fakes."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Post = Callable[[str, dict, dict], dict]


def post(url: str, body: dict, headers: dict, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


Lines = Callable[[str, dict, dict], Iterator[bytes]]


def post_lines(url: str, body: dict, headers: dict, timeout: float = 60) -> Iterator[bytes]:
    """The lines of a reply as they come."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        yield from reply


def spoken(text: str | None) -> str:
    """What a reply says, without the thoughts before it."""
    said, rest = "", text or ""
    while "<think>" in rest:
        before, _, after = rest.partition("<think>")
        said += before
        thought, end, rest = after.partition("</think>")
        if not end:
            return (said + "<think>" + thought).strip()
    return (said + rest).strip()


class OllamaEmbedder:
    """One call a text; the task prefixes are only for models that want them. Errors are raised: there is no silent other model."""

    def __init__(self, url: str, model: str, send: Post = post):
        self.url, self.model, self.send, self.model_key = url, model, send, f"ollama:{model}"

    def _one(self, text: str, task: str) -> list[float]:
        prefix = f"search_{task}: " if self.model.startswith("nomic") else ""
        return self.send(f"{self.url}/api/embeddings", {"model": self.model, "prompt": prefix + text}, {})["embedding"]

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self._one(x, "document") for x in texts]

    def query(self, text: str) -> list[float]:
        return self._one(text, "query")


class OpenAIEmbedder:
    """One call a batch; no texts, no call."""

    def __init__(self, url: str, model: str, key: str = "", send: Post = post):
        self.url, self.model, self.key, self.send, self.model_key = url, model, key, send, f"openai:{model}"

    def documents(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        got = self.send(f"{self.url}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.key}"} if self.key else {})
        return [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]

    def query(self, text: str) -> list[float]:
        return self.documents([text])[0]


class OllamaLLM:
    """options: temperature and the like; keep_alive and think are sent only if they are set."""

    def __init__(self, url: str, model: str, send: Post = post, lines: Lines = post_lines, options: dict | None = None, keep_alive: str | None = None, think: bool | None = None):
        self.url, self.model, self.send, self.lines = url, model, send, lines
        self.extra = {k: v for k, v in (("options", options), ("keep_alive", keep_alive), ("think", think)) if v is not None}

    def _body(self, prompt: str, stream: bool, json_mode: bool, temperature: float | None) -> dict:
        body = {"model": self.model, "prompt": prompt, "stream": stream, **self.extra} | ({"format": "json"} if json_mode else {})
        return body if temperature is None else body | {"options": {**self.extra.get("options", {}), "temperature": temperature}}

    def generate(self, prompt: str, json_mode: bool = False, temperature: float | None = None) -> str:
        return spoken(self.send(f"{self.url}/api/generate", self._body(prompt, False, json_mode, temperature), {})["response"])

    def generate_stream(self, prompt: str) -> Iterator[str]:
        return ndjson_pieces(self.lines(f"{self.url}/api/generate", self._body(prompt, True, False, None), {}))


class OpenAILLM:
    def __init__(self, url: str, model: str, key: str = "", send: Post = post, lines: Lines = post_lines, options: dict | None = None):
        self.url, self.model, self.send, self.lines, self.extra = url, model, send, lines, options or {}
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def _body(self, prompt: str, stream: bool, json_mode: bool, temperature: float | None) -> dict:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], **self.extra} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        return body | ({"stream": True} if stream else {}) | ({} if temperature is None else {"temperature": temperature})

    def generate(self, prompt: str, json_mode: bool = False, temperature: float | None = None) -> str:
        return spoken(self.send(f"{self.url}/chat/completions", self._body(prompt, False, json_mode, temperature), self.headers)["choices"][0]["message"]["content"])

    def generate_stream(self, prompt: str) -> Iterator[str]:
        return sse_pieces(self.lines(f"{self.url}/chat/completions", self._body(prompt, True, False, None), self.headers))


EMBEDDERS, MODELS = {"ollama": OllamaEmbedder, "openai": OpenAIEmbedder}, {"ollama": OllamaLLM, "openai": OpenAILLM}


def embedder(kind: str, url: str, model: str, **more):
    """An embedder by the name of its kind; ValueError for a name that is not known."""
    if kind.lower() not in EMBEDDERS:
        raise ValueError(f"no embedder is called {kind}")
    return EMBEDDERS[kind.lower()](url, model, **more)


def language_model(kind: str, url: str, model: str, **more):
    """A language model by the name of its kind; ValueError for a name that is not known."""
    if kind.lower() not in MODELS:
        raise ValueError(f"no language model is called {kind}")
    return MODELS[kind.lower()](url, model, **more)


def ndjson_pieces(lines: Iterator[bytes], key: str = "response") -> Iterator[str]:
    """Text pieces of a stream with one JSON object a line; lines that are not JSON are passed over."""
    for line in lines:
        try:
            if piece := json.loads(line).get(key):
                yield piece
        except (ValueError, AttributeError):
            continue


def sse_pieces(lines: Iterator[bytes]) -> Iterator[str]:
    """Text pieces of server-sent events up to [DONE]."""
    for line in lines:
        text = line.decode("utf-8", "ignore").strip()
        if not text.startswith("data:"):
            continue
        if (data := text[5:].strip()) == "[DONE]":
            return
        try:
            if piece := json.loads(data)["choices"][0].get("delta", {}).get("content"):
                yield piece
        except (ValueError, LookupError):
            continue


#: Calls of a task at a time, tries of each, and seconds before the second one.
THREADS, TRIES, WAIT = 4, 3, 0.2


def ask(llm, prompt: str, parse: Callable[[str], dict | None], strict: str = "\nReply with one JSON object and nothing else.") -> dict | None:
    """A parsed reply in at most two tries at temperature 0, the second one strict; None if neither can be read."""
    for text, json_mode in ((prompt, False), (prompt + strict, True)):
        try:
            if (got := parse(llm.generate(text, json_mode, 0.0))) is not None:
                return got
        except Exception:  # a provider that fails counts as a reply that cannot be read
            continue
    return None


def one_object(raw: str | None) -> dict | None:
    """The outermost JSON object in a reply, or None. A comma before a closing bracket is forgiven."""
    text = spoken(raw)
    if (at := text.find("{")) < 0 or (end := text.rfind("}")) < at:
        return None
    decoder = json.JSONDecoder()
    for body in (text[at:], re.sub(r",(?=\s*[}\]])", "", text[at : end + 1])):
        try:
            got, _ = decoder.raw_decode(body)
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    return None


def patiently(call: Callable, tries: int = TRIES, wait: float = WAIT):
    """call(), tried again after a pause that doubles each time; the last error is raised."""
    for k in range(tries - 1):
        try:
            return call()
        except Exception:  # the provider may be busy
            time.sleep(wait * 2**k)
    return call()


def at_once(ask: Callable, items: list, threads: int) -> list:
    """ask(item) for each item, in their order, threads at a time; equal items are asked once."""
    single = list(dict.fromkeys(items))
    with ThreadPoolExecutor(max(1, min(threads, len(single) or 1))) as pool:
        found = dict(zip(single, pool.map(ask, single)))
    return [found[x] for x in items]


def embed(rows: DataFrame, embedder, text_col: str = "content", batch: int = 16, threads: int = THREADS) -> DataFrame:
    """rows with embedding. A task asks for batches of texts, threads at a time; equal texts of an Arrow batch are asked once. An error that stays after TRIES fails the job."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = list(dict.fromkeys(part))
            batches = [tuple(texts[at : at + batch]) for at in range(0, len(texts), batch)]
            got = at_once(lambda some: patiently(lambda: embedder.documents(list(some))), batches, threads)
            found = dict(zip(texts, (v for vectors in got for v in vectors)))
            yield pd.Series([found[x] for x in part], index=part.index, dtype=object)

    return rows.withColumn("embedding", run(F.col(text_col)))


def generate(rows: DataFrame, llm, prompt_col: str, out: str, threads: int = THREADS) -> DataFrame:
    """rows with a model's text; null where it says nothing, has no prompt, or fails TRIES times, so that a fallback can follow. A task asks threads at a time; equal prompts of an Arrow batch are asked once."""

    def one(prompt: str | None) -> str | None:
        if prompt is None:
            return None
        try:
            return (patiently(lambda: llm.generate(prompt)) or "").strip() or None
        except Exception:  # the extractive fallback takes over
            return None

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(at_once(one, [None if x is None or x != x else x for x in part], threads), index=part.index, dtype=object)

    return rows.withColumn(out, run(F.col(prompt_col)))
