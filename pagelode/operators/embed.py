"""Embedding providers and the embedding of chunks."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import time
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import pieces
from ..sources.config import EmbeddingConfig


class EmbeddingError(RuntimeError):
    def __init__(self, provider: str, operation: str, attempts: int, cause: Exception):
        super().__init__(f"{operation} by {provider} gave up at try {attempts}: {cause}")
        self.provider, self.operation, self.attempts = provider, operation, attempts
        self.__cause__ = cause


class EmbeddingProvider(ABC):
    name: str
    dimensions: int

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


class RetryingProvider(EmbeddingProvider):
    """Tries again after any exception, 1, 2, 4... seconds later; the last failure is wrapped."""

    def __init__(self, inner: EmbeddingProvider, max_retries: int = 3, delay: Callable[[int], float] | None = None, sleep=time.sleep):
        self.inner, self.max_retries, self.sleep = inner, max_retries, sleep
        self.delay = delay or (lambda attempt: 2.0 ** (attempt - 1))
        self.name, self.dimensions = inner.name, inner.dimensions

    def _run(self, operation: str, call):
        for attempt in range(1, self.max_retries + 2):
            try:
                return call()
            except Exception as e:  # noqa: BLE001  providers fail in their own ways
                if attempt > self.max_retries:
                    raise EmbeddingError(self.name, operation, attempt, e) from e
                print(f"embedding failed ({e}), attempt {attempt}", file=sys.stderr)
                self.sleep(self.delay(attempt))

    def embed(self, text):
        return self._run("embedding", lambda: self.inner.embed(text))

    def embed_batch(self, texts):
        return self._run("batch embedding", lambda: self.inner.embed_batch(texts)) if texts else []


class HashProvider(EmbeddingProvider):
    """Words hashed to signed places, normalised. Deterministic and without a model: for tests and offline use, not semantic.

    A word is a run of letters, digits and _ as Unicode has them, in lower case; the first 8 hex digits of its md5 are a number: if odd,
    it counts 1, else -1, at the place that half of it leaves modulo the dimensions."""

    name = "hash"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_batch(self, texts):
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
                out[i, (h >> 1) % self.dimensions] += 1 if h & 1 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32).tolist()


class OnnxProvider(EmbeddingProvider):
    """A local BERT model: word pieces, mean of the token vectors under the mask, normalised. The model knows `most_tokens` places: what is
    longer is cut there. Chunks stay below (512 estimated tokens of 4 characters), unless their words are rare."""

    name = "onnx"

    def __init__(self, model_path: str, vocab_path: str, dimensions: int = 384, most_tokens: int = 512):
        if not os.path.isfile(model_path) or not os.path.isfile(vocab_path):
            raise FileNotFoundError(f"no model at {model_path} with {vocab_path}")
        import onnxruntime
        from tokenizers import BertWordPieceTokenizer

        self.dimensions = dimensions
        self.tokenizer = BertWordPieceTokenizer(vocab_path, lowercase=True)
        self.tokenizer.enable_truncation(most_tokens)
        self.tokenizer.enable_padding()
        self.session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        self.inputs = {x.name for x in self.session.get_inputs()}

    def embed_batch(self, texts):
        if not texts:
            return []
        tokens = self.tokenizer.encode_batch(list(texts))
        feed = {
            "input_ids": np.array([t.ids for t in tokens], np.int64),
            "attention_mask": np.array([t.attention_mask for t in tokens], np.int64),
            "token_type_ids": np.array([t.type_ids for t in tokens], np.int64),
        }
        states = self.session.run(None, {k: v for k, v in feed.items() if k in self.inputs})[0]
        mask = feed["attention_mask"][:, :, None]
        mean = (states * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        return (mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)).tolist()


class HttpProvider(EmbeddingProvider):
    """Servers that speak the /embeddings protocol. At most `most_texts` go in a request, which waits `timeout` seconds."""

    def __init__(
        self, name: str, endpoint: str, model: str, dimensions: int, api_key: str | None, needs_key: bool,
        opened: Callable | None = None, most_texts: int = 256, timeout: float = 60.0,
    ):
        if needs_key and not api_key:
            raise ValueError(f"provider '{name}' needs an API key")
        self.name, self.dimensions, self.needs_key, self.most_texts = name, dimensions, needs_key, most_texts
        self.opened = opened or partial(urllib.request.urlopen, timeout=timeout)
        self.url, self.key = endpoint.rstrip("/") + "/embeddings", api_key or "no-key"
        self.model = model.rpartition("/")[2]

    def embed_batch(self, texts):
        return [v for i in range(0, len(texts), self.most_texts) for v in self._asked(list(texts[i : i + self.most_texts]))]

    def _asked(self, texts):
        body = {"model": self.model, "input": texts}
        if self.needs_key:
            body["dimensions"] = self.dimensions
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}", "api-key": self.key}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with self.opened(request) as answer:
            data = json.loads(answer.read())["data"]
        return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]


def _http(name: str, default: str, needs_key: bool):
    return lambda c: HttpProvider(name, c.endpoint or default, c.model, c.dimensions, c.api_key, needs_key)


def _onnx(c: EmbeddingConfig) -> EmbeddingProvider:
    folder = c.resolve_model_path()
    return OnnxProvider(os.path.join(folder, "model.onnx"), os.path.join(folder, "vocab.txt"), c.dimensions)


PROVIDERS: dict[str, Callable[[EmbeddingConfig], EmbeddingProvider]] = {
    "onnx": _onnx,
    "openai": _http("openai", "https://api.openai.com/v1", True),
    "azure-openai": _http("azure-openai", "https://api.openai.com/v1", True),
    "ollama": _http("ollama", "http://localhost:11434/v1", False),
    "lmstudio": _http("lmstudio", "http://localhost:1234/v1", False),
    "hash": lambda c: HashProvider(c.dimensions),
}


def create_provider(config: EmbeddingConfig) -> EmbeddingProvider:
    c = config.resolved()
    make = PROVIDERS.get(c.provider.lower())
    if make is None:
        raise ValueError(f"unknown embedding provider '{c.provider}'; supported: {', '.join(PROVIDERS)}")
    return RetryingProvider(make(c), c.max_retries)


#: Characters that a provider is given at a time, counted as it pads them: the longest text times the number of texts.
BATCH_CHARS = 200_000


def batches_by_length(lengths: list[int], most: int = BATCH_CHARS) -> list[list[int]]:
    """Places of texts in batches: texts of like length together, as many as fit; a text that alone is more is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if not out or (len(out[-1]) + 1) * lengths[i] > most:
            out.append([])
        out[-1].append(i)
    return out


def embedded(chunks: DataFrame, provider: Callable[[], EmbeddingProvider], text: str = "chunk_text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """chunks with embedding array<float> and embed_error. The provider is made once a task and given texts of like length together; a batch that fails is
    tried text by text, so a failure stays with the rows it belongs to."""
    names = [n for n in chunks.columns if n not in ("embedding", "embed_error")]
    fields = chunks.select(*names).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "embedding array<float>", "embed_error string"])

    def run(batches):
        own = None
        for batch in pieces(batches):
            own = own or provider()
            texts = batch[text].to_pylist()
            vectors, errors = [None] * len(texts), [None] * len(texts)
            for places in batches_by_length([len(t or "") for t in texts], batch_chars):
                try:
                    for i, v in zip(places, own.embed_batch([texts[i] for i in places]), strict=True):
                        vectors[i] = v
                except Exception:  # noqa: BLE001
                    for i in places:
                        try:
                            vectors[i] = own.embed(texts[i])
                        except Exception as e:  # noqa: BLE001
                            errors[i] = str(e)
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[*names, "embedding", "embed_error"]
            )

    return chunks.select(*names).mapInArrow(run, schema)


def embedded_once(chunks: DataFrame, provider: Callable[[], EmbeddingProvider], text: str = "chunk_text", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """As `embedded`, but each distinct text is given to the provider once, whatever number of chunks have it."""
    rows = chunks.drop("embedding", "embed_error").withColumn("_text_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    texts = rows.groupBy("_text_key").agg(F.first(F.coalesce(text, F.lit(""))).alias("_text"))
    vectors = embedded(texts, provider, "_text", batch_chars).drop("_text")
    return rows.join(vectors, "_text_key").drop("_text_key")


def whole_pages(embedded_chunks: DataFrame) -> DataFrame:
    """Only pages all of whose chunks were embedded."""
    failed = embedded_chunks.where("embed_error IS NOT NULL").select("url").distinct()
    return embedded_chunks.join(failed, "url", "left_anti").drop("embed_error")


