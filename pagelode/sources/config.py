"""Configuration: JSON with comments and trailing commas, then environment, then command line, the last one wins."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.html import Selectors, checked

MODES = {"html": "Html", "markdown": "Markdown", "text": "Text"}
#: A default model and vector size per provider.
DEFAULT_MODELS = {
    "onnx": ("sentence-transformers/all-MiniLM-L6-v2", 384),
    "openai": ("text-embedding-3-small", 1536),
    "azure-openai": ("text-embedding-3-small", 1536),
    "ollama": ("nomic-embed-text", 768),
    "lmstudio": ("nomic-embed-text-v1.5", 768),
    "hash": ("hash", 384),
}


@dataclass
class SiteConfig:
    url: str = ""
    max_depth: int = 3
    frequency_hours: int = 24
    selectors: Selectors = field(default_factory=Selectors)
    mode: str | None = None


@dataclass
class CrawlConfig:
    sites: list[SiteConfig] = field(default_factory=list)
    respect_robots_txt: bool = True
    request_delay_ms: int = 500
    max_concurrency: int = 4
    user_agent: str = "pagelode/1.0"
    product_token: str = "pagelode"
    mode: str = "Markdown"


@dataclass
class EmbeddingConfig:
    provider: str = "onnx"
    model: str = ""
    dimensions: int = 0
    api_key: str | None = None
    endpoint: str | None = None
    model_path: str | None = None
    max_retries: int = 3

    def resolved(self) -> EmbeddingConfig:
        model, size = DEFAULT_MODELS.get(self.provider.lower(), DEFAULT_MODELS["onnx"])
        return EmbeddingConfig(self.provider, self.model or model, self.dimensions or size, self.api_key, self.endpoint, self.model_path, self.max_retries)

    def resolve_model_path(self) -> str:
        """The folder given, or the model's own below the home folder."""
        if self.model_path:
            return self.model_path
        return str(Path.home() / ".pagelode" / "models" / self.resolved().model.rstrip("/").rpartition("/")[2])


@dataclass
class StoreConfig:
    path: str = "page-index"
    collection: str = "web_pages"


@dataclass
class IndexConfig:
    store: StoreConfig = field(default_factory=StoreConfig)
    crawl: CrawlConfig = field(default_factory=CrawlConfig)
    embedding: EmbeddingConfig = field(default_factory=EmbeddingConfig)


def without_comments(text: str) -> str:
    """JSON text without // and /* */ comments and trailing commas; strings stay as they are."""
    out, i = [], 0
    string = re.compile(r'"(?:[^"\\]|\\.)*"')
    while i < len(text):
        if m := string.match(text, i):
            out.append(m[0])
            i = m.end()
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        elif text[i] == "," and re.match(r",(?:\s|//[^\n]*|/\*.*?\*/)*[}\]]", text[i:], re.S):
            i += 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def _fold(key: str) -> str:
    return key.replace("_", "").lower()


def _fill(target, data: dict):
    """Sets fields from keys in any case; unknown keys are ignored."""
    names = {_fold(n): n for n in target.__dataclass_fields__}
    for key, value in data.items():
        name = names.get(_fold(key))
        if name is None or value is None:
            continue
        now = getattr(target, name)
        if name == "mode":
            value = mode_of(value)
        elif name == "sites":
            value = [_fill(SiteConfig(), x) for x in value]
        elif hasattr(now, "__dataclass_fields__"):
            value = _fill(now, value)
        if name == "selectors":
            checked(value)
        setattr(target, name, value)
    return target


def mode_of(name: str) -> str:
    try:
        return MODES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown mode {name!r}; one of {', '.join(MODES.values())}") from None


def argument(args: list[str], name: str) -> str | None:
    """The value behind the first flag of that name, in any case."""
    for flag, value in zip(args, args[1:]):
        if flag.lower() == name.lower():
            return value
    return None


def load(path: str | None = None, args: list[str] = (), env: dict | None = None) -> IndexConfig:
    """A missing file gives the defaults."""
    env = os.environ if env is None else env
    config = IndexConfig()
    path = argument(list(args), "--config") or path or "pagelode.json"
    if Path(path).is_file():
        _fill(config, json.loads(without_comments(Path(path).read_text(encoding="utf-8"))))
    args = list(args)

    def pick(flag: str, *names: str):
        return argument(args, flag) or next((env[n] for n in names if env.get(n)), None)

    config.store.path = pick("--store", "PAGELODE_STORE") or config.store.path
    config.store.collection = pick("--collection", "PAGELODE_COLLECTION") or config.store.collection
    e = config.embedding
    e.provider = pick("--embedding-provider", "EMBEDDING_PROVIDER") or e.provider
    e.model = pick("--embedding-model", "EMBEDDING_MODEL") or e.model
    e.endpoint = pick("--embedding-url", "EMBEDDING_URL") or e.endpoint
    e.dimensions = int(pick("--embedding-dimensions", "EMBEDDING_DIMENSIONS") or e.dimensions)
    key = "AZURE_OPENAI_API_KEY" if e.provider.lower() == "azure-openai" else "OPENAI_API_KEY"
    e.api_key = pick("--embedding-key", "EMBEDDING_API_KEY", key) or e.api_key
    e.model_path = pick("--model-path", "EMBEDDING_MODEL_PATH") or e.model_path
    return config


def site_mode(site: SiteConfig, crawl: CrawlConfig) -> str:
    return site.mode or crawl.mode
