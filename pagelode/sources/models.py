"""Model files of the local embedding provider."""

from __future__ import annotations

import os
import sys
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from .config import EmbeddingConfig

BLOCK = 80 * 1024


@dataclass(frozen=True)
class ModelInfo:
    model_url: str
    vocab_url: str
    size: str


_HUB = "https://huggingface.co/sentence-transformers/all-MiniLM-L6-v2/resolve/main"
KNOWN_MODELS = {"sentence-transformers/all-MiniLM-L6-v2": ModelInfo(f"{_HUB}/onnx/model.onnx", f"{_HUB}/vocab.txt", "~80 MB")}


def download(url: str, path: str, opened: Callable = urllib.request.urlopen) -> None:
    """Streams a file into place, with progress on the error stream."""
    temp = path + ".part"
    with opened(url) as answer, open(temp, "wb") as out:
        total, done = int(answer.headers.get("Content-Length") or 0), 0
        while block := answer.read(BLOCK):
            out.write(block)
            done += len(block)
            if total:
                print(f"\r{os.path.basename(path)}: {100 * done // total} %", end="", file=sys.stderr)
        print(file=sys.stderr)
    os.replace(temp, path)


def ensure_model(config: EmbeddingConfig, auto: bool = False, ask: Callable[[str], str] = input, opened: Callable = urllib.request.urlopen) -> tuple[str, str]:
    """(model.onnx, vocab.txt) of the configured model; downloads known ones, after asking unless auto; an empty answer means yes."""
    folder = config.resolve_model_path()
    paths = os.path.join(folder, "model.onnx"), os.path.join(folder, "vocab.txt")
    if all(map(os.path.isfile, paths)):
        return paths
    name = config.resolved().model
    info = KNOWN_MODELS.get(name)
    if info is None:
        raise FileNotFoundError(f"no model in {folder}, and {name} isn't one that can be downloaded: {', '.join(KNOWN_MODELS)}")
    if not auto and ask(f"Download {name} ({info.size}) to {folder}? [Y/n] ").strip().lower() not in ("", "y", "yes"):
        raise FileNotFoundError(f"no model in {folder}")
    os.makedirs(folder, exist_ok=True)
    for url, path in zip((info.model_url, info.vocab_url), paths):
        if not os.path.isfile(path):
            download(url, path, opened)
    return paths
