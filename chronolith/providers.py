"""Interfaces of swappable models, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Interface names.
INTERFACES = ("ocr", "vlm", "llm", "embedding", "detector", "tracker", "segmenter", "decoder")
_PROVIDERS: dict[str, Callable[..., Any]] = {}


def provide(name: str, fn: Callable[..., Any]) -> None:
    if name not in INTERFACES:
        raise ValueError(f"no interface {name}")
    _PROVIDERS[name] = fn


def provider(name: str) -> Callable[..., Any]:
    return _PROVIDERS.get(name, _STUBS[name])


def _stub_embedding(text: str, size: int = 8) -> list[float]:
    return [b / 255 for b in hashlib.sha256(text.encode()).digest()[:size]]


_STUBS: dict[str, Callable[..., Any]] = {
    "ocr": lambda crop: "",
    "vlm": lambda frame: {"scene": "unknown", "confidence": 0.5},
    "llm": lambda prompt: "ANSWER: unknown",
    "embedding": _stub_embedding,
    "detector": lambda frame: [],
    "tracker": lambda boxes: boxes,
    "segmenter": lambda frame: [],
    "decoder": lambda path: [],
}


def text_udf(name: str) -> Callable[[Column], Column]:
    """A provider over a text column, a batch at a time; filter and deduplicate before it, Spark does not move filters past it."""
    fn = provider(name)

    @F.pandas_udf("string")
    def call(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else str(fn(x)))

    return call
