"""What the operators take from outside: models are never built in. Without a provider an operator raises or takes its stated default."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Encoder(Protocol):
    """Adds `vector_col` (array<float>) for the texts of `text_col`."""

    def encode(self, df: DataFrame, text_col: str, vector_col: str) -> DataFrame: ...


class Completer(Protocol):
    """Adds `reply` for the prompts of `prompt_col`."""

    def complete(self, df: DataFrame, prompt_col: str) -> DataFrame: ...


class Extractor(Protocol):
    """Text of a document's bytes; called in the tasks."""

    def __call__(self, content: bytes) -> str: ...


class Scorer(Protocol):
    """Adds score columns to pairs (reference, generated)."""

    def __call__(self, pairs: DataFrame) -> DataFrame: ...


def required(provider, name: str):
    if provider is None:
        raise ValueError(f"{name} must be given: none is built in")
    return provider
