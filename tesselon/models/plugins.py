"""Embedders and sentiment scorers by name, with fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import Column

from tesselon.functions.text import lexicon_sentiment
from tesselon.functions.vectors import hash_embedding

#: What is built in: a hash embedding of 32 numbers and the lexicon.
EMBEDDERS: dict[str, Callable[[], Callable[[Column], Column]]] = {"hash-32": lambda: lambda c: hash_embedding(c, 32)}
SCORERS: dict[str, Callable[[], Callable[[Column], Column]]] = {"lexicon": lambda: lexicon_sentiment}


def build_first(names: Sequence[str], builtin: dict[str, Callable]) -> tuple[str, Callable[[Column], Column]]:
    """(name, function of a text column) of the first candidate that can be built.

    A candidate is a built-in name or ``module:factory``; the factory takes nothing and gives a function from a column to
    a column, such as a vectorised UDF around a model. A candidate that fails for whatever reason gives way to the next;
    if none is left the last one's error is the cause of a RuntimeError.
    """
    error: Exception | None = None
    for name in names:
        try:
            if name in builtin:
                return name, builtin[name]()
            module, _, factory = name.partition(":")
            return name, getattr(import_module(module), factory)()
        except Exception as e:  # noqa: BLE001
            error = e
    raise RuntimeError(f"none of {list(names)} can be built") from error


def build_embedder(names: Sequence[str]) -> tuple[str, Callable[[Column], Column]]:
    """(name, embedder): text to an array of numbers."""
    return build_first(names, EMBEDDERS)


def build_scorer(names: Sequence[str]) -> tuple[str, Callable[[Column], Column]]:
    """(name, scorer): text to the struct that ``lexicon_sentiment`` gives."""
    return build_first(names, SCORERS)
