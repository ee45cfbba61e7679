"""The extension points: what can be put in place of the built-in parts."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame

from quarry.plans.language import Query


class Embedder(Protocol):
    """A column of texts to a column of float arrays, all of one length; see ``semantic.embed``."""

    def __call__(self, text: Column) -> Column: ...


class SearchEngine(Protocol):
    """Scored documents of a query; see ``search.Index``."""

    docs: DataFrame

    def search(self, q: Query) -> DataFrame: ...


class ResponseParser(Protocol):
    """Raw responses (id, body or text) of a backend to rows of hits; see ``quarry.sources.responses``."""

    def __call__(self, bodies: DataFrame) -> DataFrame: ...


class RankFunction(Protocol):
    """Candidates to candidates with ``score``; see ``rank.score``."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...
