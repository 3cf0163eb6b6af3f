"""Searches behind one interface, so that kinds of neighbours can be compared (survey 2.13, V22, U1)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators import ann, vectors


class Backend(Protocol):
    """Anything that finds neighbours: (query_id, rank, id, similarity) of queries (id, vector and what it needs)."""

    name: str

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


@dataclass(frozen=True)
class Exact:
    """All rows compared, under vectors.nearest's predicates."""

    name: str
    rows: DataFrame
    how: dict[str, Any] = field(default_factory=dict)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return vectors.nearest(self.rows, queries, k, **self.how)


@dataclass(frozen=True)
class Indexed:
    """A saved index."""

    name: str
    index: ann.Index

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return ann.search(self.index, queries, k)


def compared(backends: list[Backend], queries: DataFrame, k: int) -> DataFrame:
    """(backend, query_id, rank, id, similarity) of the same queries under each backend."""
    return reduce(DataFrame.unionByName, [b.search(queries, k).withColumn("backend", F.lit(b.name)) for b in backends])
