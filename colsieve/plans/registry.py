"""A catalogue of queries, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return add
