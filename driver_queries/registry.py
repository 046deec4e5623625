"""Registration of queries with their oracles."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, oracle: str | None = None):
        def add(fn):
            self.queries[fn.__name__] = fn
            if oracle is not None:
                self.oracles[fn.__name__] = oracle
            return fn

        return add
