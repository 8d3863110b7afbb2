"""A memo of bounded size for values computed word by word inside a task."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable


class Generations:
    """Remembers at least the last `limit` different keys and at most twice as many."""

    def __init__(self, compute: Callable, limit: int, batched: bool = False) -> None:
        """compute: key to value, or with `batched` a list of keys to the list of their values."""
        self.compute = compute if batched else lambda keys: map(compute, keys)
        self.limit = limit
        self.young: dict[Hashable, object] = {}
        self.old: dict[Hashable, object] = {}

    def learn(self, keys: Iterable[Hashable]) -> None:
        """Make every one of the keys known until the next call."""
        young, old, keys = self.young, self.old, set(keys)
        missing = keys.difference(young)
        if missing and len(young) + len(missing) > self.limit:
            self.old = old = young
            self.young = young = {}
            missing = keys
        fresh = []
        for key in missing:
            value = old.get(key)
            if value is None:
                fresh.append(key)
            else:
                young[key] = value
        if fresh:
            young.update(zip(fresh, self.compute(fresh)))

    def many(self, keys: list) -> list:
        try:
            return list(map(self.young.__getitem__, keys))
        except KeyError:
            self.learn(keys)
            return list(map(self.young.__getitem__, keys))

    def one(self, key: Hashable):
        value = self.young.get(key)
        if value is None:
            self.learn((key,))
            value = self.young[key]
        return value
