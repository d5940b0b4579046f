"""Results kept for the keys that a Python worker has met lately."""

from __future__ import annotations

from collections.abc import Callable


class Recent:
    """``make`` of many keys, remembered for two generations of about ``size`` keys each.

    Words repeat, so most are looked up; memory stays bounded whatever the texts.
    ``make`` takes a list of distinct keys and returns their values in that order;
    no value may be None.
    """

    def __init__(self, make: Callable[[list], list], size: int = 250_000):
        self.make, self.size = make, size
        self.young: dict = {}
        self.old: dict = {}

    def __call__(self, keys: list) -> list:
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        lacking = {k: self.old.get(k) for k, v in zip(keys, found) if v is None}
        fresh = [k for k, v in lacking.items() if v is None]
        lacking.update(zip(fresh, self.make(fresh)))
        if len(self.young) + len(lacking) > self.size:
            self.old, self.young = self.young, {}
        self.young.update(lacking)
        return [lacking[k] if v is None else v for k, v in zip(keys, found)]


class Known:
    """``make`` of many keys, for texts that are looked up many at a time.

    ``learn`` makes what is lacking of all given keys at once; after it, ``values``
    has them all. Beyond ``size`` keys it forgets those that are not among them.
    """

    def __init__(self, make: Callable[[list], list], size: int = 500_000):
        self.make, self.size = make, size
        self.values: dict = {}

    def learn(self, lists: list[list]) -> None:
        keys = set().union(*lists)
        lacking = list(keys.difference(self.values))
        if len(self.values) + len(lacking) > self.size:
            self.values = {k: v for k, v in self.values.items() if k in keys}
        self.values.update(zip(lacking, self.make(lacking)))
