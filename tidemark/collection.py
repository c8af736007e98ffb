"""A set with checked operations, for small driver-side metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Set:
    def __init__(self, values: Iterable = ()):
        self._values = set(values)

    def __contains__(self, v) -> bool:
        return v in self._values

    has = __contains__

    def __len__(self) -> int:
        return len(self._values)

    def __iter__(self):
        return iter(self._values)

    def add(self, v) -> None:
        if v in self._values:
            raise ValueError(f"{v!r} is there already")
        self._values.add(v)

    def add_multi(self, *values) -> None:
        for v in values:
            self.add(v)

    def filter(self, keep: Callable[[object], bool]) -> Set:
        return Set(v for v in self._values if keep(v))

    def union(self, other: Set) -> Set:
        return Set(self._values | other._values)

    def intersect(self, other: Set) -> Set:
        return Set(self._values & other._values)

    def difference(self, other: Set) -> Set:
        return Set(self._values - other._values)

    def compare(self, other: Set) -> tuple[bool, object]:
        """Equality, and a value that tells them apart."""
        odd = self._values ^ other._values
        return not odd, next(iter(odd), None)

    def to_list(self) -> list:
        return list(self._values)

    @classmethod
    def of_keys(cls, mapping: dict) -> Set:
        return cls(mapping)
