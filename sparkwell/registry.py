"""Named handlers: how callers, readers, steps, forms and vendors are extended."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """Handlers by name, with metadata. A name is given once; iteration is sorted."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self._items: dict[str, tuple[T, dict]] = {}

    def register(self, name: str, **meta) -> Callable[[T], T]:
        def add(handler: T) -> T:
            if name in self._items:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._items[name] = (handler, meta)
            return handler

        return add

    def get(self, name: str) -> T:
        if name not in self._items:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self)}")
        return self._items[name][0]

    def meta(self, name: str) -> dict:
        self.get(name)
        return dict(self._items[name][1])

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._items))

    def __contains__(self, name: object) -> bool:
        return name in self._items

    def __len__(self) -> int:
        return len(self._items)
