"""Dataclasses from parsed YAML: the types of the fields say how values are read, ``faults`` what else is asked of them."""

from __future__ import annotations

import types
from collections.abc import Iterator, Mapping
from dataclasses import MISSING, fields, is_dataclass
from functools import lru_cache
from pathlib import Path
from typing import Any, Literal, Self, Union, get_args, get_origin, get_type_hints

import yaml


class SpecError(ValueError):
    """A spec that can't be right."""


class Spec:
    """A dataclass that can be read from a mapping, and that no object with faults is made of."""

    def faults(self) -> Iterator[str]:
        """What is wrong with the values taken together."""
        yield from ()

    def __post_init__(self) -> None:
        if found := list(self.faults()):
            raise SpecError("; ".join(found))

    @classmethod
    def read(cls, data: Any) -> Self:
        """An object from a mapping of its fields."""
        return _record(cls, data, cls.__name__)

    @classmethod
    def load(cls, path: str | Path) -> Self:
        """An object from a YAML file, which errors name."""
        with named(path):
            return cls.read(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


class named:
    """Puts a name in front of errors that arise inside."""

    def __init__(self, name: object):
        self.name = name

    def __enter__(self) -> None: ...

    def __exit__(self, kind, error, trace) -> None:
        if isinstance(error, SpecError):
            raise SpecError(f"{self.name}: {error}") from error


@lru_cache(maxsize=64)
def _types(kind: type) -> dict[str, Any]:
    return get_type_hints(kind)


def _record(kind: type, data: Any, at: str) -> Any:
    if not isinstance(data, Mapping):
        raise SpecError(f"{at}: a mapping is wanted, not {data!r}")
    known = {f.name: f.default is MISSING and f.default_factory is MISSING for f in fields(kind)}
    for what, names in (("unknown", set(data) - set(known)), ("missing", {n for n, must in known.items() if must} - set(data))):
        if names:
            raise SpecError(f"{at}: {what} {', '.join(sorted(map(str, names)))}")
    held = {name: value(_types(kind)[name], own, f"{at}.{name}") for name, own in data.items()}
    with named(at):
        return kind(**held)


def value(kind: Any, data: Any, at: str) -> Any:
    """``data`` as a value of a type: scalars, literals, options, tuples, mappings from text, dataclasses."""
    shape, inner = get_origin(kind), get_args(kind)
    if is_dataclass(kind):
        return _record(kind, data, at)
    if shape is Literal and data in inner:
        return data
    if shape in (Union, types.UnionType):
        return _first_fit(inner, data, at)
    if shape is tuple and isinstance(data, (list, tuple)):
        each = inner[:1] * len(data) if inner[1:] == (...,) else inner
        if len(each) == len(data):
            return tuple(value(k, x, f"{at}[{i}]") for i, (k, x) in enumerate(zip(each, data, strict=True)))
    if shape is not None and isinstance(shape, type) and issubclass(shape, Mapping) and isinstance(data, Mapping):
        return {str(k): value(inner[1], x, f"{at}.{k}") for k, x in data.items()}
    if kind is Any:
        return data
    if kind is float and isinstance(data, (int, float)) and not isinstance(data, bool):
        return float(data)
    if kind in (int, str, bool) and type(data) is kind:
        return data
    raise SpecError(f"{at}: {data!r} is not {_spelled(kind)}")


def _first_fit(kinds: tuple, data: Any, at: str) -> Any:
    if data is None and type(None) in kinds:
        return None
    errors = []
    for kind in (k for k in kinds if k is not type(None)):
        try:
            return value(kind, data, at)
        except SpecError as error:
            errors.append(str(error))
    raise SpecError(" or ".join(errors))


def _spelled(kind: Any) -> str:
    return f"one of {', '.join(map(str, get_args(kind)))}" if get_origin(kind) is Literal else getattr(kind, "__name__", str(kind)) if get_origin(kind) is None else str(kind)
