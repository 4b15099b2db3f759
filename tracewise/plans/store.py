"""Compute-once results: a DataFrame is written to a keyed Parquet folder, or only its recipe is kept.

A recipe is the name of a function that returns a DataFrame, its parameters, and the keys of its inputs; an artifact of
which only the recipe is kept is a DataFrame made again when asked for, lazily. Keys hold a digest of function, parameters
and inputs, so results of other parameters are never served. All files go through Spark, to any file system it can write.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import shlex
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.plans.session import derivatives_root

STORED, RECIPE = "materialized", "mutation_record"
GIB = 1 << 30


class StoreError(RuntimeError):
    """Something the store can't do."""


@dataclass(frozen=True)
class Policy:
    """Whether a result is written: by kind first, then by how long it took, then by its size."""

    compute_seconds: float = 60.0
    size_bytes: int = 2 * GIB
    always: frozenset[str] = frozenset({"figure", "metric", "report"})
    never: frozenset[str] = frozenset()

    def decide(self, seconds: float | None, size: int | None, kind: str = "data") -> tuple[str, str]:
        """(representation, reason). What took long or an unknown time is written; what is large and cheap is not."""
        if kind in self.never:
            return RECIPE, "kind_never_materialized"
        if kind in self.always:
            return STORED, "kind_always_materialized"
        if seconds is None or seconds >= self.compute_seconds:
            return STORED, "expensive_to_recompute"
        if size is not None and size >= self.size_bytes:
            return RECIPE, "storage_heavy_cheap_compute"
        return STORED, "cheap_and_small"

    @staticmethod
    def read(data: Mapping[str, Any]) -> Policy:
        """From the settings of a policy file; a size in GiB goes before one in bytes."""
        return Policy(**{name: make(data[setting]) for setting, (name, make) in SETTINGS.items() if setting in data})


# How policy files call the settings. Later ones go before earlier ones of the same name.
SETTINGS: dict[str, tuple[str, Callable[[Any], Any]]] = {
    "compute_seconds_threshold": ("compute_seconds", float),
    "size_bytes_threshold": ("size_bytes", int),
    "size_gib_threshold": ("size_bytes", lambda gib: int(float(gib) * GIB)),
    "always_materialize_kinds": ("always", frozenset),
    "never_materialize_kinds": ("never", frozenset),
}


def name_of(function: Callable) -> str:
    """``module:name`` of a function that can be imported again; others are refused."""
    module, name = getattr(function, "__module__", None), getattr(function, "__qualname__", None)
    if not module or not name or "<" in name:
        raise StoreError(f"{function!r} can't be imported again; use a function of a module")
    return f"{module}:{name}"


def function_of(name: str) -> Callable:
    """The function that ``name_of`` named."""
    module, _, inner = name.partition(":")
    try:
        found: Any = importlib.import_module(module)
        for part in inner.split("."):
            found = getattr(found, part)
    except (ImportError, AttributeError, ValueError) as error:
        raise StoreError(f"{name!r} is no function that can be imported") from error
    if not callable(found):
        raise StoreError(f"{name!r} can't be called")
    return found


@dataclass(frozen=True)
class Record:
    """What is known of an artifact."""

    key: str
    function: str
    parameters: Mapping[str, Any] = field(default_factory=dict)
    inputs: tuple[str, ...] = ()
    kind: str = "data"
    representation: str = STORED
    reason: str = ""
    compute_seconds: float | None = None
    size_bytes: int | None = None
    note: str = ""

    def replay_command(self, root: str, out: str) -> str:
        """What to type to make the artifact again and write it below ``out``."""
        return shlex.join(["python", "-m", "tracewise", "replay", "--root", root, "--key", self.key, "--out", out])


def written_bytes(spark: SparkSession, path: str) -> int:
    """Size of the files below a folder."""
    return int(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0)


class Store:
    """Artifacts below a folder."""

    def __init__(self, spark: SparkSession, root: str, policy: Policy | None = None):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy or Policy()

    @classmethod
    def from_env(cls, spark: SparkSession, policy: Policy | None = None) -> Store:
        """The store in the folder of results that settings name."""
        return cls(spark, f"{derivatives_root()}/store", policy)

    def folder(self, key: str) -> str:
        """Where a key's data and record are."""
        return f"{self.root}/{key}"

    def exists(self, key: str) -> bool:
        """Whether anything is known of a key."""
        return self.record(key) is not None

    def remade(self, key: str) -> DataFrame:
        """The artifact made again from its recipe, also where it is stored; its inputs are read or made as usual."""
        record = self._known(key)
        return function_of(record.function)(*[self.resolve(k) for k in record.inputs], **record.parameters)

    def _known(self, key: str) -> Record:
        record = self.record(key)
        if record is None:
            raise StoreError(f"there is no artifact {key!r} below {self.root}")
        return record

    def key(self, name: str, function: Callable, parameters: Mapping[str, Any], inputs: Sequence[str]) -> str:
        """``name`` with a digest of all that the result follows from."""
        body = json.dumps([name_of(function), dict(parameters), list(inputs)], sort_keys=True, default=str)
        return f"{name}-{hashlib.sha256(body.encode()).hexdigest()[:12]}"

    def record(self, key: str) -> Record | None:
        """What is known of a key; None if nothing is."""
        try:
            body = json.loads(self.spark.read.text(f"{self.folder(key)}/record").first()[0])
        except AnalysisException:
            return None
        return Record(**(body | {"inputs": tuple(body["inputs"])}))

    def _note(self, record: Record) -> None:
        body = json.dumps(asdict(record), sort_keys=True, default=str)
        self.spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder(record.key)}/record")

    def resolve(self, key: str) -> DataFrame:
        """The artifact: read back, or made again from its recipe and its inputs', lazily."""
        if self._known(key).representation == STORED:
            return self.spark.read.parquet(f"{self.folder(key)}/data")
        return self.remade(key)

    def get_or_compute(
        self, name: str, function: Callable[..., DataFrame], inputs: Sequence[str] = (), parameters: Mapping[str, Any] | None = None,
        kind: str = "data", force: bool = False, note: str = "",
    ) -> tuple[str, DataFrame]:
        """(key, artifact), made and noted if it isn't there.

        A result is written, and the policy decides by the time that took and by its size whether it stays: what took long
        stays however large it is, and what is large but cheap gives way to its recipe. Results of kinds that are never
        stored are not made at all.
        """
        parameters = dict(parameters or {})
        key = self.key(name, function, parameters, inputs)
        if not force and self.exists(key):
            return key, self.resolve(key)
        called, seconds, size = name_of(function), None, None
        if kind not in self.policy.never:
            path, began = f"{self.folder(key)}/data", time.perf_counter()
            made = function(*[self.resolve(k) for k in inputs], **parameters)
            made.write.mode("overwrite").parquet(path)
            seconds, size = time.perf_counter() - began, written_bytes(self.spark, path)
        representation, reason = self.policy.decide(seconds, size, kind)
        if representation == RECIPE and size is not None:
            # The files make room for an empty table of the same columns.
            self.spark.createDataFrame([], made.schema).coalesce(1).write.mode("overwrite").parquet(path)
        self._note(Record(key, called, parameters, tuple(inputs), kind, representation, reason, seconds, size, note))
        return key, self.resolve(key)

    def lineage(self, key: str) -> list[Record]:
        """Records of the artifact and all it comes from, inputs first."""
        record = self._known(key)
        return [r for k in record.inputs for r in self.lineage(k)] + [record]
