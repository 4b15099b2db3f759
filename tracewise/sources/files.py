"""Files by name, and ranges of their bytes, through pyarrow's file systems; checksums as hash trees over ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from typing import NamedTuple

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a leaf and children of a node: they are part of what a checksum means.
LEAF = 8 << 20
CHILDREN = 256
#: Bytes that one task hashes, in whole leaves.
TASK = 64 * LEAF


class Found(NamedTuple):
    """A file: its full path, its path below the folder, and its size."""

    path: str
    name: str
    size: int


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or URI belongs to, and the path in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(path)


def listed(folder: str, pattern: str = "*", recursive: bool = False) -> list[Found]:
    """A folder's files whose name fits the pattern, ordered by name; hidden ones (``_`` or ``.`` in front) are left out.

    Raises FileNotFoundError if the folder is not there. Names are held by the driver, as Spark's own scans do.
    """
    store, root = filesystem(folder)
    seen = []
    for info in store.get_file_info(pafs.FileSelector(root, recursive=recursive)):
        name = info.path[len(root.rstrip("/")) :].lstrip("/")
        if info.is_file and not any(p[0] in "_." for p in name.split("/")) and fnmatchcase(info.base_name, pattern):
            seen.append(Found(f"{folder.rstrip('/')}/{name}", name, info.size))
    return sorted(seen, key=lambda f: (f.name.lower(), f.name))


def _leaves(batches: Iterator, leaf: int) -> Iterator:
    """``name, node, digest`` of every leaf of ranges ``path, name, start, stop``; a leaf is read at a time."""
    import pandas as pd

    for batch in batches:
        for path, name, start, stop in zip(batch["path"], batch["name"], batch["start"], batch["stop"], strict=True):
            store, inner = filesystem(path)
            rows = []
            with store.open_input_file(inner) as file:
                for at in range(start, max(stop, start + 1), leaf):
                    file.seek(at)
                    content = file.read(min(leaf, stop - at))
                    if len(content) != min(leaf, stop - at):
                        raise OSError(f"{path} is shorter than it was when it was listed")
                    rows.append((name, at // leaf, hashlib.sha256(content).hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "node", "digest"])


def tree_checksums(spark: SparkSession, files: list[Found], leaf: int = LEAF, task: int = TASK) -> DataFrame:
    """``name, sha256`` of files of any size.

    A file is cut into leaves of ``leaf`` bytes. A leaf's digest is the SHA-256 of its bytes; a node's is that of up to 256
    children's digests, joined as hex. The root stands for the file: for a file of one leaf, also an empty one, that is its
    plain SHA-256. ``task``, the bytes a task reads, is rounded up to whole leaves and has no part in the outcome.
    """
    step = -(-task // leaf) * leaf
    ranges = [(f.path, f.name, at, min(at + step, f.size)) for f in files for at in range(0, max(f.size, 1), step)]
    rows = spark.createDataFrame(ranges, "path string, name string, start long, stop long")
    # A range or a few small files a task.
    weight = sum(stop - start + (1 << 20) for _, _, start, stop in ranges)
    rows = rows.repartition(max(1, min(len(ranges), -(-weight // step))), "name", "start")
    nodes = rows.mapInPandas(lambda batches: _leaves(batches, leaf), "name string, node long, digest string")
    left = max((-(-f.size // leaf) for f in files), default=1)
    while left > 1:
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))
        above = nodes.groupBy("name", F.floor(F.col("node") / CHILDREN).alias("up")).agg(children.alias("c"))
        joined = F.array_join(F.transform("c", lambda x: x["digest"]), "")
        # A file that is at its root already stays as it is; others have more than one child at the first node.
        digest = F.when((F.size("c") == 1) & (F.col("up") == 0), F.col("c")[0]["digest"]).otherwise(F.sha2(joined, 256))
        nodes = above.select("name", F.col("up").alias("node"), digest.alias("digest"))
        left = -(-left // CHILDREN)
    return nodes.select("name", F.col("digest").alias("sha256"))
