"""Versioned manifests: a table is what its newest manifest lists.

Each commit puts version n + 1 in place only if that version isn't there already, so of two
writers one commits and the other is told: by a hard link on a local disk, by rename on HDFS
(either fails if the name is taken), elsewhere by creating the file without overwriting, which
object stores with conditional writes carry out at once.  For a store without them, pass a
function of your own.  Files go through Hadoop's file systems, hence to any storage Spark can
reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed this version first."""


@dataclass
class Run:
    """An immutable, sorted set of message files; ``holes`` are key ranges [low, high) taken over by later runs.

    ``low`` and ``high`` are its smallest and largest key.  Messages of a run at level 0 are all of ``batch``.
    """

    id: str
    rows: int
    ops: dict[str, int]
    batch: int
    level: int
    low: Any
    high: Any
    holes: list[list] = field(default_factory=list)


@dataclass
class Manifest:
    version: int
    key: str
    merge: str
    columns: list[str]
    schema: str
    next_batch: int = 0
    runs: list[Run] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)

    def copy(self) -> Manifest:
        return parse(dump(self))


def plain(value: Any) -> Any:
    """A key value of any orderable type as JSON, told apart by its tag."""
    if isinstance(value, bytes | bytearray):
        return {"hex": bytes(value).hex()}
    if isinstance(value, datetime):
        return {"time": value.isoformat()}
    if isinstance(value, date):
        return {"date": value.isoformat()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    if isinstance(value, tuple | list):
        return [plain(v) for v in value]
    if value is None or isinstance(value, str | int | float | bool):
        return value
    raise TypeError(f"a key of type {type(value).__name__} can't be written to a manifest")


_READ: dict[str, Callable[[str], Any]] = {"hex": bytes.fromhex, "time": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal}


def _restored(d: dict) -> Any:
    kind = next(iter(d), None)
    return _READ[kind](d[kind]) if len(d) == 1 and kind in _READ else d


def dump(m: Manifest) -> str:
    raw = asdict(m)
    for run in raw["runs"]:
        for name in ("low", "high", "holes"):
            run[name] = plain(run[name])
    return json.dumps(raw, indent=1)


def parse(text: str) -> Manifest:
    raw = json.loads(text, object_hook=_restored)
    return Manifest(**raw | {"runs": [Run(**r) for r in raw["runs"]]})


class Files:
    """The few file operations a table needs."""

    def __init__(self, spark: SparkSession, root: str, put_if_absent: Callable[[str, str], bool] | None = None):
        self._put = put_if_absent
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def list(self, name: str) -> list[tuple[str, int]]:
        """(name, bytes) of a folder's entries; none if it isn't there."""
        if not self._fs().exists(self._path(name)):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs().listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def _write(self, path, text: str) -> None:
        out = self._fs().create(path, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    def commit(self, name: str, text: str) -> None:
        """Write a file at once, or raise Conflict if it exists."""
        target = self._path(name)
        if self._put is not None:
            done = self._put(target.toString(), text)
        elif (scheme := self._fs().getUri().getScheme()) in ("file", "hdfs", "viewfs"):
            temporary = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
            self._write(temporary, text)
            done = self._linked(temporary, target) if scheme == "file" else self._fs().rename(temporary, target)
            self._fs().delete(temporary, False)
        else:
            done = self._taken(lambda: self._write(target, text))
        if not done:
            raise Conflict(name)

    def _linked(self, source, target) -> bool:
        place = lambda p: self._jvm.java.io.File(p.toUri().getPath()).toPath()
        return self._taken(lambda: self._jvm.java.nio.file.Files.createLink(place(target), place(source)))

    @staticmethod
    def _taken(act: Callable[[], Any]) -> bool:
        """Do it; False if the file is there already."""
        try:
            act()
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


FOLDER = "_manifest"


def versions(files: Files) -> list[int]:
    return sorted(int(n[1:-5]) for n, _ in files.list(FOLDER) if n.startswith("v") and n.endswith(".json"))


def load(files: Files, version: int | None = None) -> Manifest:
    known = versions(files)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{files.root}: no such table or version")
    return parse(files.read(f"{FOLDER}/v{known[-1] if version is None else version:012d}.json"))


def save(files: Files, m: Manifest) -> None:
    files.commit(f"{FOLDER}/v{m.version:012d}.json", dump(m))
