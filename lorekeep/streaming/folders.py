"""A streaming source of file events: the changes between listings of watched folders.

spark.dataSource.register(FolderChanges), then
spark.readStream.format("folder_changes").option("watches", json of {project_id: path}).option("state", folder that driver and executors share).load()

An offset is the number of a kept listing. The driver's part of a listing is names, sizes and times; it stores one file per project, and a task per project compares two
listings and reads the contents of files whose size or time differ. Listings never change once they are written, so a batch that is repeated after a
restart has the same events, and the next application goes on from the last one. A listing is dropped when a batch behind it is committed.

Rows: project_id, path, kind (Created, Changed, Deleted, Renamed), old_path, seq. seq orders events over all batches. A watch may be a file: its siblings are not looked at. A
file that goes and one that comes with the same content in the same project are a rename, if neither side has several of them. A file is Changed if its
content is.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "project_id string, path string, kind string, old_path string, seq long"


def listed(top: str) -> dict[str, list[int]]:
    """Size and time of a file, or of all files below a folder; names that start with a dot are left out."""
    paths = [top] if os.path.isfile(top) else sorted(os.path.join(d, x) for d, _, names in os.walk(top) for x in names if not x.startswith("."))
    found = {}
    for path in paths:
        try:
            seen = os.stat(path)
        except OSError:  # gone meanwhile
            continue
        found[path] = [seen.st_size, seen.st_mtime_ns]
    return found


def _digest(path: str) -> str | None:
    sha = hashlib.sha256()
    try:
        with open(path, "rb") as file:
            while block := file.read(1 << 20):
                sha.update(block)
    except OSError:
        return None
    return sha.hexdigest()


def events(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str, str | None]]:
    """(path, kind, old_path) between two tables of the files' digests, in the order of paths."""
    gone, come = ({p: h for p, h in a.items() if p not in b} for a, b in ((before, after), (after, before)))
    left, right = _alone(gone), _alone(come)
    renamed = {right[h]: left[h] for h in left.keys() & right.keys()}
    out = [(p, "Renamed", old) for p, old in renamed.items()]
    out += [(p, "Created", None) for p in come if p not in renamed] + [(p, "Deleted", None) for p in gone if p not in renamed.values()]
    return sorted(out + [(p, "Changed", None) for p, h in after.items() if before.get(p, h) != h])


def _alone(side: dict[str, str]) -> dict[str, str]:
    """Paths by digest, of digests that one path has."""
    seen: dict[str, list[str]] = {}
    for p, h in side.items():
        seen.setdefault(h, []).append(p)
    return {h: p[0] for h, p in seen.items() if len(p) == 1}


class _Project(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


class _Reader(DataSourceStreamReader):
    def __init__(self, watches: dict[str, str], state: str):
        self.watches, self.state = watches, state

    def _at(self, version: int, project: str, kind: str = "listing") -> str:
        return os.path.join(self.state, f"v{version:012d}", f"{hashlib.sha256(project.encode()).hexdigest()[:24]}.{kind}.json")

    def _last(self) -> int:
        done = [int(x[1:]) for x in os.listdir(self.state) if x.startswith("v")] if os.path.isdir(self.state) else []
        return max(done, default=0)

    def _load(self, path: str) -> dict:
        try:
            with open(path) as file:
                return json.load(file)
        except FileNotFoundError:  # no such project in this listing
            return {}

    @staticmethod
    def _store(path: str, what: dict) -> None:
        """Written beside and put in place, so that nobody reads half of it."""
        os.makedirs(os.path.dirname(path), exist_ok=True)
        beside = f"{path}.{os.getpid()}"
        with open(beside, "w") as file:
            json.dump(what, file)
        os.replace(beside, path)

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        last = self._last()
        now = {project: listed(path) for project, path in self.watches.items()}
        if any(found != self._load(self._at(last, project)) for project, found in now.items()):
            beside = os.path.join(self.state, f".v{last + 1}")
            for project, found in now.items():
                self._store(self._at(last + 1, project).replace(os.path.join(self.state, f"v{last + 1:012d}"), beside), found)
            os.replace(beside, os.path.join(self.state, f"v{last + 1:012d}"))
            last += 1
        return {"version": last}

    def partitions(self, start: dict, end: dict) -> list[_Project]:
        return [_Project(project, start["version"], end["version"]) for project in sorted(self.watches)] if end["version"] > start["version"] else []

    def _digests(self, project: str, version: int) -> dict[str, str]:
        """Of a listing's files, kept beside it: once found they stay, so that a repeated batch tells the same. Contents are read where size or time differ from the listing before."""
        if version == 0:
            return {}
        path = self._at(version, project, "digests")
        if os.path.exists(path):
            return self._load(path)
        before = self._last_known(project, version)
        was, known = self._load(self._at(before, project)), self._load(self._at(before, project, "digests"))
        now = self._load(self._at(version, project))
        found = {p: known[p] if was.get(p) == x and p in known else _digest(p) for p, x in now.items()}
        found = {p: h for p, h in found.items() if h is not None}
        self._store(path, found)
        return found

    def _last_known(self, project: str, version: int) -> int:
        return next((v for v in range(version - 1, 0, -1) if os.path.exists(self._at(v, project, "digests"))), 0)

    def read(self, partition: _Project) -> Iterator[tuple]:
        before, after = self._digests(partition.name, partition.start), self._digests(partition.name, partition.end)
        for n, (path, kind, old) in enumerate(events(before, after)):
            yield partition.name, path, kind, old, (partition.end << 32) + n

    def commit(self, end: dict) -> None:
        for x in os.listdir(self.state) if os.path.isdir(self.state) else []:
            if x.startswith("v") and int(x[1:]) < end["version"] - 1:  # the last two stay for a batch that is repeated
                for name in os.listdir(os.path.join(self.state, x)):
                    os.remove(os.path.join(self.state, x, name))
                os.rmdir(os.path.join(self.state, x))


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(json.loads(self.options["watches"]), self.options["state"])
