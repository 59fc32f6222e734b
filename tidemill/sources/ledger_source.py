"""A data source for append-only ledgers with durable commits: spark.read / readStream / write with format "tidemill_ledger".

A ledger is a folder of JSON-lines files under data/ and numbered commits under commits/, each a list of files. Writing tasks sync their file
and its folder; the commit is one synced file that gets its name by an exclusive link, so entries appear all or not at all and a
crash before that leaves nothing that a reader sees. A plain JSON-lines file, one that other tools append to, can be read and followed too.

The path is a folder that the driver and all executors have mounted, as fsync is a promise of POSIX file systems; where
only Spark's readers reach the data, use sources.ledger.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, WriterCommitMessage

NAME = "tidemill_ledger"
FIELDS = ["edit_id", "action", "outcome", "revert_method", "artifacts", "seq"]
#: commit and at order entries as they were added: the commit's number (0 in a plain file) and the byte of its file's line; part is the file's place in the commit.
SCHEMA = "edit_id string, action string, outcome string, revert_method string, artifacts array<string>, seq long, commit long, part int, at long, broken string"
SPLIT = 32 << 20


def _sync_folder(path: Path) -> None:
    """Makes new names in a folder durable."""
    f = os.open(path, os.O_RDONLY)
    try:
        os.fsync(f)
    finally:
        os.close(f)


def _synced(path: Path, lines: Iterator[str]) -> int:
    n = 0
    with path.open("w") as f:
        for line in lines:
            f.write(line + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    _sync_folder(path.parent)
    return n


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end)."""

    path: str
    start: int
    end: int
    commit: int
    part: int


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class _Ledger:
    """The files of a ledger; options: path, split_bytes, and for streams name."""

    def __init__(self, options: dict):
        place = options["path"].removeprefix("file:")
        self.path = Path("/" + place.lstrip("/") if place.startswith("/") else place)
        self.split, self.name = int(options.get("split_bytes", SPLIT)), options.get("name", "")
        self.plain = self.path.is_file()

    def commits(self, after: int = 0, to: int | None = None) -> list[tuple[int, dict]]:
        found = sorted((self.path / "commits").glob("*.json")) if (self.path / "commits").is_dir() else []
        numbers = [(int(p.stem), p) for p in found]
        return [(n, json.loads(p.read_text())) for n, p in numbers if n > after and (to is None or n <= to)]

    def whole_bytes(self) -> int:
        """Bytes of a plain file up to the end of its last whole line."""
        size = self.path.stat().st_size
        with self.path.open("rb") as f:
            at = size
            while at > 0:
                start = max(0, at - 65536)
                f.seek(start)
                cut = f.read(at - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                at = start
        return 0

    def ranges(self, path: Path, start: int, end: int, commit: int, part: int) -> list[Range]:
        return [Range(str(path), at, min(at + self.split, end), commit, part) for at in range(start, end, self.split)]

    def files(self, after: int = 0, to: int | None = None) -> list[Range]:
        return [r for n, c in self.commits(after, to) for i, name in enumerate(c["files"]) for r in self.ranges(self.path / "data" / name, 0, (self.path / "data" / name).stat().st_size, n, i)]

    def stage(self, rows: Iterator, names: list[str]) -> Written:
        (self.path / "data").mkdir(parents=True, exist_ok=True)
        file = f"{uuid.uuid4().hex}.jsonl"
        entries = (json.dumps({k: v for k, v in zip(names, r) if k in FIELDS and v is not None}, ensure_ascii=False, sort_keys=True) for r in rows)
        return Written(file, _synced(self.path / "data" / file, entries))

    def commit(self, messages: list, **more) -> None:
        """Names the files of a commit; the next free number is taken by a link, which fails if another writer has it."""
        written = [m for m in messages if m is not None]
        files = [m.file for m in written if m.rows]
        folder = self.path / "commits"
        folder.mkdir(parents=True, exist_ok=True)
        aside = folder / f".{uuid.uuid4().hex}"
        _synced(aside, iter([json.dumps({"files": files, "rows": sum(m.rows for m in written), **more})]))
        number = max((n for n, _ in self.commits()), default=0)
        while True:
            number += 1
            try:
                os.link(aside, folder / f"{number:012d}.json")
                break
            except FileExistsError:
                continue
        aside.unlink()
        _sync_folder(folder)
        _sync_folder(self.path)
        self.drop([m for m in written if not m.rows])

    def drop(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                (self.path / "data" / m.file).unlink(missing_ok=True)


def _entries(r: Range, wanted) -> Iterator[tuple]:
    """Rows of a range. A line that isn't a JSON object comes with its text as `broken`; one that the file ends within is not there yet."""
    with open(r.path, "rb") as f:
        f.seek(max(0, r.start - 1))
        at = r.start
        if r.start > 0 and f.read(1) != b"\n":
            at += len(f.readline())
        while at < r.end:
            line = f.readline()
            here, at = at, at + len(line)
            if not line.strip():
                if not line:
                    return
                continue
            try:
                found = json.loads(line)
                if not isinstance(found, dict):
                    raise ValueError("no object")
            except ValueError:
                if line.endswith(b"\n") and wanted({}):
                    yield (*[None] * len(FIELDS), r.commit, r.part, here, line.decode(errors="replace").rstrip("\n"))
                continue
            if wanted(found):
                yield (*_typed(found), r.commit, r.part, here, None)


def _typed(found: dict) -> list:
    text = [None if found.get(k) is None else str(found[k]) for k in FIELDS[:4]]
    artifacts, seq = found.get("artifacts"), found.get("seq")
    artifacts = None if artifacts is None else [str(x) for x in (artifacts if isinstance(artifacts, list) else [artifacts])]
    return [*text, artifacts, seq if isinstance(seq, int) and not isinstance(seq, bool) else None]


class Wanted:
    """Pushed filters on entries' own fields."""

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def push(self, f: Filter) -> bool:
        for kind, op in ((EqualTo, "="), (In, "in"), (GreaterThan, ">"), (GreaterThanOrEqual, ">=")):
            if isinstance(f, kind) and len(f.attribute) == 1 and f.attribute[0] in (FIELDS[:4] if op in ("=", "in") else ["seq"]):
                self.tests.append((f.attribute[0], op, f.value))
                return True
        return False

    def __call__(self, found: dict) -> bool:
        for field, op, value in self.tests:
            x = found.get(field)
            if field == "seq":
                x = x if isinstance(x, int) and not isinstance(x, bool) else None
            elif x is not None:
                x = str(x)
            if x is None or not {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value}[op]():
                return False
        return True


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Ledger(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(_Ledger(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a ledger is only added to")
        return _Writer(_Ledger(self.options), schema.fieldNames())

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(_Ledger(self.options), schema.fieldNames())


class _Reader(DataSourceReader):
    def __init__(self, ledger: _Ledger):
        self.ledger, self.wanted = ledger, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        yield from (f for f in filters if not self.wanted.push(f))

    def partitions(self) -> list[Range]:
        found = self.ledger.ranges(self.ledger.path, 0, self.ledger.path.stat().st_size, 0, 0) if self.ledger.plain else self.ledger.files()
        return found or [Range("/dev/null", 0, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _entries(partition, self.wanted)


class _Stream(DataSourceStreamReader):
    """Offsets: the number of the last commit, or of a plain file the bytes of its whole lines."""

    def __init__(self, ledger: _Ledger):
        self.ledger = ledger

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        if self.ledger.plain:
            return {"at": self.ledger.whole_bytes()}
        return {"at": max((n for n, _ in self.ledger.commits()), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        if self.ledger.plain:
            return self.ledger.ranges(self.ledger.path, start["at"], end["at"], 0, 0)
        return self.ledger.files(start["at"], end["at"])

    def read(self, partition: Range) -> Iterator[tuple]:
        return _entries(partition, Wanted())

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class _Writer(DataSourceWriter):
    def __init__(self, ledger: _Ledger, names: list[str]):
        self.ledger, self.names = ledger, names

    def write(self, iterator: Iterator) -> Written:
        return self.ledger.stage(iterator, self.names)

    def commit(self, messages: list) -> None:
        self.ledger.commit(messages)

    def abort(self, messages: list) -> None:
        self.ledger.drop(messages)


class _StreamWriter(DataSourceStreamWriter):
    """A batch that a commit of this stream (option name) already holds is dropped, so a repeated last batch adds nothing."""

    def __init__(self, ledger: _Ledger, names: list[str]):
        self.ledger, self.names = ledger, names

    def write(self, iterator: Iterator) -> Written:
        return self.ledger.stage(iterator, self.names)

    def commit(self, messages: list, batchId: int) -> None:
        if any(c.get("stream") == self.ledger.name and c.get("batch") == batchId for _, c in self.ledger.commits()):
            self.ledger.drop(messages)
        else:
            self.ledger.commit(messages, stream=self.ledger.name, batch=batchId)

    def abort(self, messages: list, batchId: int) -> None:
        self.ledger.drop(messages)


def register(spark) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
