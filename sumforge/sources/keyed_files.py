"""A sink that writes one text file for each key, and counts as a whole or not at all.

Tasks write into folders of their own, with a manifest each (file, lines, bytes, SHA-256). The job counts once its commit
file is there, which names the folders of the tasks that ended well; readers read only these, so neither a job that failed
nor a task that was run twice leaves anything that is seen. A job that fails removes what its tasks wrote.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "keyed_files"


@dataclass
class Task(WriterCommitMessage):
    folder: str
    files: int
    lines: int
    size: int


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class KeyedFiles(DataSource):
    """Writes rows (key string, line string); equal keys have to follow one another in one task. Options: path, suffix (.txt)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["key", "line"]:
            raise ValueError("the columns have to be key and line")
        return _Writer(self.options["path"], self.options.get("suffix", ".txt"), overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.job = f"{time.time_ns():020}-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Task:
        system, root = _system(self.path)
        context = TaskContext.get()
        folder = f"data/{self.job}/{context.partitionId():06}-{context.taskAttemptId()}"
        done, out, key, about, seen = Task(folder, 0, 0, 0), None, None, None, set()
        manifest = None

        def close() -> None:
            if out is not None:
                out.close()
                manifest.write((json.dumps({"file": about["file"], "lines": about["lines"], "bytes": about["bytes"], "sha256": about["sha"].hexdigest()}) + "\n").encode())
                done.files, done.lines, done.size = done.files + 1, done.lines + about["lines"], done.size + about["bytes"]

        for row in rows:
            if row[0] is None or row[0] == "":
                raise ValueError("a file needs a key")
            if manifest is None:
                system.create_dir(f"{root}/{folder}", recursive=True)
                listing = _listing(f"{root}/{folder}")
                system.create_dir(listing.rsplit("/", 1)[0], recursive=True)
                manifest = system.open_output_stream(listing)
            if row[0] != key:
                close()
                key = row[0]
                name = urllib.parse.quote(key, safe=" ") + self.suffix
                if name in seen:
                    raise ValueError(f"the lines of {key} do not follow one another")
                seen.add(name)
                out, about = system.open_output_stream(f"{root}/{folder}/{name}"), {"file": name, "lines": 0, "bytes": 0, "sha": hashlib.sha256()}
            line = ((row[1] or "") + "\n").encode()
            out.write(line)
            about["sha"].update(line)
            about["lines"], about["bytes"] = about["lines"] + 1, about["bytes"] + len(line)
        close()
        if manifest is not None:
            manifest.close()
        return done

    def commit(self, messages: list[Task | None]) -> None:
        system, root = _system(self.path)
        tasks = [m for m in messages if m is not None and m.files]
        before = _commits(system, root)
        about = {"folders": [t.folder for t in tasks], "files": sum(t.files for t in tasks), "lines": sum(t.lines for t in tasks), "bytes": sum(t.size for t in tasks), "replaces": sorted(before) if self.overwrite else []}
        system.create_dir(f"{root}/commits", recursive=True)
        with system.open_output_stream(f"{root}/commits/.{self.job}") as f:
            f.write(json.dumps(about).encode())
        system.move(f"{root}/commits/.{self.job}", f"{root}/commits/{self.job}")  # the step that counts
        if self.overwrite:
            for job in before:
                system.delete_file(f"{root}/commits/{job}")
                _delete(system, root, job)

    def abort(self, messages: list[Task | None]) -> None:
        system, root = _system(self.path)
        _delete(system, root, self.job)


def _listing(folder: str) -> str:
    """The manifest of a task's folder."""
    root, _, rest = folder.rpartition("/data/")
    return f"{root}/manifests/{rest}.jsonl"


def _delete(system, root: str, job: str) -> None:
    for kind in ("data", "manifests"):
        if any(x.base_name == job for x in system.get_file_info(_selector(f"{root}/{kind}"))):
            system.delete_dir(f"{root}/{kind}/{job}")


def _selector(path: str):
    from pyarrow import fs

    return fs.FileSelector(path, allow_not_found=True)


def _commits(system, root: str) -> dict[str, dict]:
    """The jobs that count, with what they wrote: all but those that another replaces."""
    found = {}
    for x in system.get_file_info(_selector(f"{root}/commits")):
        if not x.base_name.startswith("."):
            with system.open_input_stream(x.path) as f:
                found[x.base_name] = json.loads(f.read())
    for about in list(found.values()):
        for job in about["replaces"]:
            found.pop(job, None)
    return found


def write(rows: DataFrame, path: str, *, key: str, line: str, order: list[str], overwrite: bool = True) -> None:
    """rows as a file for each key: its lines in the given order, streamed, so that a file can be of any length."""
    spark = rows.sparkSession
    spark.dataSource.register(KeyedFiles)
    laid = rows.select(F.col(key).cast("string").alias("key"), F.col(line).cast("string").alias("line"), *(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)))
    laid = laid.repartition("key").sortWithinPartitions("key", *(f"__o{k}" for k in range(len(order))))
    laid.select("key", "line").write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()


def about(path: str) -> dict[str, int]:
    """How many files, lines and bytes there are."""
    jobs = _commits(*_system(path.rstrip("/")))
    return {k: sum(j[k] for j in jobs.values()) for k in ("files", "lines", "bytes")}


def folders(path: str) -> list[str]:
    """The folders whose files count: one for each task that wrote."""
    return [f"{path.rstrip('/')}/{f}" for about in _commits(*_system(path.rstrip("/"))).values() for f in about["folders"]]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(folder, file, lines, bytes, sha256) of every file that counts."""
    schema = "file string, lines long, bytes long, sha256 string"
    places = folders(path)
    if not places:
        return spark.createDataFrame([], f"folder string, {schema}")
    text = spark.read.schema(schema).json([_listing(p) for p in places])
    return text.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1).alias("folder"), "*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): every file that counts, whole."""
    places = folders(path)
    if not places:
        return spark.createDataFrame([], "key string, value string")
    rows = spark.read.text(places, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)  # encoded once for the file's name, and once more for the path
    for _ in range(2):
        name = F.url_decode(F.regexp_replace(name, r"\+", "%2B"))
    return rows.select(name.alias("key"), "value")
