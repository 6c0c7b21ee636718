"""Walking a source tree and reading Git history as DataFrames."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.text import ignore_regex
from quarry.operators.model import LANGUAGES, language_of

#: Files kept beside those of a known language.
CONFIG = r"(?i)(\.(json|toml|mod|txt|ya?ml)|(^|/)Dockerfile[^/]*)$"


def walk_files(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(file_path, language, source, bytes) of the source and configuration files below a folder that all executors see.

    ``ignore`` has gitignore lines; by default the ``.gitignore`` files of the tree hold below their folders. Hidden files
    count, ``.git`` does not. A file that is not UTF-8 is left out. The entries of the root are dealt to tasks, which
    walk and read them; links to folders are not followed.
    """
    base = root.removeprefix("file://").rstrip("/")
    entries = spark.createDataFrame([(e,) for e in sorted(os.listdir(base)) if e != ".git"], "entry string")
    known = re.compile(r"(?i)\.(" + "|".join(e for extensions in LANGUAGES.values() for e in extensions) + ")$")
    config = re.compile(CONFIG)

    def rules_of(folder: str) -> list[tuple]:
        lines = ignore if ignore is not None and not folder else None
        if ignore is None:
            try:
                with open(os.path.join(base, folder, ".gitignore"), encoding="utf-8", errors="replace") as text:
                    lines = text.read().splitlines()
            except OSError:
                lines = None
        out, back = ignore_regex(lines or [])
        return [(folder + "/" if folder else "", re.compile(out), re.compile(back) if back else None)] if out else []

    def left_out(path: str, rules: list[tuple]) -> bool:
        return any(path.startswith(f) and out.search(path[len(f) :]) and not (back and back.search(path[len(f) :])) for f, out, back in rules)

    def listed(entry: str) -> Iterator[str]:
        rules = {"": rules_of("")}
        if not os.path.isdir(os.path.join(base, entry)):
            if not left_out(entry, rules[""]):
                yield entry
            return
        for folder, folders, names in os.walk(os.path.join(base, entry)):
            folders[:] = sorted(f for f in folders if f != ".git")
            at = os.path.relpath(folder, base).replace(os.sep, "/")
            rules[at] = rules[at.rpartition("/")[0]] + rules_of(at)
            for name in sorted(names):
                if not left_out(f"{at}/{name}", rules[at]):
                    yield f"{at}/{name}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["file_path", "source", "bytes"])

        rows, held = [], 0
        for batch in batches:
            for path in (p for entry in batch["entry"].to_pylist() for p in listed(entry)):
                if not (known.search(path) or config.search(path)):
                    continue
                try:
                    with open(os.path.join(base, path), "rb") as data:
                        content = data.read()
                    rows.append((path, content.decode("utf-8"), len(content)))
                except (OSError, UnicodeDecodeError):
                    continue
                held += len(content)
                if held > 1 << 24:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    spread = entries.repartition(max(1, min(entries.count(), 4 * spark.sparkContext.defaultParallelism)))
    return spread.mapInArrow(read, "file_path string, source string, bytes long").select("file_path", language_of(F.col("file_path")).alias("language"), "source", "bytes")


class GitLogSource(DataSource):
    """``spark.read.format('git_log').option('repository', path).option('max_commits', n)``: commits and the files they touch.

    Columns hash, author, committed_at, message, file_path, change_type; a commit without files has a null path.
    Changes are those against the first parent; a commit without a parent touches no files.
    """

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return "hash string, short_hash string, author string, committed_at timestamp, message string, file_path string, change_type string"

    def reader(self, schema):  # noqa: ANN001, ANN201
        return _GitLogReader(self.options)


class _GitLogReader(DataSourceReader):
    def __init__(self, options):  # noqa: ANN001
        self.repository, self.most = options.get("repository"), int(options.get("max_commits", "1000"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        layout = "%x1e%H%x1f%h%x1f%an%x1f%ct%x1f%P%x1f%B%x1d"
        # Every commit is walked, each held against its first parent; the log is read as it comes.
        command = ["git", "-c", "safe.directory=*", "-C", self.repository, "log", f"-{self.most}", "--diff-merges=first-parent", "--name-status", f"--format={layout}"]
        names = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}

        def rows(record: str) -> Iterator[tuple]:
            head, _, files = record.partition("\x1d")
            full, short, author, seconds, parents, message = head.split("\x1f")
            at = datetime.datetime.fromtimestamp(int(seconds), datetime.UTC).replace(tzinfo=None)
            touched = [line.split("\t") for line in files.strip().split("\n") if "\t" in line] if parents else []
            for parts in touched or [[None]]:
                yield (full, short, author, at, message.strip(), parts[-1], names.get((parts[0] or " ")[0]))

        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as run:
            held = ""
            while part := run.stdout.read(1 << 16):
                *whole, held = (held + part).split("\x1e")
                for record in whole:
                    if record:
                        yield from rows(record)
            if held:
                yield from rows(held)
            trouble = run.stderr.read()
        if run.returncode:
            raise RuntimeError(trouble)


def git_log(spark: SparkSession, repository: str, max_commits: int = 1000) -> DataFrame:
    """The history of a repository as rows of commit and touched file, newest first."""
    spark.dataSource.register(GitLogSource)
    return spark.read.format("git_log").option("repository", repository).option("max_commits", str(max_commits)).load()


def suffix_links(history: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hash, node_id, change_type): each touched path linked to every node whose path ends with it, by whole components.

    Node paths are exploded into their suffixes, so the match is an equi-join.
    """
    parts = F.split(F.regexp_replace("file_path", r"\\", "/"), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    ends = nodes.where("file_path is not null").select(F.col("id").alias("node_id"), F.explode(suffixes).alias("suffix"))
    touched = history.where("file_path is not null").select("hash", "change_type", F.col("file_path").alias("suffix"))
    return touched.join(ends, "suffix").groupBy("hash", "node_id").agg(F.min("change_type").alias("change_type"))
