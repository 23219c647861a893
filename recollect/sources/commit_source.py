"""Commit history of a repository as a data source: ``spark.read.format("commits")`` and ``spark.readStream.format("commits")``.

The driver asks ``git`` for the newest commit and for the number of commits only; each partition then reads its own part of the
log, without merges and commits that change no file, so the repository must lie on a path that all executors share.  A read is fixed to the commit that was newest
when it was planned: a partition that is tried again reads the same commits.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from recollect.sources.files import DIFF_BYTES

SCHEMA = "hash string, short string, author string, date string, subject string, body string, diff string, files_changed int"
#: Lines of a head and the line after a body start with this; those of bodies are indented and those of diffs start with a mark of theirs.
MARK, FIELD = b"\x1e", b"\x1f"
LOG = ("log", "--no-merges", "--no-color", "--no-ext-diff", "--no-textconv", "--encoding=UTF-8", "--submodule=short", "-p", "--format=%x1e%H%x1f%h%x1f%aI%x1f%an%x1f%s%n%w(0,1,1)%b%w(0,0,0)%n%x1e.")
PER_PARTITION = 1000
#: Pieces of a line that are read at once; a longer line is cut only where the diff is past its cap.
PIECE = 1 << 16


@dataclass
class Part(InputPartition):
    """``most`` commits of a range after the first ``skip``."""

    range: str
    skip: int
    most: int


def _git(path: str, *args: str, missing: bool = False) -> str:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True, check=False)
    if done.returncode and not missing:
        raise RuntimeError(f"git {args[0]} failed in {path}: {done.stderr.decode(errors='replace').strip()}")
    return "" if done.returncode else done.stdout.decode().strip()


def newest(path: str) -> str:
    """Hash of the newest commit; empty for a repository without commits."""
    _git(path, "rev-parse", "--git-dir")  # an error where there is no repository
    return _git(path, "rev-parse", "--verify", "--quiet", "HEAD", missing=True)


def _hash(value: str | None) -> str:
    if value and not re.fullmatch(r"[0-9a-fA-F]{4,64}", value):
        raise ValueError(f"not a commit hash: {value!r}")
    return value or ""


class _Log:
    """What both readers share."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("the commit source needs the path of a repository")
        self.path = options["path"]
        self.since = _hash(options.get("since"))
        self.most = int(options.get("maxCommits", 0))
        self.per_partition = int(options.get("perPartition", PER_PARTITION))
        if self.most < 0 or self.per_partition < 1:
            raise ValueError("maxCommits must be 0 or more and perPartition 1 or more")

    def parts(self, since: str, head: str) -> list[Part]:
        if not head or head == since:
            return []
        span = f"{since}..{head}" if since else head
        n = int(_git(self.path, "rev-list", "--count", "--no-merges", span))
        n = min(n, self.most) if self.most else n
        return [Part(span, at, min(self.per_partition, n - at)) for at in range(0, n, self.per_partition)]

    def rows(self, part: Part) -> Iterator[tuple]:
        # The folder's own settings must not change what a log looks like, and errors must not fill a pipe that nobody reads.
        run = ["git", "-C", self.path, "-c", "diff.noprefix=false", "-c", "diff.mnemonicPrefix=false", "-c", "log.showSignature=false", *LOG, f"--skip={part.skip}", f"--max-count={part.most}", part.range, "--"]
        with subprocess.Popen(run, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as process:
            # Without a filter of diffs, which would make git count fewer commits than a partition has.
            yield from (c for c in commits(iter(lambda: process.stdout.readline(PIECE), b"")) if c[-1])
            if process.wait():
                raise RuntimeError(f"git log failed for {part.range} in {self.path}")


def commits(lines: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of :data:`SCHEMA` from the lines of a log (or pieces of long ones), one commit at a time.

    Diffs end before the line that would take them over ``DIFF_BYTES``; all their files are counted.  Bytes that aren't UTF-8 are replaced.
    """
    head, body, diff, size, files, place, fresh = None, [], [], 0, 0, "", True

    def row() -> tuple:
        text = head.rstrip(b"\n").decode("utf-8", "replace").split("\x1f", 4)
        short, date, author, subject = text[1], text[2], text[3], text[4]
        return (text[0], short, author, date, subject, b"".join(body).decode("utf-8", "replace").strip(), b"".join(diff).decode("utf-8", "replace").strip(), files)

    for line in lines:
        starts, fresh = fresh, line.endswith(b"\n")
        if starts and line.startswith(MARK):
            if line.rstrip(b"\n") == MARK + b".":
                place = "diff"
                continue
            if head is not None:
                yield row()
            head, body, diff, size, files, place = line[1:], [], [], 0, 0, "head" if not fresh else "body"
        elif place == "head":  # the rest of a long subject
            head += line
            place = "head" if not fresh else "body"
        elif place == "body":
            body.append(line[1:] if starts and line.startswith(b" ") else line)
        elif place == "diff":
            files += starts and line.startswith(b"diff --git ")
            if starts:
                whole = len(diff)
            if size <= DIFF_BYTES:
                size += len(line)
                diff.append(line)
                if size > DIFF_BYTES:  # the whole line goes, with its earlier pieces
                    del diff[whole:]
    if head is not None:
        yield row()


class CommitReader(_Log, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts(self.since, newest(self.path)) or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition) if partition.most else iter(())


class CommitStreamReader(_Log, DataSourceStreamReader):
    """Offsets are hashes: a micro-batch has the commits that the newest one reaches and the last batch's doesn't."""

    def initialOffset(self) -> dict:
        return {"hash": self.since}

    def latestOffset(self) -> dict:
        return {"hash": newest(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(_hash(start["hash"]), _hash(end["hash"]))

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.rows(partition)


class CommitSource(DataSource):
    """Options: ``path`` of the repository; ``since``, a hash whose history is left out; ``maxCommits``, the newest ones only (of those that aren't merges; not for streams); ``perPartition``."""

    @classmethod
    def name(cls) -> str:
        return "commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CommitReader:
        return CommitReader(self.options)

    def streamReader(self, schema) -> CommitStreamReader:
        if int(self.options.get("maxCommits", 0)):
            raise ValueError("a stream of commits leaves none out: maxCommits is for batches")
        return CommitStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(CommitSource)
