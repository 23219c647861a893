"""The commit source over real repositories, batch and stream."""

import os
import subprocess

import pytest

from recollect.sources import commit_source, files


class Repo:
    def __init__(self, path):
        self.path = str(path)
        self.git("init", "-q", "-b", "main")

    def git(self, *args):
        who = {f"GIT_{w}_{k}": v for w in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Zoë | One"), ("EMAIL", "z@example.org"), ("DATE", "2024-03-05T06:07:08+00:00"))}
        return subprocess.run(["git", "-C", self.path, "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, env=os.environ | who).stdout.decode().strip()

    def commit(self, message, **contents):
        for name, content in contents.items():
            with open(os.path.join(self.path, name), "wb") as f:
                f.write(content if isinstance(content, bytes) else content.encode())
        self.git("add", "-A")
        self.git("commit", "-q", "--allow-empty", "-m", message)
        return self.git("rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    where = tmp_path / "repo"
    where.mkdir()
    return Repo(where)


def read(spark, repo, **options):
    commit_source.register(spark)
    return spark.read.format("commits").options(path=repo.path, **options).load()


def test_fields_bodies_and_diffs(spark, repo):
    repo.commit("first | one\n\nbody line\n\x1e.\n  indented\n\ndiff --git a/not b/not", a="x\n", b="y\n")
    repo.commit("long line", a="z" * 200_000 + "\n", b="w\n")
    repo.commit("many lines", c="".join(f"line {i}\n" for i in range(3000)), d=b"\xff\xfe\x1e.\n")
    repo.commit("nothing changed")
    rows = {r["subject"]: r for r in read(spark, repo).collect()}
    assert set(rows) == {"first | one", "long line", "many lines"}  # one changes no file
    one = rows["first | one"]
    assert (one["author"], one["files_changed"]) == ("Zoë | One", 2)
    assert one["date"].replace("Z", "+00:00") == "2024-03-05T06:07:08+00:00"
    assert one["hash"].startswith(one["short"])
    assert one["body"].split("\n") == ["body line", "\x1e.", "  indented", "", "diff --git a/not b/not"]
    assert one["diff"].startswith("diff --git a/a b/a") and one["diff"].endswith("+y")
    assert "zzz" not in rows["long line"]["diff"] and rows["long line"]["files_changed"] == 2
    diff = rows["many lines"]["diff"]
    assert 8100 < len(diff.encode()) <= files.DIFF_BYTES and diff.splitlines()[-1].startswith("+line ")
    assert rows["many lines"]["files_changed"] == 2


def test_partitions_cover_the_log_once(spark, repo):
    hashes = [repo.commit(f"c{i}", f=str(i)) for i in range(7)]
    repo.commit("nothing", f="6")
    df = read(spark, repo, perPartition="3")
    assert df.rdd.getNumPartitions() == 3
    assert sorted(r["hash"] for r in df.collect()) == sorted(hashes)
    assert {r["hash"] for r in read(spark, repo, since=hashes[3]).collect()} == set(hashes[4:])
    assert {r["hash"] for r in read(spark, repo, maxCommits="3").collect()} == set(hashes[5:])  # the newest one changes nothing
    assert read(spark, repo, since=hashes[-1]).count() == 0


def test_merges_are_left_out(spark, repo):
    kept = [repo.commit("base", f="0")]
    repo.git("checkout", "-q", "-b", "side")
    kept.append(repo.commit("side", g="1"))
    repo.git("checkout", "-q", "main")
    kept.append(repo.commit("main", h="1"))
    repo.git("merge", "-q", "--no-ff", "-m", "merged", "side")
    assert {r["hash"] for r in read(spark, repo).collect()} == set(kept)


def test_empty_missing_and_bad_options(spark, repo, tmp_path):
    assert read(spark, repo).count() == 0
    repo.commit("one", f="1")
    for options in ({"since": "--output=/tmp/x"}, {"perPartition": "0"}, {"maxCommits": "-1"}):
        with pytest.raises(Exception, match="commit hash|perPartition"):
            read(spark, repo, **options).count()
    with pytest.raises(Exception, match="failed"):
        spark.read.format("commits").load(str(tmp_path / "nowhere")).count()


def test_stream_goes_on_after_the_last_hash(spark, repo, tmp_path):
    commit_source.register(spark)

    def run():
        stream = spark.readStream.format("commits").load(repo.path)
        made = stream.select("hash", files.commit_content(stream).alias("content"), files.commit_metadata().alias("metadata"))
        query = made.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        return sorted(r["hash"] for r in spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect())

    first = [repo.commit(f"c{i}", f=str(i)) for i in range(3)]
    assert run() == sorted(first)
    assert run() == sorted(first)  # nothing new
    second = [repo.commit(f"d{i}", f=f"d{i}") for i in range(2)]
    assert run() == sorted(first + second)  # a new query from the checkpoint: each commit once
