"""Indexes of texts and vectors that outlive a query: folders of segments.

A writer adds a segment for new or changed frames, then its manifest entry: a file named by the segment's number, made only if there is none
of that name.  Of two writers that want one number, the second takes the next, so a commit is never lost; readers take the segments that
have an entry, so a write that was cut short is never seen.  A micro-batch of a stream commits under its name and number, once: a retry
finds them and writes nothing.  Of a frame that is in several segments the newest counts, and a frame without content (or without a vector)
is gone.  :meth:`compact` makes one segment of all, which stands where the last of them stood, so what others add meanwhile is newer;
:meth:`vacuum` removes what no reader needs any more.

The shared file system must make a file only where there is none (HDFS and local ones do).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import bounded, spread

#: Postings of a file, about; files hold ranges of terms, so that a query's terms skip most of them.
FILE_POSTINGS = 5_000_000
#: Terms of a batch up to this number are pushed down to the files; more are joined.
PUSHED_TERMS = 2_000


class IndexRuleError(ValueError):
    """An index's rule is broken: vectors of another dimension, nothing to read."""


@dataclass
class Segment:
    """A manifest entry; ``batches`` has the last number of each stream that is in the segment or before it."""

    segment: int
    folder: str
    first_seq: int | None = None
    last_seq: int | None = None
    dimensions: int | None = None
    replaces: int | None = None
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def place(self) -> int:
        """Where it stands in the order of changes."""
        return self.segment if self.replaces is None else self.replaces


class _Segments:
    """Segments of one kind of rows under a path, with their manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        """A path and its file system."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _entries(self) -> list[Segment]:
        folder, fs = self._at(f"{self.path}/manifest")
        if not fs.exists(folder):
            return []
        out = []
        for status in fs.listStatus(folder):
            if status.getPath().getName().endswith(".json"):
                stream = fs.open(status.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                if text.endswith("}"):  # else a commit is under way, or was cut short
                    out.append(Segment(**json.loads(text)))
        return sorted(out, key=lambda x: x.segment)

    def segments(self) -> list[Segment]:
        """Entries that count, oldest first: a compacted segment replaces those before it."""
        rows = self._entries()
        start = max([r.replaces for r in rows if r.replaces is not None], default=-1)
        newest = max([r.segment for r in rows if r.replaces == start], default=-1)
        return sorted([r for r in rows if r.segment == newest or (r.segment > start and r.replaces is None)], key=lambda r: r.place)

    def last_seq(self) -> int:
        """The last sequence number that a segment holds, -1 for none."""
        return max([r.last_seq for r in self.segments() if r.last_seq is not None], default=-1)

    def last_batch(self, stream: str) -> int:
        """The last micro-batch of a stream that is in the index, -1 for none."""
        return max([r.batches.get(stream, -1) for r in self._entries()], default=-1)

    def _folder(self) -> str:
        return f"{self.path}/segments/{uuid.uuid4().hex}"

    def _commit(self, folder: str, *, batch: tuple[str, int] | None = None, batches: dict[str, int] | None = None, **entry) -> int | None:
        """Make the segment count; its number, or None if another writer has committed the batch meanwhile."""
        number = max([r.segment for r in self._entries()], default=-1) + 1
        while True:
            if batch and self.last_batch(batch[0]) >= batch[1]:
                self._drop(folder)
                return None
            made = Segment(number, folder.rsplit("/", 1)[1], batches=batches or ({batch[0]: batch[1]} if batch else {}), **entry)
            path, fs = self._at(f"{self.path}/manifest/{number:012d}.json")
            try:
                stream = fs.create(path, False)
            except Py4JJavaError as e:
                if "AlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                number += 1
                continue
            try:
                stream.write(bytearray(json.dumps(asdict(made)).encode()))
            finally:
                stream.close()
            return number

    def vacuum(self) -> int:
        """Remove the folders of segments that were replaced, and of commits that never came about; how many.  No one may be reading or writing."""
        folder, fs = self._at(f"{self.path}/segments")
        known = {r.folder for r in self.segments()}
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in known] if fs.exists(folder) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, folder: str) -> None:
        path, fs = self._at(folder)
        fs.delete(path, True)

    def _table(self, name: str, schema: str) -> DataFrame:
        """Rows of all segments that count, in one scan, with the segment's place."""
        seen = self.segments()
        if not seen:
            return self.spark.createDataFrame([], f"{schema}, segment long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/segments/{r.folder}/{name}" for r in seen])
        if len(seen) == 1:
            return rows.withColumn("segment", F.lit(seen[0].place).cast("long"))
        places = F.from_json(F.lit(json.dumps({r.folder: r.place for r in seen})), "map<string,bigint>")
        return rows.withColumn("segment", F.element_at(places, F.regexp_extract("_metadata.file_path", r"/segments/([0-9a-f]+)/", 1)))


#: Frames of a block, about: the unit that block maxima bound.
BLOCK_FRAMES = 128
#: Bytes of packed frames that a task unpacks at once.
PACKED_BYTES = 8 << 20


#: Term of the one row that each block has besides its postings: all of its frames; words are never empty.
EVERY = ""
#: What a block has of a term, for each frame: one value of these for all, as lists cost a value for each frame and column.
PACKED = np.dtype([("frame_id", "<i8"), ("tf", "<i4"), ("length", "<i4")])


class TextIndex(_Segments):
    """A row for each term of each block, in order of terms and blocks: its frames, and the maxima that bound them; and all frames."""

    BLOCKS = "term string, block long, df long, max_tf long, min_length int"
    POSTINGS, FRAMES = f"{BLOCKS}, frames binary", "frame_id long, length int, block long"

    def add(self, frames: DataFrame, *, seq: tuple[int | None, int | None] = (None, None), batch: tuple[str, int] | None = None) -> int | None:
        """Index frames (frame_id, content); null content removes a frame.  The number of the new segment.

        With ``batch``, the name of a stream and the number of its micro-batch: None, and nothing is done, if the index has it.
        """
        from recollect.functions.text import index_words

        if batch and self.last_batch(batch[0]) >= batch[1]:
            return None
        folder = self._folder()
        tokens = spread(frames.filter(F.col("content").isNotNull() & F.col("frame_id").isNotNull()).select(F.col("frame_id").cast("long").alias("frame_id"), "content")).select("frame_id", index_words(F.col("content")).alias("tokens"))
        made = self._write(tokens.mapInArrow(_in_blocks(BLOCK_FRAMES), self.POSTINGS), f"{folder}/unsorted")
        gone = frames.filter(F.col("content").isNull()).select(F.col("frame_id").cast("long").alias("frame_id"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("long").alias("block"))
        each = _single(made.filter(F.col("term") == EVERY).withColumn("segment", F.lit(0).cast("long")))
        self._write(each.select("frame_id", "length", "block").unionByName(gone), f"{folder}/frames")
        self._sorted(made.filter(F.col("term") != EVERY), folder)
        self._drop(f"{folder}/unsorted")
        return self._commit(folder, first_seq=seq[0], last_seq=seq[1], batch=batch)

    def _sorted(self, made: DataFrame, folder: str) -> None:
        """Write rows that are written already in order: they are read once more to find the ranges."""
        files = max(1, (made.agg(F.sum("df")).first()[0] or 0) // FILE_POSTINGS)
        self._write(made.repartitionByRange(files, "term", "block").sortWithinPartitions("term", "block"), f"{folder}/postings")

    def blocks(self, terms: DataFrame) -> DataFrame:
        """term, segment, block, df, max_tf, min_length of some terms; df counts the frames that count, the maxima bound them."""
        rows = self._of(self._table("postings", self.BLOCKS), terms)
        if len(self.segments()) < 2:
            return rows
        # Frames that a newer segment has, or none: their postings don't count.
        dead = self._table("frames", self.FRAMES).join(self.frames().select("frame_id", "segment"), ["frame_id", "segment"], "left_anti").select("frame_id", "segment")
        lost = _single(self._of(self._table("postings", self.POSTINGS), terms)).join(dead, ["frame_id", "segment"], "left_semi").groupBy("term", "segment", "block").agg(F.count(F.lit(1)).alias("lost"))
        return rows.join(lost, ["term", "segment", "block"], "left").withColumn("df", F.col("df") - F.coalesce("lost", F.lit(0))).drop("lost").filter("df > 0")

    def opened(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        """term, segment, block, frames (see ``PACKED``) of some blocks (segment, block) and terms, of the frames that count."""
        rows = self._of(self._table("postings", self.POSTINGS), terms).join(blocks, ["segment", "block"], "left_semi").select("term", "segment", "block", "frames")
        return _packed(self._counting(rows)).select("term", "segment", "block", "frames") if len(self.segments()) > 1 else rows

    def opened_each(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        """The same with a row for each frame: term, segment, block, frame_id, tf, length."""
        return _single(self.opened(blocks, terms))

    def _counting(self, rows: DataFrame) -> DataFrame:
        return _single(rows).join(self.frames().select("frame_id", "segment"), ["frame_id", "segment"], "left_semi")

    def _of(self, rows: DataFrame, terms: DataFrame) -> DataFrame:
        few = [r.term for r in terms.select("term").limit(PUSHED_TERMS + 1).collect()]
        return rows.filter(F.col("term").isin(few)) if len(few) <= PUSHED_TERMS else rows.join(terms.select("term"), "term", "left_semi")

    def frames(self) -> DataFrame:
        """frame_id, length, block and segment of the frames that count."""
        every = self._table("frames", self.FRAMES)
        if len(self.segments()) > 1:
            every = every.groupBy("frame_id").agg(F.max_by(F.struct("length", "block", "segment"), "segment").alias("at")).select("frame_id", "at.*")
        return every.filter("length IS NOT NULL").select("frame_id", "length", "block", "segment")

    def compact(self) -> bool:
        """Make one segment of all, if there are several; whether anything was written."""
        seen = self.segments()
        if len(seen) < 2:
            return False
        folder = self._folder()
        # Blocks of all segments are made anew, of frames of about equal length.
        numbered = self.frames().repartition(F.col("frame_id")).sortWithinPartitions("length", "frame_id").select("frame_id", "length", "segment", F.floor(F.monotonically_increasing_id() / BLOCK_FRAMES).alias("block"))
        live = self._write(numbered, f"{folder}/numbered")
        self._write(live.select("frame_id", "length", "block"), f"{folder}/frames")
        rows = _single(self._table("postings", self.POSTINGS)).drop("block", "length").join(live, ["frame_id", "segment"])
        made = _packed(rows.withColumn("segment", F.lit(0).cast("long"))).drop("segment")
        self._sorted(self._write(made, f"{folder}/unsorted"), folder)
        for name in ("numbered", "unsorted"):
            self._drop(f"{folder}/{name}")
        self._commit(folder, **_merged(seen))
        return True


def unpacked(frames: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of packed frames one after the other, and how many each value has."""
    size = pc.binary_length(frames).to_numpy(zero_copy_only=False).astype(np.int64) // PACKED.itemsize
    return np.frombuffer(b"".join(frames.to_pylist()), PACKED), size


def _single(rows: DataFrame) -> DataFrame:
    """term, segment, block, frame_id, tf, length from term, segment, block, frames."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in bounded(whole, pc.binary_length(whole.column(3)).to_numpy(zero_copy_only=False), PACKED_BYTES):
                entries, size = unpacked(batch.column(3))
                at = pa.array(np.repeat(np.arange(batch.num_rows), size))
                own = [pa.array(np.ascontiguousarray(entries[c]).astype(t)) for c, t in (("frame_id", np.int64), ("tf", np.int64), ("length", np.int32))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), *own], names=["term", "segment", "block", "frame_id", "tf", "length"])

    return rows.select("term", "segment", "block", "frames").mapInArrow(each, "term string, segment long, block long, frame_id long, tf long, length int")


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of the postings with their segment, from term, segment, block, frame_id, tf, length; a group holds one block."""

    def pack(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by([("length", "ascending"), ("frame_id", "ascending")]).combine_chunks()
        coded = pc.dictionary_encode(found.column("term")).chunk(0)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(code, kind="stable")
        frame, tf, length = (found.column(c).to_numpy()[order] for c in ("frame_id", "tf", "length"))
        out = _rows(coded.dictionary, np.bincount(code), frame, tf, length, key[1].as_py())
        return pa.Table.from_batches([out]).add_column(1, "segment", pa.repeat(key[0], out.num_rows))

    schema = TextIndex.POSTINGS.replace("term string", "term string, segment long")
    return rows.select("term", "segment", "block", "frame_id", "tf", "length").groupBy("segment", "block").applyInArrow(pack, schema)


def _in_blocks(size: int):
    """Frames (frame_id, tokens) as rows of the postings: those of a batch are cut into blocks of about equal length, so that bounds are close.

    A frame lies in one block, so what a block holds of a term is known within the task, and no posting is shuffled to count it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            frame, tokens = batch.column(0).to_numpy(), batch.column(1)
            length = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            order = np.lexsort((frame, length))
            for at in range(0, len(order), size):
                own = order[at : at + size]
                yield _block(frame[own], tokens.take(pa.array(own)), length[own], number)
                number += 1

    return cut


def _block(frame: np.ndarray, tokens: pa.Array, length: np.ndarray, number: int) -> pa.RecordBatch:
    n, coded = len(frame), pc.dictionary_encode(tokens.flatten())
    key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), length), return_counts=True)
    # First the row of all frames, then those of the terms.
    row = np.concatenate((np.arange(n), key % n))
    df = np.concatenate(([n], np.bincount(key // n, minlength=len(coded.dictionary))))
    term = pa.concat_arrays([pa.array([EVERY]), coded.dictionary.cast(pa.string())])
    return _rows(term, df, frame[row], np.concatenate((np.zeros(n, np.int64), tf)), length[row], number)


def _rows(term: pa.Array, df: np.ndarray, frame: np.ndarray, tf: np.ndarray, length: np.ndarray, number: int) -> pa.RecordBatch:
    """Rows of a block's terms; ``df`` entries belong to each."""
    entries = np.empty(len(frame), PACKED)
    entries["frame_id"], entries["tf"], entries["length"] = frame, tf, length
    ends = np.concatenate(([0], np.cumsum(df)))
    frames = pa.Array.from_buffers(pa.binary(), len(term), [None, pa.py_buffer((ends * PACKED.itemsize).astype(np.int32)), pa.py_buffer(entries)])
    maxima = [pa.array(np.maximum.reduceat(tf, ends[:-1]).astype(np.int64)), pa.array(np.minimum.reduceat(length, ends[:-1]).astype(np.int32))]
    return pa.RecordBatch.from_arrays([term, pa.array(np.full(len(term), number, np.int64)), pa.array(df.astype(np.int64)), *maxima, frames], names=["term", "block", "df", "max_tf", "min_length", "frames"])


def _merged(seen: list[Segment]) -> dict:
    """What the entry of a compacted segment says of those that it replaces."""
    names = {n for r in seen for n in r.batches}
    return {"first_seq": seen[0].first_seq, "last_seq": max([r.last_seq for r in seen if r.last_seq is not None], default=None), "replaces": seen[-1].place, "batches": {n: max(r.batches.get(n, -1) for r in seen) for n in names}}


class VectorIndex(_Segments):
    """Vectors (frame_id, embedding), all of one dimension."""

    VECTORS = "frame_id long, embedding array<float>"

    def add(self, vectors: DataFrame, *, seq: tuple[int | None, int | None] = (None, None), batch: tuple[str, int] | None = None) -> int | None:
        """Add vectors; a null one removes its frame.  Refused if lengths differ from each other or from those before; a batch is added once."""
        if batch and self.last_batch(batch[0]) >= batch[1]:
            return None
        sizes = [r.n for r in vectors.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("n")).count().limit(2).collect()]
        known = {r.dimensions for r in self.segments() if r.dimensions}
        if len(sizes) > 1 or 0 in sizes or (sizes and known and known != set(sizes)):
            raise IndexRuleError("vectors must not be empty and must have one dimension")
        folder = self._folder()
        vectors.select(F.col("frame_id").cast("long").alias("frame_id"), F.transform("embedding", lambda x: x.cast("float")).alias("embedding")).write.parquet(f"{folder}/vectors")
        return self._commit(folder, first_seq=seq[0], last_seq=seq[1], dimensions=sizes[0] if sizes else None, batch=batch)

    def add_after(self, mutations: DataFrame) -> int | None:
        """Add the vectors of mutations (seq, frame_id, embedding) that are newer than the last segment; None if none are.

        If the sequence has gone back, the index starts anew.
        """
        ends = mutations.agg(F.min("seq").alias("first"), F.max("seq").alias("last")).first()
        if ends.last is None:
            return None
        before = self.last_seq()
        anew = ends.last < before
        new = mutations if anew else mutations.filter(F.col("seq") > before)
        newest = new.groupBy("frame_id").agg(F.max_by("embedding", "seq").alias("embedding"), F.max("seq").alias("seq"))
        if not anew and ends.last <= before:
            return None
        if anew:
            seen = self.segments()
            folder = self._folder()
            newest.select("frame_id", F.transform("embedding", lambda x: x.cast("float")).alias("embedding")).write.parquet(f"{folder}/vectors")
            size = newest.filter("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
            return self._commit(folder, first_seq=ends.first, last_seq=ends.last, dimensions=size.n if size else None, replaces=seen[-1].place)
        return self.add(newest, seq=(before + 1, ends.last))

    def vectors(self) -> DataFrame:
        """frame_id and embedding that count."""
        every = self._table("vectors", self.VECTORS)
        newest = every.groupBy("frame_id").agg(F.max_by("embedding", "segment").alias("embedding")) if len(self.segments()) > 1 else every.select("frame_id", "embedding")
        return newest.filter("embedding IS NOT NULL")

    def compact(self) -> bool:
        seen = self.segments()
        if len(seen) < 2:
            return False
        folder = self._folder()
        self.vectors().write.parquet(f"{folder}/vectors")
        self._commit(folder, dimensions=max(r.dimensions or 0 for r in seen) or None, **_merged(seen))
        return True

    def graph(self, **settings):
        """Proximity graphs of the vectors that count, for approximate search."""
        from recollect.sources.graph import VectorGraph

        return VectorGraph(self.vectors(), **settings)
