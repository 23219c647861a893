"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

For each response record two records are made:

* *conversion* (``text/plain``): the visible text of the response's HTML,
* *metadata* (``application/warc-fields``): status, source headers, digests, title, and the
  conversion's identifier.

Both name the response in ``WARC-Refers-To``, keep its target URI and date, and carry block and payload
digests (``sha1:`` in base 32) besides the response's own payload digest (``WARC-Source-Payload-Digest``).
Identifiers are name-based UUIDs of the response's identifier and the record type, so a task that runs again
makes the same records.

A record is one gzip member (with a fixed time stamp); members that follow each other are a WARC file.
:func:`read_records` and :func:`parse` read them back, :func:`save` writes files.

Responses are read as servers send them: heads may end their lines by LF alone and fold long values, transfer chunks are joined, and the
content codings gzip and deflate are opened as far as their data goes (what a crawler has opened already is taken as it is); of another
coding the conversion is empty and the metadata names it.  Malformed records (no length, no version, cut short, broken members, stray
bytes) become rows with an ``error`` and cost none of the records around them.

Defined cases: line ends in a URL become ``%0D`` and ``%0A``, in other header values a space, and what may not stand in a
header's name a hyphen, so that neither can end its line; a null URL leaves ``WARC-Target-URI`` out; null or empty HTML gives an empty payload and an
empty conversion; headers may be absent; ill-formed HTML is read as browsers do roughly (an open tag
or script runs to the end); repeated rows give equal records again; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CRLF = b"\r\n"
NAMESPACE = uuid.UUID("5d7f0a52-6b1f-5c0e-9a54-2f3d9b6f8c11")
#: Date of responses whose source has none.
DEFAULT_DATE = "2024-01-01T00:00:00Z"
_HIDDEN = {"script", "style", "noscript", "template"}
_CLOSING = {name: re.compile(f"</{name}", re.IGNORECASE | re.ASCII) for name in _HIDDEN}
_BLOCK = {"address", "article", "aside", "blockquote", "br", "div", "dd", "dl", "dt", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "title", "td", "th", "tr", "ul"}
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9-]*)")


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(map(str, parts)))}>"


_LINE_ENDS = re.compile(r"[\r\n]+")


def one_line(value: str) -> str:
    """A header's value without line ends."""
    return _LINE_ENDS.sub(" ", value)


def address(url: str) -> str:
    """A URL without line ends."""
    return url.replace("\r", "%0D").replace("\n", "%0A")


def write_record(headers: list[tuple[str, str]], block: bytes, compressed: bool = True) -> bytes:
    """One record; Content-Length is added."""
    head = b"".join(f"{k}: {one_line(v)}".encode() + CRLF for k, v in [*headers, ("Content-Length", str(len(block)))])
    raw = b"WARC/1.1" + CRLF + head + CRLF + block + CRLF + CRLF
    return gzip.compress(raw, mtime=0) if compressed else raw


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a file, opened one after the other; it is read by small steps, so that none is read again.

    A broken member gives what could be read of it, and reading goes on where the next one seems to begin.
    """
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts, begin = zlib.decompressobj(31), [], at
        try:
            while not d.eof and at < len(view):
                part = view[at : at + step]
                parts.append(d.decompress(part))
                at += len(part)
            at -= len(d.unused_data)
            parts.append(d.flush())
        except zlib.error:
            at = data.find(b"\x1f\x8b\x08", begin + 3)
            at = len(view) if at < 0 else at
            parts = parts or [bytes(view[begin:at])]
        yield b"".join(parts)


_NEXT = re.compile(rb"\nWARC/[0-9]")
_HEAD_END = re.compile(rb"\r?\n\r?\n")


def fields_of(head: str) -> tuple[str, list[tuple[str, str]]]:
    """First line, names and values of a head, whose lines end by CRLF or else by LF; one that begins with a space goes on with the value before it."""
    out: list[tuple[str, str]] = []
    first, *lines = head.split("\r\n" if "\r\n" in head else "\n")
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return first, out


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (names in lower case), block and error of each record of a WARC file, plain or by gzip members.

    After an error reading goes on at the next line that begins like a record.
    """
    for raw in members(data) if data[:2] == b"\x1f\x8b" else [data]:
        at = 0
        while True:
            while raw[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(raw):
                break
            end = _HEAD_END.search(raw, at)
            headers: dict[str, str] = {}
            if not raw.startswith(b"WARC/", at):
                error = "no version"
            elif not end:
                error = "no end of headers"
            else:
                headers = {k.lower(): v for k, v in fields_of(raw[at : end.start()].decode("utf-8", "replace"))[1]}
                length = headers.get("content-length", "")
                if not length.isascii() or not length.isdigit():
                    error = "no length"
                elif end.end() + int(length) > len(raw):
                    error = "cut short"
                else:
                    at = end.end() + int(length)
                    yield headers, raw[end.end() : at], None
                    continue
            begin = end.end() if headers and end else at
            following = _NEXT.search(raw, max(begin - 1, at))
            stop = following.start() + 1 if following else len(raw)
            yield headers, raw[begin:stop], error
            at = stop


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file that are well formed."""
    return ((headers, block) for headers, block, error in records_of(data) if error is None)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response."""
    gap = _HEAD_END.search(block)
    if not gap or not block.startswith(b"HTTP/"):
        return "", [], block
    return *fields_of(block[: gap.start()].decode("latin-1")), block[gap.end() :]


_CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n")


def joined_chunks(payload: bytes) -> bytes:
    """A payload without the marks of chunked transfer; one that has none is taken as it is, one cut short as far as it goes."""
    at, parts = 0, []
    while m := _CHUNK.match(payload, at):
        size = int(m.group(1), 16)
        parts.append(payload[m.end() : m.end() + size])
        at = m.end() + size
        if not size:
            return b"".join(parts)
        at += 2 if payload[at : at + 2] == b"\r\n" else payload[at : at + 1] == b"\n"
    return b"".join(parts) if parts and at >= len(payload) else payload


def opened(payload: bytes, kinds: tuple[int, ...]) -> bytes:
    """Data of a compressed payload, as far as it goes; what isn't compressed is taken as it is."""
    for bits in kinds:
        d, out = zlib.decompressobj(bits), b""
        try:
            for at in range(0, len(payload), 1 << 16):
                out += d.decompress(payload[at : at + (1 << 16)])
            return out + d.flush()
        except zlib.error:
            if out:
                return out
    return payload


def content(http: list[tuple[str, str]], payload: bytes) -> tuple[bytes, str | None]:
    """The page that a payload holds, without the codings that its headers name; the first coding that isn't known, if any."""
    said = lambda name: [c.strip().lower() for k, v in http if k.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in said("transfer-encoding"):
        payload = joined_chunks(payload)
    for coding in reversed(said("content-encoding")):
        if coding in ("gzip", "x-gzip"):
            payload = opened(payload, (31,)) if payload[:2] == b"\x1f\x8b" else payload
        elif coding == "deflate":
            payload = opened(payload, (15, -15))
        elif coding != "identity":
            return b"", coding
    return payload, None


#: The rest of a tag: quotes count as such where a value begins.
_REST = re.compile(r"""(?>[^>"'=]+|=\s*(?>"[^"]*"|'[^']*')|[="'])*+>""")
_NO_NAME = re.compile(r"[^!#$%&'*+.^_`|~0-9A-Za-z-]+")


def visible_text(source: str) -> tuple[str, str]:
    """Text and title of a page, in one pass over its tags."""
    out, title, at, inside = [], [], 0, False
    while at < len(source):
        tag = source.find("<", at)
        if tag < 0:
            tag = len(source)
        piece = source[at:tag]
        (title if inside else out).append(piece)
        if tag == len(source):
            break
        if source.startswith("<!--", tag):
            end = source.find("-->", tag + 4)
            at = len(source) if end < 0 else end + 3
            continue
        m = _NAME.match(source, tag + 1)
        if not m and source[tag + 1 : tag + 2] not in ("!", "?"):
            (title if inside else out).append("<")
            at = tag + 1
            continue
        rest = _REST.match(source, m.end()) if m else None
        end = rest.end() - 1 if rest else source.find(">", tag)
        at = len(source) if end < 0 else end + 1
        name, closing = (m.group(1).lower() if m else ""), source[tag + 1 : tag + 2] == "/"
        if name == "title":
            inside = not closing
        if name in _HIDDEN and not closing:
            close = _CLOSING[name].search(source, at)
            end = source.find(">", close.start()) if close else -1
            at = len(source) if end < 0 else end + 1
        if name in _BLOCK:
            out.append("\n")
    lines = [" ".join(x.split()) for x in html.unescape("".join(out)).split("\n")]
    return "\n".join(x for x in lines if x), " ".join(html.unescape("".join(title)).split())


def charset_of(headers: list[tuple[str, str]]) -> str:
    for k, v in headers:
        if k.lower() == "content-type" and (m := re.search(r"charset=[\"']?([A-Za-z0-9_-]+)", v, re.I)):
            return m.group(1)
    return "utf-8"


def decoded(payload: bytes, charset: str) -> str:
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def response_of(page_id: int | None, url: str | None, source: str | None, date: str = DEFAULT_DATE) -> tuple[list[tuple[str, str]], bytes]:
    """A response record (headers, block) of a fetched page."""
    payload = (source or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url, sha1(payload))), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", address(url))] if url else []
    return [*headers, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", sha1(payload)), ("WARC-Block-Digest", sha1(block))], block


def derive(headers: dict[str, str], block: bytes) -> list[tuple[list[tuple[str, str]], bytes]]:
    """The conversion and the metadata record of a response (header names in lower case)."""
    source = headers["warc-record-id"]
    status, http, payload = split_http(block)
    digest = headers.get("warc-payload-digest") or sha1(payload)
    page, unread = content(http, payload)
    text, title = visible_text(decoded(page, charset_of(http)))
    plain = text.encode()
    common = [("WARC-Date", headers.get("warc-date", DEFAULT_DATE))]
    common += [("WARC-Target-URI", headers["warc-target-uri"])] if headers.get("warc-target-uri") else []
    common += [("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", digest)]
    own = {kind: record_id(kind, source) for kind in ("conversion", "metadata")}
    fields = [("http-status", status), *[(f"source-{_NO_NAME.sub('-', k).lower()}", v) for k, v in http], ("source-payload-digest", digest)]
    fields += [("source-block-digest", headers["warc-block-digest"])] if headers.get("warc-block-digest") else []
    fields += [("content-coding-unread", unread)] if unread else []
    fields += [("title", title), ("conversion-record-id", own["conversion"]), ("conversion-length", str(len(plain)))]
    about = b"".join(f"{k}: {one_line(v)}".encode() + CRLF for k, v in fields)
    out = []
    for kind, mime, body in (("conversion", "text/plain; charset=utf-8", plain), ("metadata", "application/warc-fields", about)):
        linked = [("WARC-Concurrent-To", own["metadata" if kind == "conversion" else "conversion"])]
        out.append(([("WARC-Type", kind), ("WARC-Record-ID", own[kind]), *common, *linked, ("Content-Type", mime), ("WARC-Block-Digest", sha1(body)), ("WARC-Payload-Digest", sha1(body))], body))
    return out


RECORD = pa.schema([("page_id", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("source_digest", pa.string()), ("payload_digest", pa.string()), ("length", pa.int64()), ("block", pa.binary()), ("record", pa.binary())])
RECORD_DDL = "page_id long, type string, record_id string, refers_to string, target_uri string, date string, source_digest string, payload_digest string, length long, block binary, record binary"


def row_of(page_id: int | None, headers: list[tuple[str, str]], block: bytes, keep: bool) -> tuple:
    h = {k.lower(): v for k, v in headers}
    return (page_id, h["warc-type"], h["warc-record-id"], h.get("warc-refers-to"), h.get("warc-target-uri"), h["warc-date"], h.get("warc-source-payload-digest"), h["warc-payload-digest"], len(block), block if keep else None, write_record(headers, block) if keep else None)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(RECORD), RECORD, strict=True)], schema=RECORD)


def build(df: DataFrame, *, key: str = "page_id", url: str = "url", html_: str = "html", with_records: bool = True, responses: bool = False) -> DataFrame:
    """Derivative records (and, if asked for, the responses) of fetched pages, as rows of ``RECORD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for page, place, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    headers, block = response_of(page, place, source)
                    if responses:
                        rows.append(row_of(page, headers, block, with_records))
                    rows += [row_of(page, h, b, with_records) for h, b in derive({k.lower(): v for k, v in headers}, block)]
                yield batch_of(rows)

    return df.select(df[key].cast("long"), df[url], df[html_]).mapInArrow(run, RECORD_DDL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: file, headers (names in lower case), block and, of what is malformed, the error.

    A file is read whole by one task, so it may have 2 GB at most (the format advises 1 GB); its records
    are passed on a few at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = records_of(content_)
                while found := list(islice(records, 256)):
                    headers, blocks, errors = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([list(h.items()) for h in headers], pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary()), pa.array(errors, pa.string())], names=["file", "headers", "block", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, headers map<string,string>, block binary, error string")


def derive_records(records: DataFrame) -> DataFrame:
    """Derivatives of the well-formed responses among records as :func:`read_records` gives them; a response without an id is a row with an ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for headers, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = dict(headers)
                if known.get("warc-record-id"):
                    rows += [(*row_of(None, h, b, True), None) for h, b in derive(known, block)]
                else:
                    rows.append((*[None] * len(RECORD), "no record id"))
            schema = RECORD.append(pa.field("error", pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    good = F.col("error").isNull() & (F.lower(F.col("headers")["warc-type"]) == "response")
    return records.filter(good).select("headers", "block").mapInArrow(run, f"{RECORD_DDL}, error string")


def save(records: DataFrame, folder: str) -> None:
    """One ``.warc.gz`` file for each partition in a folder that all executors mount; a retried task replaces its own.

    Spark has no sink for raw bytes: for an object store, keep the rows of :func:`build` as a table instead.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        temporary = f"{name}.{task.taskAttemptId()}"
        n = 0
        try:
            with open(temporary, "wb") as f:
                for batch in batches:
                    for record in batch.column(0).to_pylist():
                        n += f.write(record)
            if n:
                os.replace(temporary, name)
        finally:
            if os.path.exists(temporary):
                os.remove(temporary)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["bytes"])

    os.makedirs(folder, exist_ok=True)
    records.select("record").mapInArrow(run, "bytes long").agg(F.sum("bytes")).collect()


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build(table(spark, sf_dir, "pages"))
    return built.select(*[n for n in RECORD.names if n not in ("block", "record")], F.sha2("block", 256).alias("block_sha256"), F.sha2("record", 256).alias("record_sha256"))
