"""WARC archives: writing with segments and revisits, reading with reassembly.

Writing. Of records with equal payloads of at least LEAST_REVISIT bytes the one with the
smallest page_id is a response, the others are revisits that refer to it. HTTP bodies are
framed in chunks. A block longer than SEGMENT bytes is split: its first part is segment 1
of the response, the rest follows as continuation records, which go to the next archive
of the task, as the standard asks. Responses are written first, with an index of the
records that revisits need; revisits have no payload and name their response by its
WARC-Record-ID. Archives are rows of a table in the shared folder, each a run of gzip
members, one for each record, since executors share no local files.

Reading. Archives are inflated once. Whole records are decoded where they are read.
Segments are grouped by the identifier of their origin, ordered by number, checked against
the total length that the last one states, joined, and only then freed from their chunk
framing. Each revisit is looked up by the identifier that it refers to. A gap, a wrong
length, a broken frame, a digest that does not match, or a revisit whose response is not
there or has another payload is an error.

A null html is an empty payload; a null url leaves its header out; a null page_id stays
null and can't be referred to. Rows with equal page_id are separate records; if they share
the smallest page_id of a payload all of them are responses, and revisits refer to one of
them. An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

LEAST_REVISIT = 100
SEGMENT = 16 << 10
CHUNK = 4 << 10
ARCHIVE_BYTES = 8 << 20
_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in a body of chunked transfer framing, which may have extensions and trailers."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("the size of a chunk is no number") from None
        at = end + 2
        if not size:
            if body.find(b"\r\n", at) < 0:
                raise ValueError("the last chunk has no end")
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not as long as it says")
        parts.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, **headers) -> bytes:
    """One record, as a gzip member of its own."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8", "replace") + block + b"\r\n\r\n") + deflate.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with names in lower case, and block of one record."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    return headers, block


def records(archive: bytes):
    """Headers and blocks of an archive's records."""
    while archive:
        member = zlib.decompressobj(31)
        data = member.decompress(archive)
        if not member.eof:
            raise ValueError("an archive ends within a record")
        archive = member.unused_data
        yield parse(data)


def _payload(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding") == "chunked" else body


def _escaped(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def revisit(page_id, url, n_bytes: int, digest: str, target: str, row: str) -> bytes:
    """The record of a page whose payload is that of the record target."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    return record(
        "revisit", _name(page_id, row), block, WARC_Target_URI=_escaped(url), WARC_Payload_Digest=f"sha256:{digest}",
        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=f"<{target}>", Content_Type="application/http; msgtype=response",
    )


def _name(page_id, row: str) -> str:
    return f"urn:trailhead:page:{'' if page_id is None else page_id}:{row}"


def rows_of_page(page_id, url, payload: bytes, digest: str, refers_to, row: str) -> list[bytes]:
    """The record of a page and, where it is segmented, its continuations; refers_to is the record of its response, if it is a revisit."""
    if refers_to is not None:
        return [revisit(page_id, url, len(payload), digest, refers_to, row)]
    name = _name(page_id, row)
    common = {"WARC_Target_URI": _escaped(url), "WARC_Payload_Digest": f"sha256:{digest}"}
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = {"Content_Type": "application/http; msgtype=response"}
    if len(block) <= SEGMENT:
        return [record("response", name, block, **common, **kind)]
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    out = [record("response", name, parts[0], WARC_Segment_Number=1, **common, **kind)]
    for i, part in enumerate(parts[1:], 2):
        total = {"WARC_Segment_Total_Length": len(block)} if i == len(parts) else {}
        out.append(record("continuation", f"{name}:{i}", part, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=i, **total, WARC_Target_URI=_escaped(url)))
    return out


_ENTRY = pa.struct([("digest", pa.string()), ("page_id", pa.int64()), ("record_id", pa.string())])
_ARCHIVE = pa.schema([("name", pa.string()), ("content", pa.binary()), ("entries", pa.list_(_ENTRY))])
_ARCHIVE_SQL = "name string, content binary, entries array<struct<digest:string,page_id:long,record_id:string>>"


def _archives(rows: DataFrame, label: str, made_of) -> DataFrame:
    """A table of archives; made_of gives the records of a row and its entry of the index or None."""

    def run(batches):
        part = TaskContext.get().partitionId()
        open_, entries, size, later, number, n = [], [], 0, [], 0, 0

        def closed(content):
            return base.batch_of({"name": [f"{label}-{part:06d}-{number:06d}.warc.gz"], "content": [b"".join(content)], "entries": [entries]}, _ARCHIVE)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made, entry = made_of(row, f"{label[0]}{part}-{n}")
                n += 1
                open_.append(made[0])
                later += made[1:]
                entries += [entry] if entry else []
                size += sum(map(len, made))
                if size >= ARCHIVE_BYTES:
                    yield closed(open_)
                    open_, later, entries, number = later, [], [], number + 1
                    size = sum(map(len, open_))
        for left in (open_, later):
            if left:
                yield closed(left)
                entries, number = [], number + 1

    return base.materialise(base.arrow_map(rows, run, _ARCHIVE_SQL), label)


def write(pages: DataFrame) -> DataFrame:
    """A table of archives (name, content, entries) in the shared folder."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(base.text_or_empty("html"), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    long = rows.select("page_id", "url", F.length("payload").alias("n_bytes"), "digest").where(F.col("n_bytes") >= LEAST_REVISIT).where("page_id IS NOT NULL")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    total = pages.count()
    # written first, so that the planner knows how few or many they are; without payloads
    again = base.materialise(base.spread_join(long, first, "digest", "page_id", total).where("page_id > first"), "revisits")

    def response(row, name):
        page_id, url, payload, digest, wanted = row
        return rows_of_page(page_id, url, payload, digest, None, name), {"digest": digest, "page_id": page_id, "record_id": _name(page_id, name)} if wanted else None

    def later(row, name):
        page_id, url, n_bytes, digest, target = row
        return [revisit(page_id, url, n_bytes, digest, target, name)], None

    own = rows.join(again.select("page_id", "digest").distinct(), ["page_id", "digest"], "left_anti")
    wanted = F.col("page_id").isNotNull() & (F.length("payload") >= LEAST_REVISIT)
    responses = _archives(own.select("page_id", "url", "payload", "digest", wanted), "warc", response)
    index = responses.select(F.explode("entries").alias("e")).select("e.digest", F.col("e.page_id").alias("first"), "e.record_id")
    index = index.join(again.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n")), ["digest", "first"])
    index = index.groupBy("digest").agg(F.min("record_id").alias("target"), F.max("n").alias("n"))
    found = base.spread_join(again.select("page_id", "url", "n_bytes", "digest"), index, "digest", "page_id", total)
    revisits = _archives(found.select("page_id", "url", "n_bytes", "digest", "target"), "revisits", later)
    return responses.unionByName(revisits)


def _described(headers: dict[str, str], block: bytes) -> dict:
    """The columns of a whole record's page."""
    record_id = headers["warc-record-id"].strip("<>")
    page_id = record_id.split(":")[3]
    digest = headers["warc-payload-digest"].partition(":")[2]
    http, payload = _payload(block)
    again = headers["warc-type"] == "revisit"
    if not again and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload does not have the digest that its record states")
    return {
        "page_id": int(page_id) if page_id else None,
        "payload_bytes": int(http["content-length"]) if again else len(payload),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "record_id": record_id,
        "target": headers["warc-refers-to"].strip("<>") if again else None,
    }


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("target", pa.string())])
_PAGE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, target string"
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
_SEGMENT_SQL = "origin string, number int, total long, headers map<string,string>, block binary"


def _columns(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return base.batch_of({f.name: [r.get(f.name) for r in rows] for f in schema}, schema)


def reassembled(parts: list[dict]) -> dict:
    """The page of a segmented record: parts have number, total, headers of segment 1, block."""
    parts = sorted(parts, key=lambda p: p["number"])
    if [p["number"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing or there twice")
    block = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] != len(block):
        raise ValueError("segments do not add up to the stated length")
    return _described(dict(parts[0]["headers"]), block)


def _segment(headers: dict[str, str], block: bytes) -> dict:
    first = headers["warc-segment-number"] == "1"
    return {
        "origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "number": int(headers["warc-segment-number"]),
        "total": int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
        "headers": [(k, headers[k]) for k in ("warc-record-id", "warc-type", "warc-payload-digest")] if first else [], "block": block,
    }


def read(archives: DataFrame) -> DataFrame:
    """One row for each page in the archives, revisits resolved by the record that they refer to."""
    both = pa.schema([*_PAGE, *_SEGMENT])

    def inflate(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                yield _columns([_segment(h, b) if "warc-segment-number" in h else _described(h, b) for h, b in records(archive)], both)

    def join(batches):
        for batch in batches:
            yield _columns([reassembled(p) for p in batch.column(0).to_pylist()], _PAGE)

    made = base.materialise(base.arrow_map(archives.select("content"), inflate, f"{_PAGE_SQL}, {_SEGMENT_SQL}"), "records")
    grouped = made.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "headers", "block")).alias("parts"))
    joined = base.materialise(base.arrow_map(grouped.select("parts"), join, _PAGE_SQL), "joined")
    pages = made.where("origin IS NULL").select(*_PAGE.names).unionByName(joined)

    revisits = pages.where("record_type = 'revisit'")
    named = pages.where("record_type <> 'revisit'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes_"), F.col("payload_digest").alias("digest_"))
    named = named.join(revisits.groupBy("target").agg(F.count("*").alias("n")), "target")
    found = base.spread_join(revisits, named, "target", "record_id", made.count(), how="left")
    same = (F.col("digest_") == F.col("payload_digest")) & (F.col("bytes_") == F.col("payload_bytes"))
    checked = F.when(same, F.col("refers_to")).otherwise(F.raise_error(F.concat(F.lit("no response with this payload: "), F.coalesce("target", F.lit("")))).cast("long"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    return pages.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(found.select(*columns, checked.alias("refers_to")))
