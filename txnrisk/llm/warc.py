"""WARC archives written and read as Spark text, oversized payloads as chunk rows.

A payload longer than a chunk becomes a response record and continuation records (the standard's
segments), one row each: record identifier, segment number, and the SHA-1 of the payload so far.
Spark's text source writes and reads them, with its commits and on any file system it knows. The
separator of records never occurs inside a block, because payloads are cut there too.

A record is named by its page and payload digest, so reruns write the same names and a revisit names
the response that holds its payload, for any reader of the format.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.llm.common import in_batches, stored
from txnrisk.llm.words import raw
from txnrisk.session import scratch_path

CHUNK = 1 << 16
# Record line, line end and header names of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n"
NUMBER, ORIGIN, TOTAL = "WARC-Segment-Number", "WARC-Segment-Origin-ID", "WARC-Segment-Total-Length"
DIGEST, RUNNING, LENGTH, PAGE = "WARC-Payload-Digest", "X-Payload-Digest-So-Far", "X-Payload-Length", "X-Page-Id"
#: Without a date of capture in the table, all records carry this one, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"
_PLAIN = "".join(map(chr, range(33, 127)))
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(payload: memoryview, chunk: int) -> Iterator[tuple[int, int]]:
    """Chunks of whole characters, at most ``chunk`` bytes; no record line in or at the end of any."""
    line, at = VERSION.encode(), 0
    while at < len(payload):
        stop = min(at + max(chunk, 16), len(payload))
        while stop < len(payload) and payload[stop] & 0xC0 == 0x80:
            stop -= 1
        inner = bytes(payload[at:stop]).find(line)
        if inner >= 0:
            stop = at + inner + 4
        elif bytes(payload[max(at, stop - 8) : stop]) == line[:8]:  # the line end after a block would complete it
            stop -= 4
        yield at, stop
        at = stop


def record_name(page: int | None, digest: str) -> str:
    """Rows with equal page and payload share it: their records are equal too."""
    return f"urn:x-page:{'' if page is None else page}:{digest}"


def _record(headers: list[tuple[str, object]], block: bytes) -> str:
    lines = [f"{k}: {v}" for k, v in headers if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + END.join(lines) + END + END + block.decode() + END


def _written(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, urls, answers = (batch.column(k).to_pylist() for k in (0, 1, 3))
        data, at = raw(batch.column(2))
        held, rows = 0, []
        for i, (page, url, answer) in enumerate(zip(pages, urls, answers, strict=True)):
            payload = memoryview(data[at[i] : at[i + 1]])
            revisit = answer is not None and answer != page
            whole = base32(hashlib.sha1(payload).digest())
            name = f"<{record_name(page, whole)}>"
            common = [("WARC-Date", DATE), ("WARC-Target-URI", None if url is None else urllib.parse.quote(url, safe=_PLAIN).replace("WARC/", "WARC%2F"))]
            own = [(PAGE, page), (LENGTH, len(payload)), ("Content-Type", "text/html")]
            parts = [(0, 0)] if revisit else list(cuts(payload, chunk)) or [(0, 0)]
            if revisit or len(parts) == 1:
                own_name = f"<{record_name(page, whole)}:revisit>" if revisit else name
                kind = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own_name), *common]
                refers = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{record_name(answer, whole)}>")] if revisit else []
                rows.append(_record([*kind, *refers, (DIGEST, f"sha1:{whole}"), *own], b"" if revisit else bytes(payload)))
                held += len(rows[-1])
            else:
                running = hashlib.sha1()
                for k, (a, b) in enumerate(parts):
                    running.update(payload[a:b])
                    block = bytes(payload[a:b])
                    last = k == len(parts) - 1
                    kind = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"<{record_name(page, whole)}:{k + 1}>" if k else name), *common]
                    place = [(NUMBER, k + 1), (ORIGIN, name), (TOTAL, len(payload) if last else None), ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}")]
                    so_far = (DIGEST if last else RUNNING, f"sha1:{base32(running.digest())}")
                    rows.append(_record([*kind, *place, so_far, *own], block))
                    held += len(block)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                        held, rows = 0, []
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
                held, rows = 0, []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> None:
    """One record per row of ``pages`` as WARC text files below ``path``.

    Of equal payloads the one with the largest id is stored, the others are revisits that refer to
    it. A null payload is empty. Rows that share the largest id are all stored; null ids revisit
    a known one, and are stored if there is none. Other columns are ignored.
    """
    rows = in_batches(pages).select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # only payloads that occur more than once need their response named; Spark broadcasts them if they are few
    same = rows.groupBy("digest").agg(F.max("page_id").alias("answer"), F.count("*").alias("times")).where("times > 1").select("digest", "answer")
    same = stored(same, "payloads").withColumnRenamed("digest", "same_digest")
    rows = rows.join(same, F.col("digest") == F.col("same_digest"), "left")
    rows = rows.select("page_id", "url", "html", "answer")
    rows.mapInArrow(partial(_written, chunk=chunk), "value string").write.option("lineSep", END).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.schema("value string").option("lineSep", VERSION).text(path).where("value != ''")
    head = F.substring_index("value", END + END, 1)
    return text.withColumn("segment", head.contains(f"{NUMBER}: "))


def _parsed(value: str) -> tuple[dict[str, str], bytes]:
    head, _, rest = value.partition(END + END)
    headers = dict(line.split(": ", 1) for line in head.split(END) if ": " in line)
    block = rest.encode()
    size = int(headers["Content-Length"])
    if block[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(block)} bytes does not end at {size}")
    return headers, block[:size]


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for value in batch.column(0).to_pylist():
            headers, block = _parsed(value)
            digest = headers[DIGEST].removeprefix("sha1:")
            if headers["WARC-Type"] == "response" and base32(hashlib.sha1(block).digest()) != digest:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
            refers = headers.get("WARC-Refers-To")
            out.append((_number(headers.get(PAGE)), int(headers[LENGTH]), digest, headers["WARC-Type"], None if refers is None else int(refers.split(":")[2])))
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk rows: record, number, head, block."""
    for batch in batches:
        parsed = [_parsed(v) for v in batch.column(0).to_pylist()]
        for headers, block in parsed:
            if f"sha1:{base32(hashlib.sha1(block).digest())}" != headers["WARC-Block-Digest"]:
                raise ValueError(f"block of {headers['WARC-Record-ID']} does not match its digest")
        columns = [
            pa.array([h[ORIGIN] for h, _ in parsed], pa.string()),
            pa.array([int(h[NUMBER]) for h, _ in parsed], pa.int64()),
            pa.array([_number(h.get(PAGE)) for h, _ in parsed], pa.int64()),
            pa.array([_number(h.get(TOTAL)) for h, _ in parsed], pa.int64()),
            pa.array([h.get(DIGEST, h.get(RUNNING)).removeprefix("sha1:") for h, _ in parsed], pa.string()),
            pa.array([b for _, b in parsed], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["record", "chunk_no", "page_id", "total", "so_far", "chunk"])


CHUNKS = "record string, chunk_no long, page_id long, total long, so_far string, chunk binary"


def chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of oversized payloads: record, chunk_no (from 1), page_id, total bytes on
    the last chunk, digest of the payload so far, chunk."""
    return _lines(spark, path).where("segment").select("value").mapInArrow(_split, CHUNKS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of sorted chunk rows: a running SHA-1 and a byte count are all that is held.

    Equal records share a name, so each of their chunks comes as often as there are records.
    """
    record, running, size, number, times, first = None, None, 0, 0, 0, 0
    ended: tuple | None = None

    def done() -> list[tuple]:
        """The records whose last chunk has been read."""
        if record is None:
            return []
        if ended is None or times != first:
            raise ValueError(f"{record} ends early or lacks a chunk")
        return [ended] * times

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["record"] != record:
                out += done()
                record, running, size, number, times, first, ended = row["record"], hashlib.sha1(), 0, 0, 0, 0, None
            if row["chunk_no"] == number and row["so_far"] == base32(running.digest()):
                times += 1
                continue
            if number and times != (first := first or times):
                raise ValueError(f"a chunk {number} of {record} is missing")
            running.update(row["chunk"])
            size, number, times = size + len(row["chunk"]), number + 1, 1
            if row["chunk_no"] != number or row["so_far"] != base32(running.digest()):
                raise ValueError(f"chunk {row['chunk_no']} of {record} is missing or wrong")
            if row["total"] is not None:
                if size != row["total"]:
                    raise ValueError(f"{record} has {size} of {row['total']} bytes")
                first = first or times
                ended = (row["page_id"], size, base32(running.digest()), "response", None)
        yield _batch(out)
    yield _batch(done())


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records, all digests checked."""
    whole = _lines(spark, path).where("not segment").select("value").mapInArrow(_single, RECORD)
    chunks = chunk_rows(spark, path).repartition("record").sortWithinPartitions("record", "chunk_no")
    return whole.union(chunks.mapInArrow(_joined, RECORD))


def round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` to the shared folder and read the archive back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, chunk=chunk)
    return read_archive(pages.sparkSession, path)


