"""WARC archives: pages are written as records, segmented and in chunked transfer framing, and read back by reassembly."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir

# ---- the format (fixed values)

MARK = b"WARC/1."
#: What stands between the pieces that are read: nothing of it can begin anew within it, so that readers which look for it
#: across their buffers find it wherever it stands. The empty lines before it would not do.
BETWEEN = b"\n" + MARK
CRLF = b"\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

#: Blocks over so many bytes are written in segments, payloads over so many bytes in chunks.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: Rows that a task works on at a time.
STEP = 256
#: Payloads under so many bytes are never a revisit.
LEAST_REVISIT = 100


def _header(name: str, value) -> bytes:
    """A header line; what would break it is percent-encoded."""
    text = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {text}\r\n".encode()


def _record(kind: str, record_id: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    own = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    return MARK + b"1\r\n" + b"".join(_header(k, v) for k, v in own if v is not None) + CRLF + block


def chunked(payload: bytes, size: int) -> bytes:
    """payload in chunked transfer framing. What starts a record is cut wherever it stands in the payload, so that an archive
    has it at the start of records only."""
    cuts = {*range(0, len(payload), size), *(m.start() + 2 for m in re.finditer(re.escape(MARK), payload)), len(payload)}
    at = sorted(cuts)
    return b"".join(b"%x\r\n%b\r\n" % (e - s, payload[s:e]) for s, e in zip(at, at[1:])) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked transfer framing (extensions and trailers are passed over), or None if the framing is
    broken or not ended."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        size = body[at:end].split(b";", 1)[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != CRLF:
            return None
        out.append(body[at : at + n])
        at += n + 2


def page_records(page_id, url, payload: bytes, digest: str, first, first_url, record_id: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of a page: a response, in segments if it is long, or a revisit of the page first."""
    link = [("WARC-Target-URI", url), ("Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if first is not None:
        link += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", first_url), ("WARC-Refers-To-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
        return [_record("revisit", record_id, link, http + CRLF)]
    if len(payload) > chunk_bytes or MARK in payload:
        block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    else:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    link.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        return [_record("response", record_id, link, block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", record_id, [*link, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        headers = [("WARC-Target-URI", url), ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
        out.append(_record("continuation", f"{record_id}-{n}", headers, part))
    return out


def _write(run: str, segment_bytes: int, chunk_bytes: int):
    def records(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                n += 1
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{run}/{part}/{n}").urn
                out += page_records(*row, record_id, segment_bytes, chunk_bytes)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    return records


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a WARC record for each row of pages to gzip files in the folder path, a file for each task.

    The payload is the body in UTF-8 (null: empty). Of rows with equal payloads of LEAST_REVISIT bytes at least, those with
    the smallest id are responses, the others revisits of it; a row without an id is a revisit where a row with the same
    payload has one. Payloads over chunk_bytes go in chunks, responses over segment_bytes in segments: continuation
    records name the first one's record id and their number, the last one the whole length. Equal payloads meet by
    SHA-256: groups of them are one row each, and the join splits where they are hot.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    known = rows.where(F.length("payload") >= LEAST_REVISIT).groupBy("digest")
    known = known.agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1 and first is not null")
    known = saved(known.drop("n"), "warc-copies")  # as a table, so that the join sees two plain exchanges and can split the hot ones
    rows = rows.join(known, "digest", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    rows = rows.select("page_id", "url", "payload", "digest", *[F.when(F.col("again"), F.col(c)).alias(c) for c in ("first", "first_url")])
    records = rows.mapInArrow(_write(uuid.uuid4().hex, segment_bytes, chunk_bytes), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


# ---- reading

PARSED = "record_id string, record_type string, target_uri string, page_id string, payload_digest string, refers_to_uri string, refers_to_date string, origin_id string, segment int, total_length long, headers map<string,string>, block binary, problem string"
_NAMES = ("warc-record-id", "warc-type", "warc-target-uri", "page-id", "warc-payload-digest", "warc-refers-to-target-uri", "warc-refers-to-date", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length")
_NUMBER = re.compile(r"\d{1,18}")


def _headers(lines: bytes) -> dict[str, str]:
    """Header lines by lower-cased name; folded lines are one, the first of repeated names counts."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", lines).split(CRLF):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def parsed_record(raw: bytes) -> tuple:
    """A record as PARSED from the bytes between two version lines."""
    head, gap, rest = raw.partition(END)
    headers = _headers(head)
    link, problem = {k: headers.get(k) for k in _NAMES}, None
    length = headers.get("content-length", "")
    if not gap or not link["warc-type"] or not _NUMBER.fullmatch(length):
        problem = "no header"
    elif len(rest) < int(length):
        problem = "cut off"
    block = rest[: int(length)] if problem != "no header" else b""
    digest = headers.get("warc-block-digest", "")
    if problem is None and digest.lower().startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:].lower():
        problem = "block digest differs"
    ids = [link[k].strip("<>") if link[k] else None for k in ("warc-record-id", "warc-segment-origin-id")]
    number, total = (int(link[k]) if link[k] and _NUMBER.fullmatch(link[k]) else None for k in ("warc-segment-number", "warc-segment-total-length"))
    digest = link["warc-payload-digest"]
    digest = digest[7:].lower() if digest and digest.lower().startswith("sha256:") else None
    return ids[0], link["warc-type"], link["warc-target-uri"], link["page-id"], digest, link["warc-refers-to-target-uri"], link["warc-refers-to-date"], ids[1], number, total, list(headers.items()), block, problem


def _arrow(fields: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(fields))


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.record_batch([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(schema)], schema=schema)


def _parse(schema):
    """Records from the pieces between their first words, in the order of a file. A piece whose block is shorter than its
    header says had those words within: it goes on with the next piece."""

    def records(batches):
        file, raw, out, size = None, b"", [], 0
        for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            for at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if raw:
                    row = parsed_record(raw)
                    if row[-1] == "cut off" and at == file:
                        raw += BETWEEN + piece
                        continue
                    out.append(row)
                    size += len(raw)
                file, raw = at, piece.removeprefix(MARK)
            if size > 1 << 22:
                yield _batch(out, schema)
                out, size = [], 0
        if raw:
            out.append(parsed_record(raw))
        yield _batch(out, schema)

    return records


def archive_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in the folder path as they stand there, one row each (PARSED), plain or gzip.

    Files are read as pieces between the words that start a record, so that plain files split; headers, length and block
    digest are checked, and a record that fails has a problem (no header; cut off; block digest differs) and is kept. In
    a plain file that is split within a block just where that block holds those words, its record is a problem, too.
    """
    text = spark.read.option("lineSep", BETWEEN.decode()).text(path)
    return text.select(F.col("_metadata.file_path"), F.col("value").cast("binary")).mapInArrow(_parse(_arrow(PARSED)), PARSED)


WHOLE = "record_id string, record_type string, target_uri string, page_id string, payload_digest string, refers_to_uri string, refers_to_date string, status int, payload binary, payload_bytes long, problem string"


def whole_payload(record_type: str, digest: str | None, segments: list[tuple[int, int | None, bytes]], problem: str | None) -> tuple[int | None, bytes | None, str | None]:
    """HTTP status, payload and problem of a record from its segments (number, total length, block)."""
    numbers = [n for n, _, _ in segments]
    block = b"".join(b for _, _, b in segments)
    total = next((t for _, t, _ in reversed(segments) if t is not None), None)
    if problem is None and numbers != list(range(1, len(numbers) + 1)):
        problem = "a segment is missing or there twice"
    elif problem is None and total is not None and total != len(block):
        problem = "total length differs"
    if record_type not in ("response", "request", "revisit"):
        return None, block, problem
    head, gap, body = block.partition(END)
    start = re.match(rb"HTTP/\d(?:\.\d)? (\d{3})", head)
    if not gap:
        return None, None, problem or "no HTTP header"
    if record_type != "revisit":
        if _headers(head).get("transfer-encoding", "").lower().endswith("chunked"):
            body = unchunked(body)
        if body is None:
            problem = problem or "broken chunks"
        elif digest and hashlib.sha256(body).hexdigest() != digest:
            problem = problem or "payload digest differs"
    return int(start[1]) if start else None, body, problem


def _decode(schema):
    def payloads(batches):
        for b in (whole.slice(at, STEP) for whole in batches for at in range(0, whole.num_rows, STEP)):
            done = []
            for *link, segments, problem in zip(*(c.to_pylist() for c in b.columns)):
                pieces = [(s["segment"], s["total_length"], s["block"]) for s in segments]
                status, payload, problem = whole_payload(link[1], link[4], pieces, problem)
                done.append((*link, status, payload, None if payload is None else len(payload), problem))
            yield _batch(done, schema)

    return payloads


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The logical records of all WARC files in the folder path (WHOLE): segments are put together, chunked transfer framing
    is decoded, lengths and digests are checked.

    Records that are whole go straight to decoding, segments through a shuffle: archives are read once for each. Segments meet by the record id of the first of them, in order of their
    numbers; a group is one record, and its bytes are one payload. A record of which a segment is missing, there twice or
    damaged, or whose total length, framing or digest is wrong, is kept with its problem; its payload is what there
    is, or null if the framing is broken. The payload of a revisit is empty: see with_originals.
    """
    records = archive_records(spark, path)
    link = ["record_id", "record_type", "target_uri", "page_id", "payload_digest", "refers_to_uri", "refers_to_date"]
    piece = F.struct(F.coalesce("segment", F.lit(1)).alias("segment"), "total_length", "block")
    single = records.where("segment is null").select(*link, F.array(piece).alias("segments"), "problem")
    parts = records.where("segment is not null").withColumn("origin", F.coalesce("origin_id", "record_id"))
    first = [F.max(F.when(F.col("origin_id").isNull(), F.col(c))).alias(c) for c in link if c != "record_id"]
    wrong = F.coalesce(F.max("problem"), F.when(F.max("total_length").isNull(), F.lit("the last segment is missing")))
    joined = parts.groupBy("origin").agg(*first, F.sort_array(F.collect_list(piece)).alias("segments"), wrong.alias("problem"))
    joined = joined.select(F.col("origin").alias("record_id"), F.coalesce("record_type", F.lit("continuation")).alias("record_type"), *link[2:], "segments", "problem")
    return single.unionByName(joined).mapInArrow(_decode(_arrow(WHOLE)), WHOLE)


def with_originals(records: DataFrame) -> DataFrame:
    """records (record_type, page_id, payload_digest, payload_bytes, problem and any others) with original_page_id and
    original_bytes: of the response with the same payload digest and the smallest page id, for revisits; null for others.
    A revisit without such a response has the problem that it is missing."""
    known = records.where("record_type = 'response' and problem is null and payload_digest is not null").groupBy("payload_digest")
    known = known.agg(F.min(F.col("page_id").cast("long")).alias("original_page_id"), F.max("payload_bytes").alias("original_bytes"), F.lit("revisit").alias("record_type"))
    known = saved(known, "warc-originals")  # a row for each payload; where its revisits are hot, the join splits them
    out = records.join(known, ["payload_digest", "record_type"], "left")
    lost = (F.col("record_type") == "revisit") & F.col("original_bytes").isNull()
    return out.withColumn("problem", F.coalesce("problem", F.when(lost, F.lit("the original is missing"))))


def op11_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    # digests and lengths of what was read back; a revisit has its own digest from its header, and its length from the original
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest"))
    slim = read_warc(spark, path).select("record_type", "page_id", digest.alias("payload_digest"), "payload_bytes", "problem")
    found = with_originals(saved(slim, "warc-read"))
    size = F.when(F.col("record_type") == "revisit", F.col("original_bytes")).otherwise(F.col("payload_bytes"))
    return found.select(F.col("page_id").cast("long").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", F.col("original_page_id").alias("refers_to"))


QUERIES = {"op11_warc": op11_warc}
ORACLES = {
    "op11_warc": """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by html) end as first from p)
select page_id, n::bigint as payload_bytes, sha256(html) as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f"""
}
