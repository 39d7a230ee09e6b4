"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Files hold a gzip member for each record. Spark's text sink writes them, a file a row, so that they are committed whole on
any store: the last byte of a file, which is zero by construction, is the sink's line separator. Payloads are compressed
where they are read, and copies that cannot be the one to stay lose theirs at once; what is shuffled is compressed.

The reader checks every record: gzip checksum, version line, header, length, trailer, digests. Where a check fails it
looks for the next place at which a whole member or record passes them all, goes on from there, and reports the bytes
between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes after which a file ends, unless one record has more.
FILE_BYTES = 8 << 20
#: Bytes that are inflated at once.
CHUNK = 64 << 10
#: Texts of a task that it remembers, to tell copies that will not stay.
KNOWN = 100_000

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/(\d\.\d)\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALGORITHMS = ("sha1", "sha256", "md5")

START = re.compile(re.escape(MAGIC) + rb"|WARC/\d\.\d\r\n")


# --- records ---------------------------------------------------------------------------------------------------------


def member(content: bytes, level: int = 3) -> bytes:
    """A gzip member."""
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(content) + press.flush()


def sha1_text(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{sha1_text(block)}"), ("Content-Length", str(len(block)))]
    return b"".join([b"WARC/1.1\r\n", *[f"{k}: {v}\r\n".encode() for k, v in fields], b"\r\n", block, b"\r\n\r\n"])


def record_id(page: int | None, uid: int) -> str:
    return f"<urn:page:{'-' if page is None else page}:{uid}>"


def _page_record(page: int | None, uid: int, url: str | None, date: str, digest: str, n_bytes: int, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit, whose block is the response's header alone."""
    uri = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else record_id(page, uid)[1:-1]
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page, uid)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes + payload
    return record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


# --- writing ---------------------------------------------------------------------------------------------------------

ROWS = "uid long, id long, url string, key binary, digest string, n_bytes long, member binary"
ROW_NAMES = ["uid", "id", "url", "key", "digest", "n_bytes", "member"]


def _rank(page: int | None, uid: int) -> tuple:
    return page is not None, page or 0, uid


def write_warc(pages: DataFrame, where: str, id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3) -> None:
    """Writes a record for each row, in files of about FILE_BYTES under the folder `where`, each with a warcinfo record.

    Of rows with equal payloads (by SHA-256 and length) of `min_bytes` or more the one with the largest id is a response, the
    others are revisits that refer to it; shorter ones are all responses. A null payload is an empty one; a null id ranks
    below all others; of rows that repeat id and payload one is the response. A null or empty url becomes the record's own
    name; characters that a header cannot hold are percent-encoded. An empty table gives files without records. Very long
    payloads make files of their own. Other columns of pages, under any names, are not read.
    """
    spark = pages.sparkSession
    C.small_batches(spark)
    own = pages.select(pages[id].cast("long").alias("id"), pages[url].cast("string").alias("url"), pages[payload].alias("text"))

    def press(batches):
        uids, seen = itertools.count(C.task_key() << 32), {}
        for piece in C.pieces(batches):
            texts = C.raw(piece)
            rows = []
            for page, link, text in zip(piece.column("id").to_pylist(), piece.column("url").to_pylist(), texts, strict=True):
                key = hashlib.sha256(text).digest() + len(text).to_bytes(8, "big")
                rows.append([next(uids), page, link, key, None, len(text), None])
                if len(text) >= min_bytes:
                    rank = _rank(page, rows[-1][0])
                    seen[key] = max(rank, seen.get(key, rank))
            digests: dict[bytes, str] = {}
            for r, text in zip(rows, texts, strict=True):
                if r[3] not in digests:
                    digests[r[3]] = sha1_text(text)
                r[4] = digests[r[3]]
                if r[5] < min_bytes or seen[r[3]] == _rank(r[1], r[0]):
                    r[6] = member(_page_record(r[1], r[0], r[2], date, r[4], r[5], text, None), level)
            if len(seen) > KNOWN:
                seen = {}
            yield C.batch_of(ROW_NAMES, [list(x) for x in zip(*rows, strict=True)], [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()])

    rows = C.materialise(own.mapInArrow(C.tidied(press), ROWS), "records")
    # A group's largest row is a partial maximum; then only groups of several rows meet theirs again.
    rank = F.struct(F.col("id").isNotNull().alias("has"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    heads = rows.where(F.col("n_bytes") >= min_bytes).groupBy("key").agg(F.max(rank).alias("top"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select("key", F.col("top.id").alias("top_id"), F.col("top.uid").alias("top_uid"))
    met = rows.join(heads, "key", "left").select("uid", "id", "url", "digest", "n_bytes", F.when(F.coalesce("top_uid", "uid") == F.col("uid"), F.col("member")).alias("member"), "top_id", "top_uid")

    def bind(batches):
        info = member(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, date)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: loomspark\r\nformat: WARC File Format 1.1\r\n"), level)
        held, size = [info], 0

        def file():
            whole = b"".join(held)
            if whole[-1]:  # the last record has 16 MB or more: an empty member ends the file with a zero
                whole += member(b"")
            return C.batch_of(["value"], [[whole[:-1]]], [pa.binary()])

        for batch in batches:
            for uid, page, link, digest, n_bytes, packed, top_id, top_uid in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed is None:
                    packed = member(_page_record(page, uid, link, date, digest, n_bytes, b"", record_id(top_id, top_uid)), level)
                if size and size + len(packed) > FILE_BYTES:
                    yield file()
                    held, size = [info], 0
                held.append(packed)
                size += len(packed)
        if size:
            yield file()

    files = met.mapInArrow(C.tidied(bind), "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(where)
    C.discard(rows)


# --- reading ---------------------------------------------------------------------------------------------------------


def _digest_fits(stated: str, content: bytes) -> bool:
    """Whether content has the stated digest; digests of unknown algorithms count as right."""
    name, _, value = stated.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ALGORITHMS:
        return True
    found = hashlib.new(name, content).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


class Broken(Exception):
    pass


def parse(d: bytes, at: int) -> tuple[dict, int]:
    """The record at a place, as a dict, and its end; Broken with the name of the check that fails."""
    version = VERSION.match(d, at)
    if not version:
        raise Broken("no version line")
    stop = d.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Broken("header has no end")
    fields: dict[str, str] = {}
    last = None
    for line in d[version.end() : stop].decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:  # a folded line
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Broken("header line")
        last = name.strip().lower()
        fields[last] = value.strip()
    if "warc-type" not in fields or "warc-record-id" not in fields:
        raise Broken("header lacks type or id")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Broken("length")
    begin = stop + 4
    end = begin + int(fields["content-length"])
    if end + 4 > len(d):
        raise Broken("length beyond the end")
    if d[end : end + 4] != b"\r\n\r\n":
        raise Broken("trailer")
    block, kind = d[begin:end], fields["warc-type"].lower()
    if not _digest_fits(fields.get("warc-block-digest", ""), block):
        raise Broken("block digest")
    head, payload, size = b"", block, None
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        head, payload = (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")
    stated = fields.get("warc-payload-digest", "")
    if kind == "revisit":
        found = re.search(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r?$", head)
        size, digest = int(found[1]) if found else None, stated.partition(":")[2].strip().upper() if stated.lower().startswith("sha1:") else None
        payload = b""
    else:
        if "warc-truncated" not in fields and "warc-segment-number" not in fields and not _digest_fits(stated, payload):
            raise Broken("payload digest")
        size, digest = len(payload), sha1_text(payload)
    sure = any(fields.get(f"warc-{x}-digest", "").partition(":")[0].lower().replace("-", "") in ALGORITHMS for x in ("block", "payload")[: 1 if kind == "revisit" else 2])
    return {"version": version[1].decode(), "type": kind, "record_id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload, "sure": sure}, end + 4


def records_in(d: bytes) -> Iterator[tuple]:
    """(start, end, record or None, failed check or None) of uncompressed content, without a byte left out."""
    at = 0
    while at < len(d):
        try:
            found, end = parse(d, at)
        except Broken as broken:
            end = len(d)
            for start in VERSION.finditer(d, at + 1):
                try:
                    parse(d, start.start())
                except Broken:
                    continue
                end = start.start()
                break
            yield at, end, None, str(broken)
        else:
            yield at, end, found, None
        at = end


def inflate(d: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content of the member at a place, its end, and what failed. Where it is cut off, content is what there is; of a damaged
    one it is nothing, since no checksum says which part is right."""
    press, out, place, view = zlib.decompressobj(31), [], at, memoryview(d)
    try:
        while not press.eof and place < len(d):
            out.append(press.decompress(view[place : place + CHUNK]))
            place = min(len(d), place + CHUNK)
    except zlib.error as e:
        return b"", place, "gzip: " + re.sub(r".*: ", "", str(e))
    if not press.eof:
        return b"".join(out), place, "gzip: cut off"
    return b"".join(out), place - len(press.unused_data), None


def _starts_here(d: bytes, at: int) -> bool:
    """Whether a whole member that begins with a record that passes, or such a record, is at a place."""
    content = d
    if d.startswith(MAGIC, at):
        content, _, wrong = inflate(d, at)
        if wrong:
            return False
        at = 0
    try:
        parse(content, at)
    except Broken:
        return False
    return True


def salvage(d: bytes) -> Iterator[tuple]:
    """(start, end, place within the member or None, record or None, failed check or None) of a file's content.

    start and end are places in the file; together the entries leave out no byte but those of empty members. Of a member
    that is cut off, the records before the cut that have a digest of their own are given too. Content of a damaged
    record that is itself a whole record which passes all checks is taken for one.
    """
    at = 0
    while at < len(d):
        if d.startswith(MAGIC, at):
            content, end, wrong = inflate(d, at)
            for a, _, found, broken in records_in(content):
                if not wrong:
                    yield at, end, a, found, broken
                elif found and found["sure"]:
                    yield at, at, a, found, None
        else:
            try:
                found, end = parse(d, at)
                yield at, end, None, found, None
                wrong = None
            except Broken as broken:
                wrong = str(broken)
        if wrong:
            end = next((m.start() for m in START.finditer(d, at + 1) if _starts_here(d, m.start())), len(d))
            yield at, end, None, None, wrong
        at = end


ENTRIES = {"path": "string", "start": "long", "end": "long", "inner": "long", "kind": "string", "reason": "string", "version": "string", "type": "string", "record_id": "string", "uri": "string", "date": "string", "refers_to": "string", "payload_digest": "string", "payload_bytes": "long", "payload": "binary"}
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def read_warc(spark: SparkSession, where: str, payload: bool = True) -> DataFrame:
    """A row for each record (kind 'record') and each quarantined gap (kind 'gap') of the files under `where`.

    path, start, end: the bytes of the file that the record's member, the record or the gap takes (a record saved from a
    member that is cut off: end = start); inner: the place within the member's content; reason: the check that failed. Then
    the record's fields, with payload_digest as bare base32 SHA-1 and payload_bytes; for a revisit both are those it states,
    and payload is empty. Without `payload` that column is null. Files may be compressed or not, or both in turn; empty ones
    give no row. A file is read whole by one task, so keep external archives within an executor's memory.
    """
    C.small_batches(spark)
    files = spark.read.format("binaryFile").load(where).select("path", "content")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, held, size = batch.column("path")[k].as_py(), [], 0
                for start, end, inner, found, reason in salvage(batch.column("content")[k].as_py()):
                    row = {"path": path, "start": start, "end": end, "inner": inner, "kind": "record" if found else "gap", "reason": reason, **(found or {})}
                    if not payload:
                        row["payload"] = None
                    held.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size >= C.BATCH_BYTES:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)

    return files.mapInArrow(C.tidied(run), ", ".join(f"{k} {v}" for k, v in ENTRIES.items()))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return C.batch_of(list(ENTRIES), [[r.get(k) for r in rows] for k in ENTRIES], [_ARROW[v] for v in ENTRIES.values()])


def archived(pages: DataFrame, where: str | None = None, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives that it writes first.

    Nulls, ties, repeated rows, long and empty payloads and empty tables: see write_warc. Without `where` the files go with
    the session.
    """
    spark = pages.sparkSession
    if not where:
        where = f"{C.shared_dir(spark)}/loomspark/warc-{uuid.uuid4().hex}"
        C.delete_on_exit(spark, where)
    write_warc(pages, where, min_bytes=min_bytes)
    page = lambda x: F.nullif(F.regexp_extract(x, r"^<urn:page:(-?\d*):\d+>$", 1), F.lit("-"))
    found = read_warc(spark, where, payload=False).where("kind = 'record' and type in ('response', 'revisit')")
    return found.select(page("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page("refers_to").try_cast("long").alias("refers_to"))
