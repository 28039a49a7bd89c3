"""WARC: converts legacy ARC files (versions 1 and 2), synthesising identifiers, timestamps, types and digests."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, scratch_path, write_table
from .files import open_file, small_batches, whole, write_file

#: An ARC file is closed at so many records or payload bytes.
FILE_RECORDS, FILE_BYTES = 2000, 32 << 20
#: Payloads from this size on may become revisits.
LEAST_REVISIT = 1000
ARC_DATE = "20200101000000"
ID_HEADER = "X-Page-Id"
#: The fields of a header line by the version in an ARC file's first record.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_BLANK = re.compile(rb"\r?\n\r?\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _clean_url(url: str | None) -> str:
    """A header line is parted by spaces: white space and control characters are percent-encoded; none: about:blank."""
    return re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "about:blank"


def _line(version: int, values: dict[str, object]) -> bytes:
    return (" ".join(str(values.get(f, "-")) for f in FIELDS[version]) + "\n").encode()


def arc_bytes(name: str, version: int, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, content type, body), a gzip member for each record."""
    about = f"{version} 0 verbena\n{' '.join(FIELDS[version])}\n\n".encode()
    out = [gzip.compress(_line(version, {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": ARC_DATE, "Content-type": "text/plain", "Result-code": 200, "Filename": name, "Offset": 0, "Archive-length": len(about)}) + about + b"\n", 1, mtime=0)]
    at = len(out[0])
    for url, date, kind, body in records:
        head = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Result-code": 200, "Checksum": f"{zlib.crc32(body):08x}", "Filename": name, "Offset": at, "Archive-length": len(body)}
        out.append(gzip.compress(_line(version, head) + body + b"\n", 1, mtime=0))
        at += len(out[-1])
    return b"".join(out)


def _stream(source: bytes | BinaryIO) -> BinaryIO:
    """What an archive holds, read bit by bit: gzip members one after the other, or the plain file."""
    raw = io.BytesIO(source) if isinstance(source, bytes) else source
    start = raw.read(2)
    raw.seek(0)
    return gzip.GzipFile(fileobj=raw) if start == b"\x1f\x8b" else io.BufferedReader(raw)


def _exactly(f: BinaryIO, length: int) -> bytes:
    got = f.read(length)
    if len(got) < length:
        raise ValueError(f"a record is shorter than its declared {length} bytes")
    return got


def parse_arc(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, body) of every record after the first, in time linear in the archive and memory for one record.

    The first record says the version; a header line is split from its right end, as a URL may hold spaces; the body is as
    long as declared, whatever it holds.
    """
    f, version = _stream(source), None
    while line := f.readline():
        if line in (b"\n", b"\r\n"):
            continue
        line = line.decode("utf-8", "replace").rstrip("\r\n")
        body = _exactly(f, int(line.rsplit(" ", 1)[1]))
        if version is None:
            if not line.startswith("filedesc://"):
                raise ValueError("an ARC file begins with a filedesc record")
            version = int(body.split(b" ", 1)[0])
            continue
        names = FIELDS[version]
        yield dict(zip(names, line.rsplit(" ", len(names) - 1), strict=True)), body


def record_id(file: str, idx: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{idx}')}>"


def warc_date(arc: str) -> str:
    """14 digits, or fewer: missing parts are their first value; anything else is the epoch."""
    d = arc if re.fullmatch(r"\d{4}(\d\d){0,5}", arc) else "1970"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_type(url: str, body: bytes) -> str:
    return "response" if url.startswith(("http://", "https://")) and body.startswith(b"HTTP/") else "resource"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def _split_http(body: bytes) -> tuple[bytes, bytes]:
    """(head with the blank line that ends it, payload)"""
    end = _BLANK.search(body)
    return (body[: end.end()], body[end.end() :]) if end else (body, b"")


def records(arc_name: str, arc: bytes | BinaryIO, revisits: dict[int, tuple[str, int, int | None]]) -> Iterator[bytes]:
    """The equivalent WARC file, record by record; revisits: record number -> (file, number, page id) of the record with the same payload."""
    yield _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(arc_name, -1)), ("WARC-Date", warc_date(ARC_DATE)), ("WARC-Filename", warc_name(arc_name)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
    for idx, (f, body) in enumerate(parse_arc(arc)):
        url, kind = f["URL"], warc_type(f["URL"], body)
        head, payload = _split_http(body) if kind == "response" else (b"", body)
        h = [("WARC-Type", kind), ("WARC-Record-ID", record_id(arc_name, idx)), ("WARC-Date", warc_date(f["Archive-date"])), ("WARC-Target-URI", url), ("WARC-IP-Address", f["IP-address"]), ("WARC-Payload-Digest", _digest(payload)), ("WARC-X-Payload-Length", str(len(payload)))]
        if idx in revisits:
            file, number, page = revisits[idx]
            h[0] = ("WARC-Type", "revisit")
            h += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(file, number))]
            h += [("WARC-X-Refers-To-Page-Id", str(page))] if page is not None else []
            body = head
        h += [("WARC-Block-Digest", _digest(body)), ("Content-Type", "application/http; msgtype=response" if kind == "response" else f["Content-type"])]
        yield _record(h, body)


def convert(arc_name: str, arc: bytes | BinaryIO, revisits: dict[int, tuple[str, int, int | None]]) -> bytes:
    return b"".join(records(arc_name, arc, revisits))


def warc_name(arc_name: str) -> str:
    return re.sub(r"\.arc(\.gz)?$", "", arc_name) + ".warc.gz"


def parse_warc(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    f = _stream(source)
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        h = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").rstrip("\r\n").partition(": ")
            h[k] = v
        block = _exactly(f, int(h["Content-Length"]))
        _exactly(f, 4)
        yield h, block


def _to_arc(out: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, attempt, seq, held, rows, size = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, [], [], 0

        def close() -> pd.DataFrame:
            nonlocal seq, held, rows, size
            version = 1 + (task + seq) % 2  # both versions occur
            name = f"part-{task:06d}-{seq:06d}-{attempt}.arc.gz"
            write_file(f"{out}/{name}", arc_bytes(name, version, held))
            got = pd.DataFrame([r[1:] for r in rows], columns=["idx", "n_bytes", "digest"])
            got["page_id"], got["file"] = whole([r[0] for r in rows]), name
            got = got[["page_id", "idx", "n_bytes", "digest", "file"]]
            seq, held, rows, size = seq + 1, [], [], 0
            return got

        for b in batches:
            for page, url, html in zip(b["page_id"].tolist(), b["url"].tolist(), b["html"].tolist(), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                page = None if page is None or page != page else int(page)
                own = f"{ID_HEADER}: {page}\r\n" if page is not None else ""
                head = f"HTTP/1.1 200 OK\r\n{own}Content-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                clean = _clean_url(url)
                clean = clean if clean.startswith(("http://", "https://")) else "http://unknown.invalid/" + clean
                rows.append((page, len(held), len(payload), hashlib.sha1(payload).digest()))
                held.append((clean, ARC_DATE, "text/html", head + payload))
                size += len(payload)
                if len(held) >= FILE_RECORDS or size >= FILE_BYTES:
                    yield close()
        if held:
            yield close()

    return run


def _to_warc(arcs: str, out: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            for name, revisits in zip(b["file"], b["revisits"], strict=True):
                known = {r["idx"]: (r["best_file"], r["best_idx"], r["best_page"]) for r in (revisits if revisits is not None else [])}
                made = f"{attempt}-{warc_name(name)}"
                with open_file(f"{arcs}/{name}") as f:
                    write_file(f"{out}/{made}", records(name, f, known))
                yield pd.DataFrame({"file": [made]})

    return run


def _page_of(head: bytes) -> int | None:
    page = re.search(rf"^{ID_HEADER}: (-?\d+)\r?$", head.decode("latin-1"), re.MULTILINE)
    return int(page[1]) if page else None


def _listed(arcs: str):
    """Manifest rows of archives that come without one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["file"]:
                rows = []
                with open_file(f"{arcs}/{name}") as f:
                    for idx, (head, body) in enumerate(parse_arc(f)):
                        http, payload = _split_http(body) if warc_type(head["URL"], body) == "response" else (b"", body)
                        rows.append((_page_of(http), idx, len(payload), hashlib.sha1(payload).digest(), name))
                out = pd.DataFrame(rows, columns=["page_id", "idx", "n_bytes", "digest", "file"])
                out["page_id"] = whole(out["page_id"].tolist())
                yield out

    return run


def _from_warc(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name in b["file"]:
                rows = []
                f = open_file(f"{path}/{name}")
                for h, block in parse_warc(f):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    if _digest(block) != h["WARC-Block-Digest"]:
                        raise ValueError("a WARC record's block doesn't have its digest")
                    head, payload = _split_http(block) if h["Content-Type"].startswith("application/http") else (b"", block)
                    full = h["WARC-Type"] != "revisit"
                    if full and _digest(payload) != h["WARC-Payload-Digest"]:
                        raise ValueError("a WARC record's payload doesn't have its digest")
                    refers = h.get("WARC-X-Refers-To-Page-Id")
                    rows.append((_page_of(head), len(payload) if full else int(h["WARC-X-Payload-Length"]), base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex(), h["WARC-Type"], int(refers) if refers else None, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Date"]))
                f.close()
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "date")
                yield pd.DataFrame({c: whole(v) if c in ("page_id", "refers_to") else v for c, v in ((c, [r[i] for r in rows]) for i, c in enumerate(names))})

    return run


def pages_to_arc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes pages as ARC files where they are read; returns the manifest (page_id, file, idx, n_bytes, digest)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").cast("string").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return write_table(rows.mapInPandas(_to_arc(out), "page_id long, idx long, n_bytes long, digest binary, file string"), "arcs")


def arc_manifest(spark: SparkSession, arcs: str) -> DataFrame:
    """The manifest of a folder of ARC files (*.arc, *.arc.gz) of any origin; page_id from the page header, if a record has it."""
    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.arc{,.gz}").load(arcs).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return write_table(files.mapInPandas(_listed(arcs), "page_id long, idx long, n_bytes long, digest binary, file string"), "arcs")


def arc_to_warc(manifest: DataFrame, arcs: str, out: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Converts the manifest's ARC files; returns the WARC files' names.

    Of records with equal payloads of at least least bytes the one with the largest page id (null ids come last; then by file and
    place) stays a response and the others become revisits. Only digests and places shuffle, not payloads.
    """
    total = manifest.count()
    best = F.max(F.struct(F.col("page_id").isNotNull().alias("has"), F.col("page_id").alias("page"), F.col("file").alias("file"), F.col("idx").alias("idx"))).alias("best")
    large = manifest.filter(F.col("n_bytes") >= least)
    groups = large.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = join_groups(large, groups, "digest").filter("best is not null and not (best.file = file and best.idx = idx)")
    revisits = met.groupBy("file").agg(F.collect_list(F.struct("idx", F.col("best.file").alias("best_file"), F.col("best.idx").alias("best_idx"), F.col("best.page").alias("best_page"))).alias("revisits"))
    files = manifest.groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    n = max(1, min(100_000, -(-total // 500)))
    todo = files.join(revisits, "file", "left").select("file", "revisits").repartition(n, "file")
    return write_table(todo.mapInPandas(_to_warc(arcs, out), "file string"), "warcs")


def read_warcs(files: DataFrame, path: str) -> DataFrame:
    """One row per response, resource or revisit record, its digests checked."""
    n = max(1, min(100_000, files.count()))
    return files.repartition(n).mapInPandas(_from_warc(path), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, date string")


def pages_through_warc(pages: DataFrame, **columns: str) -> DataFrame:
    """pages as ARC, ARC as WARC, WARC read back. Null html is an empty payload, a null url about:blank, a null id none;
    repeated rows are records of their own; an empty table gives no file and no row. Ids are whole numbers, or strings of such;
    other columns are not read."""
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    return read_warcs(arc_to_warc(pages_to_arc(pages, arcs, **columns), arcs, warcs), warcs)
