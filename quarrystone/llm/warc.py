"""WARC derivative builder.

For each response record two records are derived: a metadata record with what
is known of the page, and a conversion record with its plain text. Both refer
to the response by its record id and carry its URI and date; the source's
headers and payload digest are kept, blocks get digests of their own. Record
ids are name-based, so a rerun writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as htmllib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html import Tag, attributes, body_lines, tags

VERSION = "WARC/1.1"
#: Namespace of derived record ids, a fixed value.
NAMESPACE = uuid.UUID("6f2d1c1e-9a53-5b0c-8d57-0f6f1f7f5a11")
#: The date of records made from pages, which have none.
DATE = "2024-01-01T00:00:00Z"
SCHEMA = "warc_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
#: Bytes of gzip that are unpacked at a time, and of a record's headers at most.
_PIECE = 1 << 20
_HEADER_BYTES = 1 << 20


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(name))}>"


def plain_text(page: str, found: list[Tag] | None = None) -> str:
    """All text of the body, a block a line; scripts, styles and the head are no text."""
    return "\n".join(body_lines(page, list(tags(page)) if found is None else found))


def _clean(text: str) -> str:
    return " ".join(htmllib.unescape(text).split())


def about_page(page: str, found: list[Tag]) -> list[tuple[str, str]]:
    """Title, language and links of a page, as far as it has them, by its tags."""
    title = lang = None
    links = []
    for _, _, name, closing, attrs, inner in found:
        if name == "a" and not closing:
            links += [("outlink", _clean(v)) for k, v in attributes(attrs) if k == "href"][:1]
        elif name == "title" and inner and title is None:
            title = _clean(page[slice(*inner)])
        elif name == "html" and not closing and lang is None:
            lang = next((v for k, v in attributes(attrs) if k == "lang"), None)
    return [("title", title)] * (title is not None) + [("language", lang)] * bool(lang) + links


def response(key: str, uri: str | None, page: str | None, date: str = DATE) -> dict:
    """A response record for a fetched page."""
    payload = (page or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", key, uri or "", digest(payload)), "WARC-Date": date, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Length": str(len(block)),
    }
    if uri is not None:
        headers["WARC-Target-URI"] = uri.replace("\r", "%0D").replace("\n", "%0A")
    return {"headers": headers, "block": block}


def payload_of(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """HTTP headers and body of a response block; a block without headers is all body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return [], block
    pairs = [line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:]]
    return [(k.strip(), v.strip()) for k, _, v in pairs], body


def derive(headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response record; none for other types."""
    if headers.get("WARC-Type") != "response":
        return []
    fields, body = payload_of(block or b"")
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    charset = (re.search(r"charset\s*=\s*[\"']?([\w.-]+)", kind, re.I) or [None, "utf-8"])[1]
    try:
        page = body.decode(charset, "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    source, kept = headers.get("WARC-Record-ID", ""), {k: headers[k] for k in ("WARC-Target-URI", "WARC-Date") if headers.get(k) is not None}
    payload_digest = headers.get("WARC-Payload-Digest") or digest(body)
    about = [("source-record-id", source), ("source-payload-digest", payload_digest), ("source-block-digest", headers.get("WARC-Block-Digest") or digest(block or b"")), ("source-content-length", str(len(body)))]
    about += [(f"source-header-{k.lower()}", v) for k, v in fields]
    found = list(tags(page))
    about += about_page(page, found)
    blocks = {"metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about).encode()), "conversion": ("text/plain; charset=utf-8", plain_text(page, found).encode())}
    out = []
    for warc_type, (content_type, own) in blocks.items():
        made = {
            "WARC-Type": warc_type, "WARC-Record-ID": record_id(warc_type, source, payload_digest), "WARC-Refers-To": source, **kept, "WARC-Source-Payload-Digest": payload_digest,
            "WARC-Block-Digest": digest(own), "Content-Type": content_type, "Content-Length": str(len(own)),
        }
        out.append({"warc_type": warc_type, "record_id": made["WARC-Record-ID"], "refers_to": source, "target_uri": headers.get("WARC-Target-URI"), "headers": made, "block": own})
    return out


def serialise(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a WARC file; line breaks inside header values become spaces."""
    lines_ = [VERSION, *(f"{k}: {' '.join(v.splitlines())}" for k, v in headers.items())]
    return ("\r\n".join(lines_) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def unpacked(data: bytes) -> Iterator[bytes]:
    """A file's bytes piece by piece, unpacked if it is gzip (one member or many); a damaged member ends there, the next goes on."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at >= 0:
        member = zlib.decompressobj(31)
        begin, used = at, at
        try:
            while not member.eof and used < len(data):
                piece = member.decompress(view[used : used + _PIECE])
                used += _PIECE
                yield piece
                while member.unconsumed_tail:
                    yield member.decompress(member.unconsumed_tail)
            at = min(used, len(data)) - len(member.unused_data) if member.eof else len(data)
        except zlib.error:
            at = begin + 2
        at = data.find(b"\x1f\x8b\x08", at)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The whole records of a WARC file, plain or gzipped."""
    return ((headers, block) for headers, block, error in read(data) if error is None)


def read(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error) of the records of a WARC file; what is damaged is reported, and the next record looked for.

    Errors are headers that do not end or are too long, a length that is no
    number, and a block that is cut off, of which what is there is given.
    """
    pieces, buffer, more = unpacked(data), bytearray(), True

    def have(n: int) -> bool:
        nonlocal more
        while more and len(buffer) < n:
            piece = next(pieces, None)
            more = piece is not None
            buffer.extend(piece or b"")
        return len(buffer) >= n

    while True:
        start = buffer.find(b"WARC/")
        if start < 0:
            del buffer[: max(0, len(buffer) - 4)]
            if not have(len(buffer) + 1):
                return
            continue
        del buffer[:start]
        while (end := buffer.find(b"\r\n\r\n")) < 0 and len(buffer) < _HEADER_BYTES and have(len(buffer) + 1):
            pass
        again = [m.start() for m in _VERSION.finditer(buffer, 5, max(end, 0))]
        if end < 0 or again:
            yield {}, b"", "headers do not end"
            del buffer[: again[-1] if again else 5]
            continue
        headers = {}
        for line in buffer[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip()] = v.strip()
        length = headers.get("Content-Length", "0")
        if not (length.isascii() and length.isdigit()):
            yield headers, b"", "the length is no number"
            del buffer[:5]
            continue
        size = int(length)
        whole = have(end + 4 + size)
        block = bytes(buffer[end + 4 : end + 4 + size])
        # A block that holds the beginning of another record was cut off before that.
        cut = -1 if whole else block.find(b"\r\n\r\nWARC/")
        yield headers, block if cut < 0 else block[:cut], None if whole else "the block is cut off"
        del buffer[: end + 4 + (size if cut < 0 else cut)]


def _rows(made: list[tuple[tuple, dict]], keep: list[str]) -> pd.DataFrame:
    out = {f"keep{i}": [k[i] for k, _ in made] for i in range(len(keep))}
    for name in ("warc_type", "record_id", "refers_to", "target_uri", "headers", "block"):
        out[name] = [r[name] for _, r in made]
    return pd.DataFrame(out)


def derive_records(records: DataFrame, headers_col: str = "headers", block_col: str = "block") -> DataFrame:
    """(warc_type, record_id, refers_to, target_uri, headers, block): two rows for each response of ``records``.

    ``headers`` is a map of WARC header fields, ``block`` the record's bytes. A
    null block is empty; records of other types, or with null headers, give no
    rows. Repeated responses give repeated records with the same ids.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for h, b in zip(frame["h"], frame["b"], strict=True):
                yield _rows([((), r) for r in derive(dict(h), bytes(b) if b is not None else b"")], []) if h is not None else _rows([], [])

    return records.select(F.col(headers_col).alias("h"), F.col(block_col).alias("b")).mapInPandas(build, SCHEMA)


def derive_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """As ``derive_records`` for pages, each first made a response record; adds the key and the source's headers.

    A null url leaves out the target URI; null html is an empty page.
    """
    kind = dict(pages.dtypes)[key_col]

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for key, url, page in zip(frame["k"].tolist(), frame["u"].tolist(), frame["p"].tolist(), strict=True):
                source = response(str(key), url, page)
                made += [((key, source["headers"]), r) for r in derive(source["headers"], source["block"])]
            yield _rows(made, ["key", "source"]).rename(columns={"keep0": "key", "keep1": "source_headers"})

    chosen = pages.select(F.col(key_col).alias("k"), F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("p"))
    return chosen.mapInPandas(build, f"key {kind}, source_headers map<string,string>, {SCHEMA}")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, headers, block, error) of all records of the WARC files at ``path``; error is null for whole records.

    A file is one task's work, as a gzip file cannot be entered in the middle;
    of what it unpacks to, a record at a time is held. Damaged records are
    rows with an error, and the others of their file are read.
    """

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                for h, b, error in read(bytes(data)):
                    yield pd.DataFrame({"path": [name], "headers": [h], "block": [b], "error": [error]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(records, "path string, headers map<string,string>, block binary, error string")


def to_warc(records: DataFrame) -> DataFrame:
    """(record_id, record): each record's bytes as a gzip member; members can be joined in any order to a WARC file. Null headers are none, a null block is empty."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [gzip.compress(serialise(dict(h or {}), bytes(b) if b is not None else b""), mtime=0) for h, b in zip(frame["headers"], frame["block"], strict=True)]
            yield pd.DataFrame({"record_id": frame["record_id"], "record": got})

    return records.select("record_id", "headers", "block").mapInPandas(pack, "record_id string, record binary")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive_pages(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", F.col("source_headers")["WARC-Payload-Digest"].alias("source_payload_digest"),
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"), F.length("block").cast("long").alias("content_length"), F.decode("block", "UTF-8").alias("block"),
    )
