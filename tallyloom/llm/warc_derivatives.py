"""WARC derivatives: responses become linked metadata and plain-text conversion records (WARC 1.1).

Each response gives two records that refer to it by WARC-Refers-To: a conversion whose block is the page's text, and a
metadata record (application/warc-fields) that keeps the source record's headers, its HTTP headers and digests and names the
conversion. Record ids are derived from the response's id, so rebuilding gives the same records. `read_records` takes the
records of WARC files (plain or compressed record by record). `write_records` stores records as a table of gzip members, so it
lives in any store Spark writes to: members joined are a WARC file. All work is per record or per file: no shuffle.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package, slices

# Elements whose content isn't text, and elements that end a line.
_RAW = ("script", "style", "noscript", "template")
_LINES = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul title".split())
# What may stand in a head; any other element ends a head whose end tag was left out.
_HEAD = frozenset("base basefont bgsound link meta title script style noscript template head html".split())
#: The rest of a tag with its quoted attributes. A quoted value that holds a < is looked for so far only, so that quotes that
#: never end can't make a page's scan quadratic.
_REST = r"((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]{0,8192}+\"|'[^']{0,8192}+'|[\"'])*+)>"
#: A comment; a declaration; an element without markup, up to its end tag or the page's end; a tag. A bare < is none.
_MARK = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(?ai:(script|style|noscript|template|title))(?![a-zA-Z0-9:-])" + _REST + r"(.*?)(?:(?ai:</\1)[^>]*(?:>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _REST, re.S)
_LINK = re.compile(r"""(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_LANG = re.compile(r"""(?:^|\s)lang\s*=\s*["']?([A-Za-z-]+)""", re.I)
#: Runs of blanks within a line but the single space, which stays as it is.
_BLANKS = re.compile(r"[^\S\n ][^\S\n]*| [^\S\n]+")


def page_parts(page: str | None) -> tuple[str, str | None, str | None, list[str]]:
    """Text, title, language and links of an HTML page, in one pass over its tags.

    Scripts, styles, heads and comments are dropped, up to the end of the page if they aren't closed; a head without an end
    tag ends at the first element, or text, that can't stand in one. Block elements stand on lines of their own. A < that
    begins no tag is text. Null is an empty page.
    """
    parts = _MARK.split(page or "")
    out: list[str] = [parts[0]]
    title, lang, links, inside = None, None, [], False
    for raw, _, body, closing, name, rest, text in zip(*(parts[k::7] for k in range(1, 8)), strict=True):
        if raw is not None:
            if title is None and raw.lower() == "title":
                title = body
            elif raw.lower() == "title" and not inside:
                out.append(_MARK.sub(" ", body))
            out.append(" \n" if len(raw) == 5 and raw.lower() == "title" else " ")
        elif name is None:
            if not inside:
                out.append(" ")
        else:
            name = name.lower()
            if inside and (name not in _HEAD or closing and name == "head"):
                inside = False
            if name == "a":
                if not closing and (link := _LINK.search(rest)):
                    links.append(next(x for x in link.groups() if x is not None))
            elif name == "head":
                inside = not closing
            elif name == "html":
                lang = lang or (_LANG.search(rest) or [None, None])[1]
            elif name in _LINES:
                out.append("\n")
            if name == "html":
                out.append("\n")
        if inside and text and not text.isspace():
            inside = False
        if not inside:
            out.append(text)
    lines = map(str.strip, _BLANKS.sub(" ", html.unescape("".join(out))).split("\n"))
    return "\n".join(line for line in lines if line), title, lang, links


def plain_text(page: str | None) -> str:
    return page_parts(page)[0]


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAIRS = [a + b for a in _LETTERS for b in _LETTERS]


def sha1_label(data: bytes) -> str:
    """The digest in base 32, ten bits at a time."""
    n = int.from_bytes(hashlib.sha1(data).digest())
    return "sha1:" + "".join([_PAIRS[n >> k & 1023] for k in range(150, -1, -10)])


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as a gzip member, the same on every call: members joined in any order are a .warc.gz file."""
    return gzip.compress(record, 1, mtime=0)


#: Fields whose names are read in any case.
_FIELDS = {name.lower(): name for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Refers-To-Payload-Digest", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length")}


def records_of(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records of a WARC file that comes in pieces; a repeated header's values are joined by newlines.

    What is held is one record and one piece. A file cut short gives its whole records; a record without Content-Length ends it.
    """
    data, at = b"", 0
    wanted = 0  # bytes from `at` without which there is no use in looking
    for piece in pieces:
        data, at = data[at:] + piece if at < len(data) else piece[max(0, at - len(data)) :], 0
        while len(data) - at >= wanted:
            while data[at : at + 2] == b"\r\n":
                at += 2
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                wanted = 0
                break
            headers: dict[str, str] = {}
            for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                name, value = _FIELDS.get(name.strip().lower(), name), value.strip()
                headers[name] = f"{headers[name]}\n{value}" if name in headers else value
            size = headers.get("Content-Length", "")
            if not (size.isascii() and size.isdigit()):
                return
            wanted = end + 4 + int(size) - at
            if len(data) - at < wanted:
                break
            yield headers, data[end + 4 : at + wanted]
            at, wanted = at + wanted, 0


def parse_records(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    return list(records_of([data]))


def unzipped_pieces(data: bytes, size: int = 1 << 13) -> Iterator[bytes]:
    """The members of a gzip file, piece by piece; other data as it is. A member cut short gives what it holds."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield data
    while view[at : at + 2] == b"\x1f\x8b":
        one, parts = zlib.decompressobj(31), []
        while not one.eof and at < len(view):
            parts.append(one.decompress(view[at : at + size]))
            at = min(at + size, len(view))
            if len(parts) > 64:
                yield b"".join(parts)
                parts = []
        at -= len(one.unused_data)
        yield b"".join(parts)


def unzipped(data: bytes) -> bytes:
    return b"".join(unzipped_pieces(data))


def dechunked(body: bytes) -> bytes:
    """A body without its transfer coding in chunks; what isn't so coded as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return body
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out) if out else body


def page_of(body: bytes, http_headers: str) -> str:
    """The characters of a body: its gzip or deflate coding undone, and read as its header says, else as UTF-8; broken codings give the bytes as they are."""
    for coding in re.findall(r"(?im)^content-encoding:[ \t]*([^\r\n]*)", http_headers)[:1]:
        for name in reversed([c.strip().lower() for c in coding.split(",")]):
            try:
                if name in ("gzip", "x-gzip"):
                    body = unzipped(body)
                elif name == "deflate":
                    body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
            except zlib.error:
                break
    charset = re.search(r"(?im)^content-type:[^\r\n]*charset=[\"']?([\w.-]+)", http_headers)
    if charset is None or charset[1].lower() in ("utf-8", "utf8"):
        try:
            return body.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return body.decode("utf-8", "replace")
    try:
        return body.decode(charset[1], "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def _clean(value: str) -> str:
    return (re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value).strip()


def derive(response_id: str, uri: str, date: str, http_headers: str, payload: bytes | str, source_headers: dict[str, str] | None = None) -> list[dict]:
    """The conversion and the metadata record of one response; digests that its own record states are kept as they stand, others are of the payload's bytes."""
    body = payload.encode("utf-8", "surrogatepass") if isinstance(payload, str) else payload
    text, title, lang, links = page_parts(payload if isinstance(payload, str) else page_of(body, http_headers))
    links = [_clean(html.unescape(x)) for x in links]
    block, own = text.encode("utf-8", "surrogatepass"), source_headers or {}
    source = {"payload": own.get("WARC-Payload-Digest") or sha1_label(body), "block": own.get("WARC-Block-Digest") or sha1_label(http_headers.encode() + b"\r\n\r\n" + body)}
    conversion_id, metadata_id = record_id("conversion", response_id), record_id("metadata", response_id)
    fields = [("conversion-record", conversion_id), ("source-payload-digest", source["payload"]), ("source-block-digest", source["block"]), ("source-content-length", str(len(body)))]
    fields += [("title", _clean(html.unescape(title)))] if title is not None else []
    fields += [("language", lang.lower())] if lang else []
    fields += [("source-record-header", _clean(f"{k}: {v}")) for k, v in own.items()]
    fields += [("source-header", _clean(line)) for line in http_headers.split("\r\n") if line.strip()] + [("outlink", x) for x in links]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    out = []
    for kind, ident, content, mime in (("conversion", conversion_id, block, "text/plain; charset=utf-8"), ("metadata", metadata_id, meta, "application/warc-fields")):
        headers = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Target-URI", _clean(uri)), ("WARC-Refers-To", response_id)]
        headers += [("WARC-Refers-To-Payload-Digest", source["payload"])] * (kind == "conversion")
        digest = sha1_label(content)
        headers += [("WARC-Block-Digest", digest), ("Content-Type", mime), ("Content-Length", str(len(content)))]
        out.append({"kind": kind, "record_id": ident, "refers_to": response_id, "headers": headers, "block": content, "digest": digest, "source_digest": source["payload"], "links": len(links)})
    return out


_NAMES = ["key", "kind", "record_id", "refers_to", "block_digest", "source_digest", "n_bytes", "n_links"]


def _derive(keep: bool):
    def run(batches):
        for batch in slices(batches):
            keys, rows = [], []
            for k, (rid, uri, date, head, payload, own) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("response_id", "uri", "date", "http_headers", "payload", "record_headers")), strict=True)):
                found = derive(rid, uri or "", date or "", head or "", payload or b"", dict(own or ()))
                keys += [k] * len(found)
                rows += found
            column = lambda n, kind: pa.array([r[n] for r in rows], kind)
            out = [batch.column("key").take(pa.array(keys, pa.int64()))] + [column(n, pa.string()) for n in ("kind", "record_id", "refers_to", "digest", "source_digest")] + [pa.array([len(r["block"]) for r in rows], pa.int64()), column("links", pa.int64())]
            if keep:
                out.append(pa.array([member(record_bytes(r["headers"], r["block"])) for r in rows], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, _NAMES + ["record"] * keep)

    return run


# Sources


RESPONSE = "response_id string, uri string, date string, http_headers string, payload binary, record_headers map<string,string>"


def response_of(headers: dict[str, str], block: bytes) -> tuple | None:
    """A response record as a row of RESPONSE, its body without transfer coding; None for other records."""
    if headers.get("WARC-Type") != "response" or "WARC-Record-ID" not in headers:
        return None
    head, found, body = block.partition(b"\r\n\r\n")
    head = head.decode("latin-1") if found else ""
    body = body if found else block
    if re.search(r"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        body = dechunked(body)
    return headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers.get("WARC-Date"), head, body, headers


def _responses_of_files(batches) -> Iterator[pa.RecordBatch]:
    names = ["key", "response_id", "uri", "date", "http_headers", "payload", "record_headers"]
    kinds = [*[pa.string()] * 4, pa.binary(), pa.map_(pa.string(), pa.string())]
    keys, rows, held, schema = [], [], 0, None

    def made():
        columns = [pa.array(keys, schema), *(pa.array([list(r[c].items()) if c == 5 else r[c] for r in rows], kind) for c, kind in enumerate(kinds))]
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in slices(batches):
        schema = batch.schema.field("key").type
        for key, data in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist(), strict=True):
            for found in records_of(unzipped_pieces(data or b"")):
                if (row := response_of(*found)) is not None:
                    keys.append(key)
                    rows.append(row)
                    held += len(row[4])
                    if len(rows) >= 256 or held >= 1 << 24:
                        yield made()
                        keys, rows, held = [], [], 0
    if rows:
        yield made()


def response_rows(files: DataFrame) -> DataFrame:
    """The response records of WARC data in rows (key, content): key and RESPONSE. Null content has none."""
    ship_package(files.sparkSession)
    kind = files.schema["key"].dataType.simpleString()
    return files.select("key", "content").mapInArrow(_responses_of_files, f"key {kind}, {RESPONSE}")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The response records of the WARC files at a path that Spark reads; key is the file's path. A file is read by one task, which unzips and parses it record by record."""
    return response_rows(spark.read.format("binaryFile").load(path).select(F.col("path").alias("key"), "content"))


def _written_response(batches) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for rid, uri, date, head, payload in zip(*(batch.column(c).to_pylist() for c in ("response_id", "uri", "date", "http_headers", "payload")), strict=True):
            body = (payload or "").encode("utf-8", "surrogatepass")
            block = (head or "").encode() + b"\r\n\r\n" + body
            headers = [("WARC-Type", "response"), ("WARC-Record-ID", rid), ("WARC-Date", date or ""), ("WARC-Target-URI", _clean(uri or "")), ("WARC-Payload-Digest", sha1_label(body)), ("WARC-Block-Digest", sha1_label(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
            out.append(record_bytes(headers, block))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(map(member, out), pa.binary())], ["key", "content"])


def responses(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows (key, content) of a table of fetched pages: each page as the gzip member of a WARC response record, for a crawl that kept no records.

    The id derives from key, URL and page by SHA-1, so equal rows are one response. The date, which such a table lacks, is a
    parameter, and the HTTP header states the status, the type and the length alone.
    """
    ship_package(pages.sparkSession)
    digest = F.sha1(F.concat_ws("\n", F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))))
    ident = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-8$4-$5"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string"))
    rows = pages.select(F.col(key_col).alias("key"), ident.alias("response_id"), F.col(url_col).alias("uri"), F.lit(date).alias("date"), head.alias("http_headers"), F.col(html_col).alias("payload"))
    return rows.mapInArrow(_written_response, f"key {rows.schema['key'].dataType.simpleString()}, content binary")


# Derivatives and their files


def derivatives(source: DataFrame, *, records: bool = True) -> DataFrame:
    """Two rows for each response (key and RESPONSE): key, kind, record_id, refers_to, block_digest, source_digest, n_bytes,
    n_links and, with `records`, record (its gzip member of a WARC file).

    A null payload, header, date or URI counts as empty; the conversion of an empty page has an empty block. Responses
    without an id are left out. Repeated rows give repeated records. The key may be null.
    """
    ship_package(source.sparkSession)
    rows = source.select("key", "response_id", "uri", "date", "http_headers", "payload", "record_headers").filter("response_id is not null")
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, kind string, record_id string, refers_to string, block_digest string, source_digest string, n_bytes long, n_links long" + ", record binary" * records
    return rows.mapInArrow(_derive(records), schema)


def write_records(rows: DataFrame, path: str, column: str = "record") -> None:
    """Stores the members of a column, with their key, as a table (key, content) at `path`, which must be new. Null ones are left out."""
    rows.select("key", F.col(column).alias("content")).filter("content is not null").write.option("compression", "uncompressed").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What write_records stored: key, content."""
    return spark.read.parquet(path)


def _parsed(batches) -> Iterator[pa.RecordBatch]:
    field = lambda b, name: next((x[len(name) + 2 :] for x in b.decode("utf-8", "replace").split("\r\n") if x.startswith(name + ": ")), None)
    for batch in slices(batches):
        at, rows = [], []
        for k, data in enumerate(batch.column("content").to_pylist()):
            for h, b in records_of(unzipped_pieces(data)):
                if h.get("WARC-Type") in ("conversion", "metadata"):
                    at.append(k)
                    rows.append((h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Block-Digest"], h.get("WARC-Refers-To-Payload-Digest") or field(b, "source-payload-digest"), len(b), b.count(b"\r\noutlink: ") if h["WARC-Type"] == "metadata" else 0))
        columns = [pa.array([r[c] for r in rows], pa.string() if c < 5 else pa.int64()) for c in range(7)]
        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *columns], _NAMES)


def read_derivatives(files: DataFrame) -> DataFrame:
    """The conversion and metadata records of WARC data in rows (key, content): key, kind, record_id, refers_to, block_digest,
    source_digest, n_bytes and n_links (0 for conversions), all from the stored bytes."""
    ship_package(files.sparkSession)
    kind = files.schema["key"].dataType.simpleString()
    return files.select("key", "content").mapInArrow(_parsed, f"key {kind}, kind string, record_id string, refers_to string, block_digest string, source_digest string, n_bytes long, n_links long")


__all__ = ["derivatives", "derive", "member", "parse_records", "plain_text", "read_derivatives", "read_records", "record_bytes", "response_rows", "responses", "stored", "write_records"]
