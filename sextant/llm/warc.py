"""WARC archives of pages, and an index merged from sorted capture runs.

Records are written by Spark's own text writer into the shared folder, with the record's closing
blank lines as line separator, so files reach any store that Spark reaches. A line is a bundle of
records of BUNDLE_BYTES or more together, and a file holds FILE_BUNDLES of them, so files are
bounded by bytes but for records that are larger themselves. Files are compressed; they are
read back by Content-Length, inflated as records are taken from them. Offsets and
lengths are those of the plain archive.

Each archive file gives one run of captures, sorted where it is read. A range partition by key
(URL key, time, page, file, offset) cuts the runs, so that a hot URL's captures spread over
several ranges; each range merges its pieces of runs with a loser tree, and the counts of the
ranges before it number its captures in the order of all.
"""

from __future__ import annotations

import base64
import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import lean, removed, scratch, slices, written
from sextant.session import shipped

#: Bytes of a bundle of records, and bundles of one archive file.
BUNDLE_BYTES, FILE_BUNDLES = 64 << 10, 256
#: Captures that one range of keys holds about.
RANGE_ROWS = 20_000
ENDING = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Pages have no time of capture: page n is dated n seconds after this second.
EPOCH = 946_684_800

CAPTURE = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
NAMES = [field.split()[0] for field in CAPTURE.split(", ")]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def date(page_id: int | None) -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(min(max(EPOCH + (page_id or 0), 0), 253_402_300_799)))


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels from the right, then the path; scheme, fragment, a leading www and letter case go."""
    m = re.match(r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    host, rest = (m[1], m[2]) if m else ("", (url or "").partition("#")[0])
    host = re.sub(r"^www\.|:(80|443)?$", "", host.rpartition("@")[2].lower())
    return f"{','.join(reversed(host.split('.')))}){(rest or '/').lower()}"


def record(page_id: int | None, url: str | None, html: str | None, first: int | None) -> str:
    """The text of one record, without its ending. `first`: the page that holds an equal payload, if another does."""
    payload = (html or "").encode()
    repeated = first is not None and first != page_id
    lines = [VERSION, f"WARC-Type: {'revisit' if repeated else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date(page_id)}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if repeated:
        lines += [f"WARC-Refers-To: {record_id(first)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {first}", "Content-Length: 0"]
        return "\r\n".join(lines) + ENDING
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines) + ENDING + (html or "")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers (names in lower case), block, offset and length of each record of an archive that comes in pieces."""
    data, start = bytearray(), 0  # what is read and not yet given, and where it stands in the archive

    def more(n: int) -> bool:
        while len(data) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            data.extend(piece)
        return True

    while more(1):
        while (end := data.find(b"\r\n\r\n")) < 0:
            if not more(len(data) + 1):
                raise ValueError(f"the record at byte {start} has no end of its headers")
        head = data[:end].decode().split("\r\n")
        if head[0] != VERSION:
            raise ValueError(f"no record at byte {start}")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head[1:])}
        stop = end + 4 + int(fields["content-length"])
        if not more(stop + 4) or data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {start} does not end where it says")
        yield fields, bytes(data[end + 4 : stop]), start, stop + 4
        del data[: stop + 4]
        start += stop + 4


def inflated(data: bytes, piece: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file, of one member or more, in pieces of at most `piece` bytes."""
    rest = data
    while rest:
        member = zlib.decompressobj(31)
        while not member.eof:
            out = member.decompress(rest, piece)
            rest = member.unconsumed_tail
            if out:
                yield out
            elif not rest and not member.eof:
                raise ValueError("the file ends within a compressed member")
        rest = member.unused_data


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in (p for whole in batches for p in slices(whole, "html", 256)):
        for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first")), strict=True):
            held.append(record(*row))
            size += len(held[-1])
            if size >= BUNDLE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([ENDING.join(held)], pa.string())], names=["value"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([ENDING.join(held)], pa.string())], names=["value"])


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for k in range(part.num_rows):
            path, found = part.column("path")[k].as_py(), []
            for fields, block, offset, length in records(inflated(part.column("content")[k].as_py())):
                says = fields["warc-payload-digest"].removeprefix("sha1:")
                kind = fields["warc-type"]
                if kind == "response" and (digest(block) != says or len(block) != int(fields["x-payload-length"])):
                    raise ValueError(f"{path}, byte {offset}: the payload is not what the record says")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                uri = fields.get("warc-target-uri")
                found.append(
                    (url_key(uri), re.sub(r"\D", "", fields["warc-date"]), None if page is None else int(page), uri, int(fields["x-payload-length"]), says, kind, None if refers is None else int(refers), path.rpartition("/")[2], offset, length)
                )
            found.sort(key=order)
            yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in found], t) for i, t in enumerate(KINDS)], names=NAMES)


def order(row: tuple) -> tuple:
    """Captures go by URL key, time, page (none first), file and offset."""
    return (row[0].encode(), row[1], row[2] is not None, row[2] or 0, row[8], row[9])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next row costs one path of matches."""

    def __init__(self, runs: list[Iterator[tuple]], key=order):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list[tuple | None] = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:  # the first to come here waits
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[best := self.losers[0]] is not None:
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.keys[best] = None if self.heads[best] is None else self.key(self.heads[best])
            self._play(best)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (range, file), each file's in order, to each range's in order."""

    def flushed() -> Iterator[pa.RecordBatch]:
        merged, at = iter(LoserTree([iter(r) for r in runs.values()])), 0
        while block := list(islice(merged, 4096)):
            columns = [pa.array([row[i] for row in block], t) for i, t in enumerate(KINDS)]
            yield pa.RecordBatch.from_arrays([pa.array([now] * len(block), pa.int32()), pa.array(range(at, at + len(block)), pa.int64()), *columns], names=["range", "place", *NAMES])
            at += len(block)

    now, runs = None, {}
    for part in batches:
        for r, *row in zip(part.column("range").to_pylist(), *(part.column(c).to_pylist() for c in NAMES), strict=True):
            if r != now:
                if runs:
                    yield from flushed()
                now, runs = r, {}
            runs.setdefault(row[8], []).append(tuple(row))
    if runs:
        yield from flushed()


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_bundles: int = FILE_BUNDLES) -> None:
    """Write a record for each row of `pages` (page_id long, url string, html string) as files below `path`.

    Of rows with equal payloads of `least_bytes` or more, those with the largest page_id are
    responses and the others revisits of it; smaller payloads are all responses. A null html
    is an empty payload. Rows without page_id revisit one that has, or are responses.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumns({"sha": F.sha1("html"), "n": F.octet_length("html")})
    firsts = own.select("page_id", "sha", "n").where(F.col("n") >= least_bytes).groupBy("sha", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    known = own.join(firsts, ["sha", "n"], "left").select("page_id", "url", "html", "first")
    known.mapInArrow(lean(_texts), "value string").write.option("lineSep", ENDING).option("maxRecordsPerFile", file_bundles).option("compression", "gzip").text(path)


def captures(pages: DataFrame, path: str) -> DataFrame:
    """The captures of the archives below `path`, one row each, in no order."""
    files = pages.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(lean(_captures), CAPTURE)


def histories(found: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """`found` in one global order of URL key, time, page, file and offset: nth (from 0) is a capture's place
    in it, and place (from 0) its place among those of its URL key.

    Ranges of about `range_rows` captures are cut by all of what captures are ordered by, so
    captures of one URL key may fall in several ranges; what a range holds is what one task merges.
    """
    spark = found.sparkSession
    ranged = found.repartitionByRange(max(1, -(-found.count() // range_rows)), *key_order()).withColumn("range", F.spark_partition_id())
    merged, path = written(ranged.sortWithinPartitions("file", *key_order()).mapInArrow(lean(_merged), f"range int, place long, {CAPTURE}"), "merged")
    before = lambda *by: Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = merged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before()), F.lit(0)).alias("ahead"))
    # The first capture of a URL key in the order of all: one of its range's, or of one before.
    numbered, _ = written(merged.join(counts, "range").withColumn("nth", F.col("ahead") + F.col("place")).drop("range", "place", "ahead"), "histories")
    removed(spark, path)
    firsts = numbered.groupBy(F.col("url_key").alias("first_key")).agg(F.min("nth").alias("first"))
    joined = numbered.join(firsts, F.col("url_key") == F.col("first_key"))
    return joined.select("nth", (F.col("nth") - F.col("first")).alias("place"), *NAMES)


def key_order() -> list:
    return ["url_key", "captured", F.asc_nulls_first("page_id"), "file", "offset"]


def archived(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write `pages` as archives and give what reading them back yields, as ordered capture
    histories: nth (the row's number in the global order), place (its number in the history of
    its URL key), url_key, captured, page_id, url, payload_bytes, payload_digest (upper-case
    base32 SHA-1 of the full payload), record_type, refers_to (the response's page_id, of
    revisits), file, offset, length.

    One row per row of `pages`; repeated rows give repeated records. White space and control
    characters in a URL are percent-encoded; a null one has the key `)/`. Pages have no time, so
    `captured` is made up from page_id. No pages give no rows. Columns of `pages` but page_id,
    url and html are left out, whatever their names.
    """
    spark = pages.sparkSession
    shipped(spark)
    own, path = path is None, path or scratch(spark, "warc")
    write(pages, path, least_bytes)
    found, run_path = written(captures(pages, path), "captures")
    out = histories(found)
    removed(spark, run_path, *([path] if own else []))
    return out
