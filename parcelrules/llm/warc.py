"""WARC archives: a writer with revisit records, and a splittable reader of gzip members.

Every record is a gzip member of its own. Spark's text writer lays the members
end to end: a member's last byte is 0 (the top of its length field; a longer one
gets an empty member behind it), so that byte is left to the writer as the line
separator, and the file holds exactly the members. The archives have no ``.gz``
suffix, as Hadoop's readers would then take them for one unsplittable stream.

The reader lets Spark's text source cut the files into byte ranges and find the
next gzip magic (1f 8b 08) as its separator; a range owns the candidates that
start inside, and reads its last one past its end. A candidate is a member if it
inflates to a WARC header. The magic may also occur inside compressed bytes: then
the open member isn't at its end, and the pieces are joined again. Where that
happens across the end of a range, the open head and the pieces that the next
range couldn't place are brought together by a small join over those leftovers.

Defined cases: a null html is an empty payload; a null page_id or url is left out
of the header and read back as null; rows repeated with page_id and payload are
all responses; a null page_id comes last among equal payloads; a damaged or cut
member is skipped; an empty table writes no record.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelrules.llm import common as c

MAGIC = b"\x1f\x8b\x08"
LEAST_BYTES = 100
EMPTY_MEMBER = (lambda z: z.compress(b"") + z.flush())(zlib.compressobj(wbits=31))
NO_DATE = "1970-01-01T00:00:00Z"
RECORD = "type string, page_id string, refers_to string, uri string, digest string, length long, payload binary"
FIELDS = [x.split() for x in RECORD.split(", ")]
SCHEMA = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in FIELDS])


# --- writing ------------------------------------------------------------------------

def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id, refers_to, url: str | None, digest: str, payload: bytes) -> bytes:
    """The text of one record; a revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {NO_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {one_line(url)}")
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as gzip, ending with a zero byte."""
    z = zlib.compressobj(wbits=31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def with_types(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, kind and refers_to of every page."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    key = F.col("page_id")
    seen = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(
        F.min(F.struct(key.isNull().alias("none"), key.alias("id"))).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = seen.where("n > 1").select("digest", F.col("first.id").alias("first"), F.lit(True).alias("again"))
    repeated = c.materialised(repeated, "warc-repeated", narrow=True)
    side = c.slim(repeated, repeated.count())
    both = rows.join(side, "digest", "left")
    # A short payload has no entry; an empty one neither.
    revisit = F.coalesce("again", F.lit(False)) & ~key.eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                       F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One archive per task in folder ``path``."""

    def compress(batches):
        for batch in batches:
            rows = [member(record(kind, page, refers, url, digest, payload))[:-1] for kind, page, refers, url, digest, payload in zip(
                *(batch.column(n).to_pylist() for n in ("kind", "page_id", "refers_to", "url", "digest", "payload")))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["member"])

    members = with_types(pages).mapInArrow(compress, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


# --- reading ------------------------------------------------------------------------

class Member:
    """A gzip member being inflated."""

    def __init__(self):
        self.inflater, self.out, self.raw = zlib.decompressobj(wbits=31), [], []

    def feed(self, piece: bytes) -> bool:
        """False if the piece can't be a part of this member."""
        self.raw.append(piece)
        try:
            self.out.append(self.inflater.decompress(piece))
        except zlib.error:
            return False
        return True

    @property
    def ended(self) -> bool:
        return self.inflater.eof

    @property
    def sure(self) -> bool:
        """Its first bytes are a WARC header, or it is whole and empty."""
        head = self.text()[:5]
        return head == b"WARC/" or (self.ended and not head)

    def text(self) -> bytes:
        if len(self.out) > 1:
            self.out = [b"".join(self.out)]
        return self.out[0] if self.out else b""


def opened(piece: bytes) -> Member | None:
    """The member that may start with ``piece``: sure, or too short to tell."""
    m = Member()
    if not m.feed(piece):
        return None
    return m if m.sure or (not m.ended and b"WARC/".startswith(m.text()[:5])) else None


def parsed(data: bytes) -> dict | None:
    """The fields of a record's text; None for an empty member or other types of record."""
    head, _, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = named.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    block = block[:int(named.get("content-length", len(block)))]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]

    def page(name: str) -> str | None:
        value = named.get(name, "")
        return value[len("<urn:page:"):-1] if value.startswith("<urn:page:") else None

    return {"type": kind, "page_id": page("warc-record-id"), "refers_to": page("warc-refers-to"),
            "uri": named.get("warc-target-uri"), "digest": named.get("warc-payload-digest", "").removeprefix("sha256:"),
            "length": int(lengths[0]) if lengths else len(payload), "payload": payload if kind == "response" else None}


class Range:
    """The candidates of one byte range, in order."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.member, self.lead, self.placed = file, start, None, [], False

    def take(self, piece: bytes):
        """Records that end with this piece."""
        if self.member and self.member.feed(piece) and (self.member.sure or not self.member.text()[5:]):
            pass
        else:
            # The open member was none, or is damaged; this piece may start one.
            self.set_aside()
            self.member = opened(piece)
            if self.member is None:
                if not self.placed:
                    self.lead.append(piece)
                return
        self.placed = self.placed or self.member.sure
        if self.member.ended:
            found, self.member = parsed(self.member.text()), None
            if found:
                yield found

    def set_aside(self) -> None:
        """What looked like a member and was none belongs to the range before, if no member was found yet."""
        if self.member and not self.placed:
            self.lead += self.member.raw
        self.member = None

    def leftovers(self):
        """What another range needs or has: (place in the range, bytes)."""
        if not self.placed:
            self.set_aside()
        if self.lead:
            yield 0, b"".join(self.lead)
        if self.member:
            yield 1, b"".join(self.member.raw)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of all archives under ``path``."""
    pieces = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"))
    left = [pa.field("file", pa.string()), pa.field("start", pa.int64()), pa.field("place", pa.int32()), pa.field("rest", pa.binary())]
    schema = pa.schema([*SCHEMA, *left])

    def scan(batches):
        now = None
        for batch in batches:
            out = []
            for piece, file, start in zip(*(batch.column(n).to_pylist() for n in ("piece", "file", "start"))):
                if now is None or (now.file, now.start) != (file, start):
                    out += ended(now)
                    now = Range(file, start)
                    if start == 0:       # what lies before the file's first magic
                        continue
                out += now.take(MAGIC + piece)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        yield pa.RecordBatch.from_pylist(ended(now), schema=schema)

    def ended(r: Range | None) -> list[dict]:
        return [{"file": r.file, "start": r.start, "place": place, "rest": rest} for place, rest in r.leftovers()] if r else []

    def rejoin(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                r = Range("", 0)
                for part in parts:
                    head, *more = part["rest"].split(MAGIC)
                    for piece in more:
                        out += r.take(MAGIC + piece)
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)

    scanned = c.materialised(pieces.mapInArrow(scan, RECORD + ", file string, start long, place int, rest binary"), "warc-records")
    loose = scanned.where(F.col("rest").isNotNull()).select("file", "start", "place", "rest")
    # A head starts a group; the unplaced pieces of the ranges behind it follow.
    group = F.sum("place").over(Window.partitionBy("file").orderBy("start", "place"))
    groups = loose.withColumn("group", group).groupBy("file", "group").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "rest"))).alias("parts"))
    whole = scanned.where(F.col("type").isNotNull()).select(*[n for n, _ in FIELDS])
    return whole.unionByName(groups.select("parts").mapInArrow(rejoin, RECORD))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives to ``path`` and reads back what they say of each page."""
    kind = dict(pages.dtypes)["page_id"]
    write_archives(pages, path)
    read = read_archives(pages.sparkSession, path)
    response = F.col("type") == "response"
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
