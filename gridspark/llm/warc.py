"""WARC archives of pages: writing, and reading back by boundary-chain verification.

Writing: a record per page; of pages with equal payloads one is the response and the others are revisits of it. Spark's text
writer puts records, which end with two line breaks, into files in the shared folder, so any file system that Spark knows will do.

Reading: files are cut into blocks at will, so a task that sees the magic line can't know if a record starts there or if a payload
holds it. Tasks emit every candidate with the offset at which its successor must start. Within a block, chains are followed at
once, so each candidate leads to where its chain leaves the block; from the file's start, pointer jumping then finds the blocks'
true entries in as many rounds as the logarithm of a file's blocks. Candidates off the chain belong to payloads. A record that was
cut by magic in its payload is put together again from its pieces.

Defined results: a null html is an empty payload; a null url is left out. Repeated rows (same id, same payload) are all responses if
that id is the smallest. A null id never is what others refer to, unless all with that payload are null: those are all responses.
Input columns other than the three are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, small, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: A file has at most so many records.
RECORDS_PER_FILE = 200_000
#: A Python worker gets so many lines of an archive at once.
LINES_PER_BATCH = 500
_LINE = "file string, block long, seq long, rel long, bytes long, size long, page_id long, kind string, refers_to long, said string, payload long, digest string"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1; forty bits, ten hexadecimal digits, are eight of its characters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(r_id, r_digest, refers_to)`` of the pages whose payload an earlier id has. No payload is shuffled."""
    rows = pages.select("page_id", "_digest", "_bytes").where(F.col("_bytes") >= least_bytes)
    first = rows.groupBy("_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    later = rows.join(first, "_digest").where("page_id is null or page_id > refers_to")
    return later.select(F.col("page_id").alias("r_id"), F.col("_digest").alias("r_digest"), "refers_to").distinct()


def write_archive(spark: SparkSession, pages: DataFrame, path: str, scratch: Scratch, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``pages(page_id, url, html)`` as WARC files to the folder ``path``."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"_digest": base32_sha1(html.cast("binary")), "_bytes": F.octet_length(html).cast("long")})
    again = scratch.write(revisits(rows, least_bytes), "revisits")
    rows = rows.join(small(again, again.count(), 64), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("_digest") == F.col("r_digest")), "left")
    response = F.col("refers_to").isNull()
    uuid = lambda *x: F.regexp_replace(F.substring(F.sha1(F.concat_ws("|", *x)), 1, 32), "(.{8})(.{4})(.{4})(.{4})(.{12})", "<urn:uuid:$1-$2-$3-$4-$5>")
    block = F.concat(F.lit(HTTP), F.when(response, F.col("html")).otherwise(""))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat_ws(
        "",
        F.lit(MAGIC),
        line("WARC-Type", F.when(response, "response").otherwise("revisit")),
        line("WARC-Record-ID", uuid(F.col("page_id").cast("string"), F.col("_digest"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\x00-\\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        F.when(~response, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uuid(F.col("refers_to").cast("string"), F.col("_digest"))), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


# --------------------------------------------------------------------------- reading


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at every magic line, with file and block; a row is what follows a magic line."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parse(line: bytes) -> tuple | None:
    """(record's size, headers, start of its block in the line), or None where no record can start."""
    end = line.find(b"\r\n\r\n")
    if end < 0:
        return None
    heads = {}
    for h in line[:end].split(b"\r\n"):
        name, colon, value = h.partition(b":")
        if not colon:
            return None
        heads[name.strip().lower()] = value.strip()
    length = heads.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15:
        return None
    return len(MAGIC) + end + 4 + int(length) + len(END), heads, end + 4


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a record's block."""
    return block.partition(b"\r\n\r\n")[2]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(value: bytes | None) -> int | None:
    return int(value) if value else None


def _candidates(batches):
    """Of each line its place in its block; if a record can start there also its size, headers, and payload if it is whole."""
    here, rel, seq = None, 0, 0
    for b in batches:
        out = []
        for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (file, block) != here:
                here, rel, seq = (file, block), 0, 0
            line = value.as_py()
            row = [file, block, seq, rel, len(line), None, None, None, None, None, None, None]
            if got := parse(line):
                size, heads, start = got
                row[5:10] = size, _number(heads.get(b"warc-page-id")), heads.get(b"warc-type", b"").decode("utf-8", "replace"), _number(heads.get(b"warc-refers-to-page")), heads.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
                stop = size - len(MAGIC) - len(END)
                if line[stop:] == END.encode():
                    payload = payload_of(line[start:stop])
                    row[10:] = len(payload), digest_of(payload)
            out.append(row)
            rel += len(line) + len(MAGIC)
            seq += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


_NAMES = [c.split()[0] for c in _LINE.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in _LINE.split(", ")]


def _exits(rows: pa.Table) -> pa.Table:
    """Each candidate of a block with the offset at which its chain leaves the block; broken chains are dropped."""
    at = dict(zip(rows["off"].to_pylist(), rows["next"].to_pylist(), strict=True))
    last = max(at)
    leads: dict[int, int | None] = {}
    for off in sorted(at, reverse=True):  # successors come later in the file, so they are known already
        to = at[off]
        leads[off] = to if to > last else leads.get(to)
    found = [(k, v) for k, v in leads.items() if v is not None]
    return pa.table([pa.array([rows["file"][0].as_py()] * len(found), pa.string()), pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["file", "off", "exit"])


def _walk(rows: pa.Table) -> pa.Table:
    """A block's candidates that lie on a chain from its entry."""
    offs = rows["off"].to_pylist()
    at = dict(zip(offs, rows["next"].to_pylist(), strict=True))
    off = min((o for o, e in zip(offs, rows["entry"].to_pylist(), strict=True) if e), default=None)
    on = set()
    while off in at:
        on.add(off)
        off = at[off]
    return rows.filter(pa.array([o in on for o in offs], pa.bool_())).drop_columns(["next", "entry"])


def entries(candidates: DataFrame, blocks: int, scratch: Scratch) -> DataFrame:
    """``(file, off)``: where the chain from each file's start enters its blocks, by pointer jumping."""
    reached = candidates.where("off = 0").select("file", "off").distinct()
    if blocks <= 1:
        return reached
    jumps = candidates.groupBy("file", "block").applyInArrow(_exits, "file string, off long, exit long")
    jumps = scratch.write(jumps, "jumps")
    ends = jumps.select("file", F.col("exit").alias("off")).distinct().union(reached).distinct()
    jumps = scratch.write(jumps.join(ends, ["file", "off"], "left_semi"), "jumps")
    reached, done = scratch.write(reached, "reached"), 1
    while done < blocks:  # after k rounds all entries up to 2 ** k - 1 blocks from the start are reached
        step = reached.join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
        reached = scratch.write(reached.union(step).distinct(), "reached")
        done *= 2
        if done < blocks:
            jumps = scratch.write(jumps.join(jumps.select("file", F.col("off").alias("exit"), F.col("exit").alias("to")), ["file", "exit"]).select("file", "off", F.col("to").alias("exit")), "jumps")
    return reached


def read_archive(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """``(page_id, kind, refers_to, said, payload, digest)`` of every record on the chains; said is the digest in its header."""
    lines = scratch.write(_lines(spark, path).mapInArrow(_candidates, _LINE), "lines", batch=LINES_PER_BATCH)
    total = lines.groupBy("file", "block").agg(F.sum(F.col("bytes") + len(MAGIC)).alias("total"))
    bases = scratch.write(total.selectExpr("file", "block", "coalesce(sum(total) over (partition by file order by block rows between unbounded preceding and 1 preceding), 0) as base", "count(*) over (partition by file) as blocks"), "bases")
    blocks, n = bases.agg(F.max("blocks"), F.count("*")).first()
    placed = lines.join(small(bases, n, 256), ["file", "block"]).withColumn("off", F.col("base") + F.col("rel") - len(MAGIC)).drop("base", "blocks", "rel")
    candidates = placed.where("size is not null and off >= 0").withColumn("next", F.col("off") + F.col("size"))
    true = entries(candidates.select("file", "block", "off", "next"), blocks or 0, scratch).withColumn("entry", F.lit(True))
    candidates = candidates.join(true, ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    fields = "file string, off long, block long, seq long, bytes long, size long, page_id long, kind string, refers_to long, said string, payload long, digest string"
    records = scratch.write(candidates.select(*(c.split()[0] for c in fields.split(", ")), "next", "entry").groupBy("file", "block").applyInArrow(_walk, fields), "records")
    columns = ["page_id", "kind", "refers_to", "said", "payload", "digest"]
    whole = records.where("digest is not null").select(*columns)
    cut = records.where("digest is null")
    if cut.isEmpty():
        return whole
    # Lines between a cut record and its successor are its pieces.
    heads = placed.join(records.select("file", "off", F.lit(True).alias("true")), ["file", "off"], "left").withColumn("at", F.when(F.col("true"), F.col("off")))
    heads = heads.withColumn("head", F.expr("last(at, true) over (partition by file order by off rows unbounded preceding)"))
    pieces = heads.join(cut.select("file", F.col("off").alias("head")), ["file", "head"], "left_semi").select("file", "block", "seq", "head", "off")
    pieces = scratch.write(pieces, "pieces")

    def numbered(batches):
        here, seq = None, 0
        for b in batches:
            numbers = []
            for key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seq = seq + 1 if key == here else 0
                here = key
                numbers.append(seq)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=["file", "block", "value", "seq"])

    texts = _lines(spark, path).mapInArrow(numbered, "file string, block long, value binary, seq long")
    joined = texts.join(small(pieces, pieces.count(), 256), ["file", "block", "seq"]).groupBy("file", "head").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("p"))
    again = joined.select("file", F.col("head").alias("off"), F.col("p.value").alias("values")).join(cut.drop("payload", "digest"), ["file", "off"])

    def mend(batches):
        for b in batches:
            lengths, digests = [], []
            for values, size in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                line = MAGIC.encode().join(values)
                _, _, start = parse(line)
                stop = size - len(MAGIC) - len(END)
                whole = line[stop:] == END.encode()
                payload = payload_of(line[start:stop])
                lengths.append(len(payload) if whole else None)
                digests.append(digest_of(payload) if whole else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], names=columns)

    return whole.union(again.select(*columns[:4], "values", "size").mapInArrow(mend, "page_id long, kind string, refers_to long, said string, payload long, digest string"))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes the pages, reads the archives, and gives each record its full payload's size and digest, a revisit those of its response."""
    scratch = Scratch(spark, "warc")
    path = path or scratch.path("archive")
    write_archive(spark, pages.select(F.col("page_id").cast("long"), "url", "html"), path, scratch, least_bytes)
    records = scratch.write(read_archive(spark, path, scratch), "read")
    responses = records.where("kind = 'response'").select("page_id", F.col("payload").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    later = records.where("kind = 'revisit'").select("page_id", "kind", "refers_to", "said")
    first = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("said"), "payload_bytes").distinct()
    return responses.union(later.join(first, ["refers_to", "said"]).select("page_id", "payload_bytes", F.col("said").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))
