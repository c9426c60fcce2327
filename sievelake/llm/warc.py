"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are written by Spark's text writer, a few files per task. Reading splits the files at the record
magic, wherever it stands, so every split of a plain file is read by its own task. A fragment that begins with
a whole header says where its successor would begin. Pointer jumping from the start of each file keeps
the fragments that the chain of successors reaches; magic inside a payload begins a fragment that
nothing reaches, and its bytes go back to the record they stand in.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ARROW_ROWS, freed_shuffles, kept, setting
from sievelake.session import scratch_path

MAGIC = "WARC/1.0\r\n"
_GAP = b"\r\n\r\n"

#: Records in a file at most, which bounds what one task reads of a compressed archive.
FILE_RECORDS = 1 << 16

#: Fragments that a Python worker gets at once.
BATCH_ROWS = "256"

#: Digits of base 32 as conv() and as the digest writes them.
_CONV_DIGITS, _DIGEST_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: forty bits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), _CONV_DIGITS, _DIGEST_DIGITS)


def record_kinds(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages with payload, payload_bytes, payload_digest, record_type and refers_to.

    Among equal payloads of at least ``least_bytes`` bytes the record with the largest page_id is the
    response (one of them, if several rows have it; null is the smallest id). Equal means the same
    SHA-1 and length, as the standard's revisit profile has it.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("payload_digest", digest32(F.col("payload").cast("binary")))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    repeated = rows.groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes")).agg(
        F.max(F.struct("page_id", "_row")).alias("_first"), F.count("*").alias("_copies")
    )
    # payloads stream past the table of repeated digests, so that no sort holds them
    repeated = repeated.where("_copies > 1").drop("_copies").hint("shuffle_hash")
    same = (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    rows = rows.join(repeated, same, "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & F.coalesce(F.col("_first._row") != F.col("_row"), F.lit(False))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    rows = rows.withColumn("refers_to", F.when(revisit, F.col("_first.page_id")))
    return rows.drop("_digest", "_bytes", "_first", "_row")


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def write(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "none") -> None:
    """Write one record per page (page_id, url, html) below ``path``, in files of at most FILE_RECORDS records.

    A compressed file takes less of the disk, but is read by one task; others are read in splits.

    A null html is an empty payload. Line breaks in a url become spaces, a null page_id or url leaves its
    header out. A revisit has no content block; its payload's length stands in a header of its own.
    """
    rows = record_kinds(pages, least_bytes)
    response = F.col("record_type") == "response"
    content = F.when(response, F.col("payload")).otherwise("")
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Length", F.octet_length(content)),
        F.lit("\r\n"),
        content,
    )
    writer = rows.select(record.alias("value")).write.option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("lineSep", _GAP.decode()).option("compression", compression).text(path)


_FIELD = re.compile(rb"(?:\A|\r\n)([A-Za-z-]+): ?([^\r]*)")

FRAGMENT = """_file string, _block long, _part long, _skip long, _size long, _kind string, _page long, _uri string,
    _digest string, _payload_bytes long, _refers long, _header long, _content long, _sha string"""


def _parse(fragment: bytes) -> tuple:
    """What a fragment's header says; Nones when it has none. The magic isn't part of the fragment."""
    end = fragment.find(_GAP)
    if end < 0:
        return (None,) * 9
    fields = {k.lower(): v for k, v in _FIELD.findall(fragment[:end])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return (None,) * 9

    def number(name):
        found = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(name, b""))
        return int(found[1]) if found else None

    size = fields.get(b"x-payload-length", b"")
    content = fragment[end + 4 : end + 4 + int(length)]
    sha = None
    if len(content) == int(length):
        sha = base64.b32encode(hashlib.sha1(content).digest()).decode()
    return (
        fields.get(b"warc-type", b"").decode("utf-8", "replace") or None,
        number(b"warc-record-id"),
        fields.get(b"warc-target-uri", b"").decode("utf-8", "replace") or None,
        fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:") or None,
        int(size) if size.isdigit() else None,
        number(b"warc-refers-to"),
        end + 4,
        int(length),
        sha,
    )


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, text): what stands after each magic, and what stands before the first."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    meta = F.col("_metadata")
    return rows.select(
        meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.col("value").cast("binary").alias("_text")
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every fragment with its offset in the file (that of its magic), its size and its successor."""

    def scan(batches):
        at: dict[tuple, list[int]] = {}
        for batch in batches:
            rows = []
            for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", "_text"))):
                held = at.setdefault((file, block), [0, 0])
                rows.append((file, block, held[0], held[1], len(text), *_parse(text)))
                held[0] += 1
                held[1] += len(text) + len(MAGIC)
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)

    with setting(spark, ARROW_ROWS, BATCH_ROWS):
        found = kept(_fragments(spark, path).mapInArrow(scan, FRAGMENT), "fragments")
    # a split begins where the one before has ended; a file's first fragment stands before its first magic
    ends = found.groupBy("_file", "_block").agg(F.sum(F.col("_size") + len(MAGIC)).alias("_bytes"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_file", "_block", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"))
    offset = F.col("_before") + F.col("_skip") - len(MAGIC)
    rows = found.join(ends, ["_file", "_block"]).withColumn("_at", offset).drop("_before", "_skip")
    return rows.withColumn("_next", F.col("_at") + len(MAGIC) + F.col("_header") + F.col("_content") + len(_GAP))


_NAMES = [part.split()[0] for part in FRAGMENT.split(",")]
_ARROW = pa.schema([(part.split()[0], {"long": pa.int64(), "string": pa.string()}[part.split()[1]]) for part in FRAGMENT.split(",")])


def reachable(links: DataFrame) -> DataFrame:
    """(file, at) of what the chain at -> next reaches from offset 0 of each file, by pointer jumping.

    Each round doubles the length of the jumps, so a file of n records takes about log2(n) rounds; every
    round is written to the shared folder.
    """
    jump = links.where("_next IS NOT NULL").select("_file", "_at", F.col("_next").alias("_to"))
    places = links.select("_file", F.col("_at").alias("_to"))
    jump = kept(jump.join(places, ["_file", "_to"]).select("_file", "_at", "_to"), "jumps")
    reached = kept(links.where("_at = 0").select("_file", "_at"), "reached")
    while not jump.isEmpty():
        step = reached.join(jump, ["_file", "_at"]).select("_file", F.col("_to").alias("_at"))
        reached = kept(reached.unionByName(step).distinct(), "reached")
        after = jump.select("_file", F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        jump = kept(jump.join(after, ["_file", "_to"]).select("_file", "_at", F.col("_far").alias("_to")), "jumps")
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of every record of the archives.

    The length and digest of a response are those of the bytes read; a revisit gives what its headers
    say of the payload. A record counts when a record or the end of its file follows where it ends. A file
    that doesn't begin with a record gives none; a chain that breaks ends before the broken record.
    """
    rows = candidates(spark, path)
    found = kept(reachable(rows.select("_file", "_at", "_next")), "records")
    place = Window.partitionBy("_file").orderBy("_at")
    marked = rows.join(found.withColumn("_real", F.lit(True)), ["_file", "_at"], "left")
    marked = marked.withColumn("_owner", F.last(F.when(F.col("_real"), F.col("_at")), ignorenulls=True).over(place))
    end = F.max(F.col("_at") + len(MAGIC) + F.col("_size")).over(Window.partitionBy("_file"))
    marked = kept(marked.withColumn("_end", end), "owned")
    real = marked.where("_real").withColumn("_after", F.coalesce(F.lead("_at").over(place), F.col("_end")))
    real = real.where("_next = _after")

    # records whose payload holds the magic: their bytes are put together from several fragments
    torn = real.where("_sha IS NULL").select("_file", F.col("_at").alias("_owner"), "_header", "_content")
    # stored, so that Spark knows its size and moves the archives' bytes only where it is large
    pieces = kept(marked.select("_file", "_owner", "_block", "_part", "_at").join(torn, ["_file", "_owner"]), "torn")
    texts = _numbered(spark, path)
    pieces = texts.join(pieces, ["_file", "_block", "_part"])
    joined = pieces.groupBy("_file", "_owner", "_header", "_content").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_texts")
    )
    whole = F.aggregate(
        F.slice("_texts", 2, F.greatest(F.size("_texts") - 1, F.lit(0))),
        F.col("_texts")[0]["_text"],
        lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x["_text"]),
    )
    payload = F.substring(whole, F.col("_header").cast("int") + 1, F.col("_content").cast("int"))
    mended = joined.select(
        "_file", F.col("_owner").alias("_at"), F.octet_length(payload).cast("long").alias("_mended_bytes"), digest32(payload).alias("_mended")
    )
    with setting(spark, ARROW_ROWS, BATCH_ROWS):
        mended = kept(mended, "mended")
    real = real.join(mended, ["_file", "_at"], "left")
    response = F.col("_kind") == "response"
    return real.select(
        F.col("_page").alias("page_id"),
        F.col("_uri").alias("url"),
        F.col("_kind").alias("record_type"),
        F.when(response, F.coalesce("_mended_bytes", "_content")).otherwise(F.col("_payload_bytes")).alias("payload_bytes"),
        F.when(response, F.coalesce("_mended", "_sha")).otherwise(F.col("_digest")).alias("payload_digest"),
        F.col("_refers").alias("refers_to"),
    )


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The fragments once more, with their number in their split."""

    def number(batches):
        at: dict[tuple, int] = {}
        for batch in batches:
            numbers = []
            for key in zip(batch.column("_file").to_pylist(), batch.column("_block").to_pylist()):
                numbers.append(at.get(key, 0))
                at[key] = numbers[-1] + 1
            yield batch.append_column("_part", pa.array(numbers, pa.int64()))

    return _fragments(spark, path).mapInArrow(number, "_file string, _block long, _text binary, _part long")


def round_trip(pages: DataFrame, least_bytes: int = 0, compression: str = "gzip") -> DataFrame:
    """The records read back from archives written into the shared folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    with freed_shuffles(spark):
        write(pages, path, least_bytes, compression)
    return read(spark, path)
