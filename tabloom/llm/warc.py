"""WARC files and their Merkle fixity audit.

Writing: records of a table in order, each a WARC/1.1 response in a gzip
member of its own, in one file a range of page ids; the manifest keeps each
record's place and the SHA-256 of its bytes.

Tree: the records of a file, in the order of their offsets, are leaves; every
``fan`` neighbours give a node whose digest covers the children's digests and
the offset range they span, up to one root a file.

Scan: each record is read at its offset and length in the manifest, so damage
to one never hides those behind it.

Audit: roots of two replicas are compared; below, only children of nodes that
differ are compared, level by level, so intact branches are never descended.
What is left are the corrupt, missing or foreign records.

Defined results: null url or html counts as empty; rows of one page_id are
records of their own; an unreadable record has a null digest and counts as
corrupt; an empty table gives no file and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_path, file_parts, scratch_path, ship_package, written

FAN = 64
MANIFEST = "page_id long, file string, seq long, offset long, length long, record_bytes long, sha256 string"
FOUND = "file string, seq long, offset long, length long, record_bytes long, sha256 string"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """One record, deterministic: its id comes from the page id, its date is fixed."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\n"
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}\r\n"
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        "WARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    )
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record is shorter than it says")
    return fields, rest[:n]


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def _write(batches, folder: str, damage=None):
    """One file a task, under a name of its own, so a repeated task cannot spoil another's file."""
    out, at, seq, name = None, 0, 0, ""
    for batch in batches:
        rows = []
        for page_id, url, page in zip(batch["page_id"].to_pylist(), batch["url"], batch["html"]):
            if out is None:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = record(page_id, url.as_py(), page.as_py())
            packed = _gz(data)
            out.write(packed if damage is None else damage(page_id, packed))
            rows.append((page_id, name, seq, at, len(packed), len(data), hashlib.sha256(data).hexdigest()))
            at += len(packed)
            seq += 1
        if rows:
            yield _rows(rows, MANIFEST)
    if out is not None:
        out.close()


def _rows(rows, schema: str) -> pa.RecordBatch:
    names = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if t == "string" else pa.int64()) for c, (_, t) in zip(cols, names)], names=[n for n, _ in names])


def _unpacked(packed: bytes) -> bytes | None:
    """The record of one member; None unless it is one whole member with a right checksum."""
    d = zlib.decompressobj(31)
    try:
        data = d.decompress(packed)
    except zlib.error:
        return None
    return data if d.eof and not d.unused_data else None


def _foreign(f, name: str, at: int, seq: int):
    """What a file holds behind its last record of the manifest; a member that doesn't unpack ends it, as its end is unknown."""
    f.seek(at)
    held = f.read(1 << 20)
    while held:
        d, parts, took = zlib.decompressobj(31), [], 0
        while held and not d.eof:
            n = len(held)
            try:
                parts.append(d.decompress(held))
            except zlib.error:
                break
            held = d.unused_data if d.eof else f.read(1 << 20)
            took += n - len(held) if d.eof else n
        data = b"".join(parts)
        yield (name, seq, at, took, len(data), hashlib.sha256(data).hexdigest()) if d.eof else (name, seq, at, took, None, None)
        if not d.eof:
            break
        at, seq = at + took, seq + 1
        held = held or f.read(1 << 20)


def _read(batches, folder: str):
    """Hash each record at its place in the manifest, so that a damaged one hides no other."""
    store, root = _store(folder)
    f, opened = None, None
    for batch in batches:
        rows = []
        for name, seq, offset, length, last in zip(*(batch[c].to_pylist() for c in ("file", "seq", "offset", "length", "last"))):
            if name != opened:
                if f is not None:
                    f.close()
                f, opened = io.BufferedReader(store.open_input_file(f"{root}/{name}"), 1 << 20), name
            f.seek(offset)
            packed = f.read(length)
            if packed:  # nothing at all: the file is cut off and the record is missing
                data = _unpacked(packed)
                rows.append((name, seq, offset, len(packed), None, None) if data is None else (name, seq, offset, len(packed), len(data), hashlib.sha256(data).hexdigest()))
            if seq == last:
                rows += _foreign(f, name, offset + length, seq + 1)
        if rows:
            yield _rows(rows, FOUND)
    if f is not None:
        f.close()


def write_warc(pages: DataFrame, folder: str, partitions: int | None = None, damage=None) -> DataFrame:
    """Write the files; gives the manifest of the sound records, one row each.

    ``damage`` (page_id, member) -> member of the same length spoils the bytes
    on their way to the file, as a bad disk would.
    """
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    n = partitions or file_parts(pages)
    rows = rows.repartitionByRange(n, "page_id").sortWithinPartitions("page_id")
    return written(rows.mapInArrow(partial(_write, folder=folder, damage=damage), MANIFEST), "manifest")


def scan_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Places and digests of the records that the files hold now; a file may be read by several tasks."""
    ship_package(manifest.sparkSession)
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = manifest.groupBy("file").agg(F.max("seq").alias("last"))
    places = manifest.select("file", "seq", "offset", "length").join(last, "file")
    places = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return written(places.mapInArrow(partial(_read, folder=folder), FOUND), "found")


def tree(records: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels of the Merkle trees, leaves first: file, node, digest, start, stop, leaves."""
    leaf = records.select("file", F.col("seq").alias("node"), F.coalesce("sha256", F.lit("")).alias("digest"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("stop"), F.lit(1).cast("long").alias("leaves"))
    levels = [leaf]
    width = records.agg(F.max("seq")).first()[0]
    width = 0 if width is None else width + 1
    while width > 1:
        child = F.sort_array(F.collect_list(F.struct("node", "digest", "start", "stop")))  # at most ``fan`` of a node
        text = F.array_join(F.transform(child, lambda c: F.concat_ws(":", c["digest"], c["start"], c["stop"])), "|")
        up = levels[-1].groupBy("file", F.floor(F.col("node") / fan).alias("node"))
        up = up.agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("leaves").alias("leaves"))
        levels.append(written(up, "tree"))
        width = (width + fan - 1) // fan
    return levels


def audit(a: list[DataFrame], b: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Leaves that differ between two replicas: file, node."""
    depth = max(len(a), len(b))
    differ = None
    for level in range(depth - 1, -1, -1):
        sides = []
        for t in (a, b):
            # A replica whose longest file is much shorter has fewer levels; a missing level has no nodes.
            nodes = t[level] if level < len(t) else t[-1].where("false")
            nodes = nodes.select("file", "node", F.concat_ws(":", "digest", "start", "stop").alias("digest"))
            if differ is not None:
                nodes = nodes.withColumn("parent", F.floor(F.col("node") / fan)).join(differ.select("file", F.col("node").alias("parent")), ["file", "parent"], "left_semi").drop("parent")
            sides.append(nodes)
        both = sides[0].withColumnRenamed("digest", "da").join(sides[1].withColumnRenamed("digest", "db"), ["file", "node"], "full_outer")
        differ = written(both.where(~F.col("da").eqNullSafe(F.col("db"))).select("file", "node"), f"differ{level}")
    return differ


def fixity(manifest: DataFrame, found: DataFrame, fan: int = FAN) -> DataFrame:
    """One row a record of the manifest, with ``intact``."""
    bad = audit(tree(manifest, fan), tree(found, fan), fan).select("file", F.col("node").alias("seq"), F.lit(False).alias("__ok"))
    return manifest.join(bad, ["file", "seq"], "left").withColumn("intact", F.coalesce("__ok", F.lit(True))).drop("__ok")


def flip_some(page_id: int | None, packed: bytes) -> bytes:
    """The planted fault of the registered query: one bit, in the file, of each record whose page id is 13 modulo 97."""
    if page_id is None or page_id % 97 != 13:
        return packed
    sound = _unpacked(packed)
    for at in range(len(packed) // 2, len(packed)):  # the first that tells: a copy from another distance may be equal
        spoilt = bytearray(packed)
        spoilt[at] ^= 1
        if _unpacked(bytes(spoilt)) != sound:
            break
    return bytes(spoilt)


def write_and_audit(pages: DataFrame, damage=None) -> DataFrame:
    """page_id, record_bytes, record_sha256 (as written), intact, and the place in the files."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, folder, damage=damage)
    out = fixity(manifest, scan_warc(manifest, folder))
    return out.select("page_id", "record_bytes", F.col("sha256").alias("record_sha256"), "intact")


def remove(spark, folder: str) -> None:
    drop_path(spark, folder)


def order_check(manifest: DataFrame) -> DataFrame:
    """Records whose offset isn't where the one before ends; none in a sound manifest."""
    before = Window.partitionBy("file").orderBy("seq")
    return manifest.withColumn("due", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(before), F.lit(0))).where("offset <> due")
