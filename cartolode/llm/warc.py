"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_dir, new_path, remove_dir, save, small, table

#: Pages carry no time of capture; records get this one unless the caller names another, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
FILE = "shard long, seq int, tmp string, name string, records long, bytes long, digest string"
#: Bytes of an archive that are read at a time.
STEP = 1 << 16


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """The same for the same page, url and payload, whichever file it stands in."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _plain_uri(url: str) -> str:
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url)


def _member(head: list[str], block: bytes) -> bytes:
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _info(name: str, date: str) -> bytes:
    """The record that opens a file and names it."""
    block = b"software: cartolode\r\nformat: WARC File Format 1.1\r\n"
    ident = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo|{name}")
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{ident}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member([*head, f"Content-Length: {len(block)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"], block)


def _record(row: dict, date: str) -> bytes:
    """One gzip member: a WARC response or revisit record with regenerated headers and digests."""
    payload, digest = row["payload"], base64.b32encode(bytes.fromhex(row["digest"])).decode()
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {record_id(row['page_id'], row['url'], digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _plain_uri(row["url"]))
    if row["page_id"] is not None:
        head.append(f"X-Page-Id: {row['page_id']}")
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(row['refers_to'], row['refers_url'], digest)}",
            f"WARC-Refers-To-Date: {date}",
            f"X-Refers-To-Page-Id: {row['refers_to']}",
        ]
        if row["refers_url"] is not None:
            head.append("WARC-Refers-To-Target-URI: " + _plain_uri(row["refers_url"]))
    return _member(head, block)


def file_name(shard: int, seq: int) -> str:
    return f"part-{shard:08d}-{seq:05d}.warc.gz"


def _writer(out: str, roll_bytes: int, date: str):
    """A mapInArrow function: rows arrive in order of shard; each shard rolls files by their compressed size."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{base}/tmp", recursive=True)
        attempt, shard, seq, f, done = uuid.uuid4().hex, None, 0, None, []

        def put(data: bytes) -> None:
            f["file"].write(data)
            f["sha"].update(data)
            f["size"] += len(data)

        def close() -> None:
            nonlocal f
            if f:
                f["file"].close()
                done.append({"shard": shard, "seq": seq, "tmp": f["tmp"], "name": file_name(shard, seq), "records": f["n"], "bytes": f["size"], "digest": f["sha"].hexdigest()})
            f = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, seq = row["shard"], 0
                elif f and f["size"] >= roll_bytes:
                    close()
                    seq += 1
                if not f:
                    tmp = f"{attempt}-{shard}-{seq}"
                    f = {"tmp": tmp, "file": fs.open_output_stream(f"{base}/tmp/{tmp}"), "n": 0, "size": 0, "sha": hashlib.sha1()}
                    put(_info(file_name(shard, seq), date))
                put(_record(row, date))
                f["n"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(done).astype({"seq": "int32"}), preserve_index=False)

    return write


def _mover(out: str):
    """Commit: move each file of the manifest to its final name. Where a retried task finds its file moved, it goes on; what
    else bears the name, from an earlier writer into the folder, is replaced."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(f"{base}/data", recursive=True)
        for b in batches:
            for tmp, name in zip(b["tmp"], b["name"]):
                if fs.get_file_info(f"{base}/tmp/{tmp}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/tmp/{tmp}", f"{base}/data/{name}")
            yield b[["name", "records"]]

    return move


def write_warc(pages: DataFrame, out: str, roll_bytes: int = 16 << 20, shard_bytes: int = 64 << 20, min_shards: int = 64, min_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write one record per row of pages(page_id, url, html) under the folder out; return the manifest, one row per file.

    Equal payloads of at least min_bytes bytes: the row or rows with the largest page_id are responses, the others
    revisit it. A shard is a fixed range of page_id, as many as bytes over shard_bytes ask for (ranges that hold far
    more than that are cut again), so the same rows give the same files however Spark deals them out; within a shard
    records are sorted by page_id, digest and url and files roll by compressed size. Files are written under temporary
    names; the manifest, a table in the folder `manifest` of out that Spark commits whole, names those of the attempts
    that count with their digests, and they are then renamed and the other attempts' removed. Only what the manifest
    names is ever read. A folder is written once: another run needs another.

    Null html is an empty payload; a null page_id gets no id header and is dealt by digest; rows that repeat are written
    as often as they occur; an empty table gives an empty manifest; other columns are ignored.
    """
    spark = pages.sparkSession
    make_dir(spark, f"{out}/data")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    light = save(rows.select("page_id", "url", "digest", "size"), "digests")
    groups = light.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("keeper"), F.count("*").alias("n"))
    keepers = save(groups.where("n > 1 and keeper is not null").select("digest", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("refers_url")), "keepers")
    span = light.agg(F.min("page_id"), F.max("page_id"), F.coalesce(F.sum("size"), F.lit(0))).first()
    low, high, total = span[0] or 0, span[1] or 0, span[2]
    shards = max(min_shards, -(-total // shard_bytes))
    width = (high - low) // shards + 1
    first = F.floor((F.col("page_id") - low) / F.lit(width))
    cut = small(
        save(
            light.where("page_id is not null").groupBy(first.alias("first")).agg(F.sum("size").alias("s")).where(F.col("s") > 4 * shard_bytes)
            .select("first", F.ceil(F.col("s") / shard_bytes).alias("cuts")),
            "cuts",
        )
    )
    inner = F.floor(((F.col("page_id") - low) - F.col("first") * width) * F.col("cuts") / F.lit(width))
    spread = F.pmod(F.xxhash64("digest", "url"), F.lit(shards))
    rows = rows.join(small(keepers), "digest", "left").withColumn("first", first).join(cut, "first", "left")
    rows = rows.select(
        F.when(F.col("page_id").isNull(), 1_000_000 * shards + spread).otherwise(F.col("first") * 1_000_000 + F.coalesce(inner, F.lit(0))).alias("shard"),
        "page_id", "url", "payload", "digest",
        F.when((F.col("size") >= min_bytes) & (F.coalesce(F.col("page_id") != F.col("keeper"), F.col("keeper").isNotNull())), "revisit").otherwise("response").alias("record_type"),
        F.col("keeper").alias("refers_to"), "refers_url",
    )
    ordered = rows.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")
    ordered.mapInArrow(_writer(out, roll_bytes, date), FILE).write.parquet(f"{out}/manifest")
    manifest = _manifest(spark, out)
    moved = manifest.repartition(8).mapInPandas(_mover(out), "name string, records long")
    moved.agg(F.sum("records")).first()
    remove_dir(spark, f"{out}/tmp")
    return manifest.drop("tmp")


def _manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(f"{out}/manifest")


def _members(file, sha, step: int = STEP) -> Iterator[bytes]:
    """The records of an archive, read piece by piece; sha takes in every byte."""
    inflate, parts = zlib.decompressobj(wbits=31), []
    while piece := file.read(step):
        sha.update(piece)
        while piece:
            parts.append(inflate.decompress(piece))
            piece = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(wbits=31), []
    if parts:
        raise ValueError("the archive ends within a record")


def _parse(record: bytes) -> dict | None:
    """The fields of a response or revisit record, digests checked; None for the record that opens a file."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(h["Content-Length"])]
    if "sha1:" + base32_sha1(block) != h["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {h['WARC-Record-ID']}")
    if h["WARC-Type"] == "warcinfo":
        return None
    payload = block.partition(b"\r\n\r\n")[2]
    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload digest differs in {h['WARC-Record-ID']}")
    number = lambda k: int(h[k]) if k in h else None
    return {"page_id": number("X-Page-Id"), "payload_bytes": number("X-Payload-Length"), "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-Id"), "url": h.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


def _read(out: str, fields: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(out)
        for b in batches:
            for name, want, digest in zip(*(b.column(c).to_pylist() for c in ("name", "records", "digest"))):
                rows, size, count, sha = [], 0, 0, hashlib.sha1()
                with fs.open_input_stream(f"{base}/data/{name}", compression=None) as file:
                    for member in _members(file, sha):
                        row = _parse(member)
                        if row is None:
                            continue
                        count += 1
                        rows.append({f: row[f] for f in fields.names})
                        size += len(row["payload"] or b"") if "payload" in fields.names else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, fields)
                            rows, size = [], 0
                if count != want or sha.hexdigest() != digest:
                    raise ValueError(f"{name} is not the file that the manifest names")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, fields)

    return read


def read_warc(spark: SparkSession, out: str, payloads: bool = False, per_task: int = 4) -> DataFrame:
    """All records of the files that the manifest of out names, about per_task files a task; other files are passed over.

    Record digests, file digests and record counts are checked, and a file that is missing, cut short or changed is an
    error. With payloads also url and payload (null for revisits).
    """
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = RECORD
    if payloads:
        kinds, schema = [*kinds, ("url", pa.string()), ("payload", pa.binary())], f"{RECORD}, url string, payload binary"
    files = _manifest(spark, out).select("name", "records", "digest")
    return files.repartition(max(1, -(-files.count() // per_task)), "name").mapInArrow(_read(out, pa.schema(kinds)), schema)


def op9_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out)
