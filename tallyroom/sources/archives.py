"""ZIP members. Spark cannot read inside a ZIP, so members stream in Python
tasks, one archive at a time; what they yield is plain rows again."""

from __future__ import annotations

import codecs
import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Safety bounds of an archive and of its member.
MAX_ARCHIVE_BYTES = 32 * 1024 * 1024
MAX_MEMBER_BYTES = 256 * 1024 * 1024
MAX_RATIO = 100
BLOCK_BYTES = 4 * 1024 * 1024
#: Archives that stand beside their Arrow batch as Python objects.
PACKED_ROWS = 64


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, content)``; oversized archives keep no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.when(F.col("length") <= MAX_ARCHIVE_BYTES, F.col("content")).alias("content"))


def _problem(archive: zipfile.ZipFile, member: str) -> str | None:
    names = archive.namelist()
    if names != [member]:
        return "member set differs"
    info = archive.getinfo(member)
    if info.file_size > MAX_MEMBER_BYTES:
        return "member too large"
    if info.file_size > MAX_RATIO * max(info.compress_size, 1):
        return "compression ratio too high"
    return None


def inspect_archives(archives: DataFrame) -> DataFrame:
    """``archives(path, content, member)`` to one row per archive: the member's
    size and digest, never the container's, or the reason it is refused."""
    schema = "path string, member string, member_bytes long, member_sha256 string, reason string"

    def inspected(content: bytes, member: str) -> tuple[int | None, str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                reason = _problem(archive, member)
                if reason is not None:
                    return None, None, reason
                size, digest = 0, hashlib.sha256()
                with archive.open(member) as stream:
                    while block := stream.read(BLOCK_BYTES):
                        size += len(block)
                        digest.update(block)
                return size, digest.hexdigest(), None
        except zipfile.BadZipFile:
            return None, None, "not an archive"

    def inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Archives stay in the batch: one at a time is copied out.
            out = [
                inspected(content.as_buffer(), member) if content.is_valid else (None, None, "archive too large")
                for content, member in zip(batch.column("content"), batch.column("member").to_pylist())
            ]
            size, digest, reason = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), batch.column("member"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(reason, pa.string())],
                names=["path", "member", "member_bytes", "member_sha256", "reason"],
            )

    return archives.select("path", "content", "member").mapInArrow(inspect, schema)


def member_blocks(archives: DataFrame, encoding: str = "utf-8", fallback: str | None = None) -> DataFrame:
    """Accepted members as blocks of whole lines ``(path, block, text, reason)``, so a
    large member becomes many rows of bounded size. A member that is not valid in
    ``encoding`` as a whole is read in ``fallback`` as a whole; a byte-order mark
    is dropped. A refused archive gives one row with its reason."""
    schema = "path string, block long, text string, reason string"

    def readable(archive: zipfile.ZipFile, member: str, name: str) -> bool:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with archive.open(member) as stream:
                while chunk := stream.read(BLOCK_BYTES):
                    decoder.decode(chunk)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return False
        return True

    def row(path: str, number: int | None, text: str | None, reason: str | None = None) -> pd.DataFrame:
        return pd.DataFrame({
            "path": [path], "block": pd.array([number], "Int64"), "text": pd.Series([text], dtype=object),
            "reason": pd.Series([reason], dtype=object),
        })

    def members(path: str, content: bytes, member: str):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            reason = _problem(archive, member)
            if reason is not None:
                yield row(path, None, None, reason)
                return
            name = next((n for n in (encoding, fallback) if n and readable(archive, member, n)), None)
            if name is None:
                yield row(path, None, None, "text is not in the declared encoding")
                return
            with archive.open(member) as stream:
                number, rest = 0, b""
                while chunk := stream.read(BLOCK_BYTES):
                    head, cut, rest = (rest + chunk).rpartition(b"\n")
                    if cut:
                        yield row(path, number, head.decode(name).removeprefix("\ufeff") if number == 0 else head.decode(name))
                        number += 1
                if rest:
                    yield row(path, number, rest.decode(name).removeprefix("\ufeff") if number == 0 else rest.decode(name))

    def blocks(batches):
        for batch in batches:
            for path, content, member in zip(batch["path"], batch["content"], batch["member"]):
                if content is None:
                    yield row(path, None, None, "archive too large")
                    continue
                try:
                    yield from members(path, content, member)
                except zipfile.BadZipFile:
                    yield row(path, None, None, "not an archive")

    return archives.select("path", "content", "member").mapInPandas(blocks, schema)


@F.arrow_udf(T.BinaryType())
def pack_member(names: pa.Array, texts: pa.Array) -> pa.Array:
    """A one-member archive of a text, stored uncompressed."""

    def pack(name: str, text: pa.StringScalar) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.as_buffer().to_pybytes())
        return buffer.getvalue()

    parts = [pa.array([], pa.binary())]
    for at in range(0, len(texts), PACKED_ROWS):
        here = zip(names.slice(at, PACKED_ROWS).to_pylist(), texts.slice(at, PACKED_ROWS))
        parts.append(pa.array([pack(n, t) for n, t in here], pa.binary()))
    return pa.concat_arrays(parts)
