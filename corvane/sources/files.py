"""File listings as source tables, and a batch/stream data source that lists files by name."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import file_uri
from corvane.session import cut_lineage

EXTENSIONS = (".md", ".txt")  # fixed value: what a plain listing takes
HASH_BLOCK = 64 * 1024  # fixed value: bytes that are hashed at a time


def _wanted(path, extensions: Sequence[str], ignore_case: bool):
    name = F.lower(path) if ignore_case else path
    found = F.lit(False)
    for ext in extensions:
        found = found | F.endswith(name, F.lit(ext.lower() if ignore_case else ext))
    return found


TASK_BYTES = 128 << 20  # of files that one task hashes, about


def discover(
    spark: SparkSession, paths: Sequence[str], *, label: str = "", extensions: Sequence[str] = EXTENSIONS,
    ignore_case: bool = False, with_content: bool = False, known: DataFrame | None = None,
) -> DataFrame:
    """``uri, label, content_hash, mtime, size`` of the files at or below ``paths``, and their ``content`` if asked for.

    The suffix test is case-sensitive by default. Names, sizes and times are listed without opening a file. A
    file that ``known`` (an earlier result) has with the same size and time keeps its hash; all others are dealt to tasks and
    hashed block by block, whatever their size. With ``content``, whole files are read by Spark's reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    kept = files.where(_wanted(F.col("path"), extensions, ignore_case))
    local = file_uri(F.regexp_replace(F.col("path"), r"^file:/*", "/"))
    # a path of another file system is a URI already; only local ones are spelled anew
    uri = F.when(F.col("path").rlike(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*:"), F.col("path")).otherwise(local)
    mtime = F.unix_micros("modificationTime").cast("double").__truediv__(1e6)
    listed = kept.select(uri.alias("uri"), F.lit(label).alias("label"), mtime.alias("mtime"), F.col("length").alias("size"), "path", *(["content"] if with_content else []))
    if with_content:
        return listed.select("uri", "label", F.sha2("content", 256).alias("content_hash"), "mtime", "size", "content")
    if known is not None:
        same = known.select("uri", "mtime", "size", F.col("content_hash").alias("known_hash"))
        listed = cut_lineage(listed.join(same, ["uri", "mtime", "size"], "left"))
        old = listed.where(F.col("known_hash").isNotNull()).select("uri", "label", F.col("known_hash").alias("content_hash"), "mtime", "size")
        return old.unionByName(hashed(listed.where(F.col("known_hash").isNull())))
    return hashed(listed)


def hashed(listed: DataFrame) -> DataFrame:
    """Adds ``content_hash`` to listed files; as many tasks as their bytes ask for, a flat folder's files too."""
    spark = listed.sparkSession
    shape = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(shape["n"], max(spark.sparkContext.defaultParallelism, -(-shape["bytes"] // TASK_BYTES))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sha256_of(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("uri"), batch.column("label"), found, batch.column("mtime"), batch.column("size")], ["uri", "label", "content_hash", "mtime", "size"])

    dealt = listed.select("uri", "label", "mtime", "size", "path").repartition(tasks)
    return dealt.mapInArrow(run, "uri string, label string, content_hash string, mtime double, size long")


def opened(path: str):
    """A stream over a file, on whatever file system its path names."""
    from pyarrow import fs

    name = re.sub("^file:/*", "/", path)
    files, name = (fs.LocalFileSystem(), name) if name.startswith("/") else fs.FileSystem.from_uri(path)
    return files.open_input_stream(name)


def sha256_of(path: str) -> str:
    digest = hashlib.sha256()
    with opened(path) as stream:
        while block := stream.read(HASH_BLOCK):
            digest.update(block)
    return digest.hexdigest()


def read_documents(spark: SparkSession, paths: Sequence[str], **options) -> DataFrame:
    """A listing with decoded text; a file that cannot be read is listed with an ``error`` and no text."""
    from corvane.operators.extract import extract_text

    files = discover(spark, paths, with_content=True, **options)
    return extract_text(files)
