"""File discovery and content fingerprints."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import islice

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specmill.functions.spread import dense_position
from specmill.functions.text import base_name
from specmill.session import settled

DOCUMENT_GLOB = "*.pdf"
# Bytes of a file that a task holds while it hashes it.
CHUNK = 1 << 22
LISTED = "argument int, source_file string, length bigint, error string"
NAMES = "source_file string, modified bigint"
# Names that a task which lists a folder hands on at a time.
NAMES_AT_ONCE = 10_000


def fingerprint(content: Column) -> Column:
    """SHA-256 of bytes, or of a text's UTF-8 form, as lower-case hex."""
    return F.sha2(content, 256)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and times of what lies directly in a folder: another value once something there is written anew."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def _kind_of(spark: SparkSession, path: str) -> tuple[str, str]:
    """("folder", "file" or "gone") and the full name of a path, with one look at the file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        found = system.getFileStatus(target)
    except Py4JJavaError as problem:
        if "FileNotFoundException" in problem.java_exception.getClass().getName():
            return "gone", path
        raise
    return ("folder" if found.isDirectory() else "file"), found.getPath().toString()


def discover(spark: SparkSession, paths: Sequence[str], glob: str = DOCUMENT_GLOB) -> DataFrame:
    """Files to process: (argument, source_file, length, error), no contents.

    A folder contributes its direct children matching ``glob`` (case-sensitive); a path
    to a file is taken whatever it is called; a path that is not there becomes
    an error row. Nothing is deduplicated. ``argument`` is the position in ``paths``. All folders are listed by one scan
    and all single files by another, whatever their number.
    """
    kinds: dict[str, list[tuple[int, str]]] = {"folder": [], "file": [], "gone": []}
    for position, path in enumerate(paths):
        kind, full = _kind_of(spark, path)
        kinds[kind].append((position, full))
    gone = [(i, p, None, f"FileNotFoundError: No such file: {p}") for i, p in kinds["gone"]]
    parts = [spark.createDataFrame(gone, LISTED)]
    for kind, options, name in (
        ("folder", {"pathGlobFilter": glob}, F.regexp_replace("source_file", "/[^/]*$", "")),
        ("file", {}, F.col("source_file")),
    ):
        if kinds[kind]:
            reader = spark.read.format("binaryFile").options(recursiveFileLookup="false", **options)
            # Only names and lengths are used, so no file is opened.
            listed = reader.load(sorted({p for _, p in kinds[kind]})).select(F.col("path").alias("source_file"), "length")
            asked = spark.createDataFrame(kinds[kind], "argument int, _asked string")
            found = listed.distinct().withColumn("_asked", name).join(asked, "_asked")
            parts.append(found.select("argument", "source_file", "length", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts)


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(path, whether it is a folder, time of the last change in microseconds) of what lies directly in a folder. Runs in tasks."""
    if folder.startswith("file:"):
        # Entry by entry: the task holds a few names, however many there are.
        with os.scandir("/" + folder.removeprefix("file:").lstrip("/")) as entries:
            for entry in entries:
                try:
                    found = entry.stat()
                except FileNotFoundError:
                    continue  # removed meanwhile, or a link to nothing
                name = os.fsencode(entry.name).decode(errors="replace")
                yield f"{folder}/{name}", stat.S_ISDIR(found.st_mode), found.st_mtime_ns // 1000
        return
    system, place = _reached(folder)
    for found in system.get_file_info(fs.FileSelector(place)):
        yield f"{folder}/{found.base_name}", found.type == fs.FileType.Directory, (found.mtime_ns or 0) // 1000


def _names_below(folder: str) -> Iterator[tuple[str, int]]:
    """Names and times of the files in a folder and in its subfolders named ``key=value``."""
    for path, is_folder, modified in _entries(folder):
        name = path.rsplit("/", 1)[1]
        if not is_folder:
            yield path, modified
        elif "=" in name and not name.startswith("."):
            yield from _names_below(path)


def listed(spark: SparkSession, folder: str, glob: str = DOCUMENT_GLOB) -> DataFrame:
    """(source_file, modified): names of the files in ``folder``, or in all folders of a pattern, that match ``glob``.

    The files that Spark's streaming file source takes: direct children and those of subfolders named ``key=value``, without
    hidden ones. A task lists a folder and hands its names on as they come; none of them reaches the driver.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    matches = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    if matches is None:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {folder}.")
    asked = [(f.getPath().toString(), f.getModificationTime() * 1000, f.isDirectory()) for f in matches]

    def run(batches):
        for batch in batches:
            for path, modified, is_folder in zip(batch["path"], batch["modified"], batch["is_folder"]):
                found = _names_below(path) if is_folder else iter([(path, modified)])
                while names := list(islice(found, NAMES_AT_ONCE)):
                    yield pd.DataFrame(names, columns=["source_file", "modified"])

    asked = spark.createDataFrame(asked, "path string, modified bigint, is_folder boolean")
    names = asked.mapInPandas(run, NAMES)
    name = base_name(F.col("source_file"))
    hidden = (name.startswith("_") & ~F.contains(name, F.lit("="))) | name.startswith(".") | name.endswith("._COPYING_")
    # Hadoop's own reading of the pattern, as the file source's.
    pattern = jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().toString()
    return names.where(name.rlike(rf"(?s)\A(?:{pattern})\z") & ~hidden)


def _reached(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and its name there, as executors reach it."""
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))


def opened(path: str):
    """A stream over the bytes of a file, wherever executors reach it."""
    system, name = _reached(path)
    return system.open_input_stream(name)


def put(folder: str, name: str, data: bytes = b"") -> None:
    """Write a file into a folder, which need not be there yet. Runs in tasks."""
    system, place = _reached(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/{name}") as stream:
        stream.write(data)


def names_in(folder: str) -> list[str]:
    """Names of the files in a folder; none if it is not there. Runs in tasks."""
    system, place = _reached(folder)
    return [found.base_name for found in system.get_file_info(fs.FileSelector(place, allow_not_found=True))]


def read_in_tasks(files: DataFrame, read: Callable, value: str, kind: T.DataType) -> DataFrame:
    """Adds ``value``: what ``read(stream)`` makes of each file that has no ``error`` yet; its failure becomes the ``error``.

    The bytes stay in the task that reads them.
    """
    columns = [c for c in files.columns if c != "error"]
    schema = files.select(*columns, "error").schema.add(value, kind)

    def run(batches):
        for batch in batches:
            made, errors = [], []
            for path, error in zip(batch["source_file"], batch["error"]):
                result = None
                if error is None:
                    try:
                        with opened(path) as stream:
                            result = read(stream)
                    except Exception as problem:  # noqa: BLE001 - a bad file is a row, not a crash
                        error = f"{type(problem).__name__}: {problem}"
                made.append(result)
                errors.append(error)
            out = batch[columns].copy()
            out["error"] = pd.Series(errors, index=out.index, dtype=object)
            out[value] = pd.Series(made, index=out.index, dtype=object)
            yield out

    # Names are few bytes each: without dealing them out anew, one task would read all files.
    spread = files.repartition(files.sparkSession.sparkContext.defaultParallelism, "source_file")
    return spread.mapInPandas(run, schema)


def _digest(stream) -> str:
    made = hashlib.sha256()
    while chunk := stream.read(CHUNK):
        made.update(chunk)
    return made.hexdigest()


def fingerprinted(files: DataFrame) -> DataFrame:
    """Adds ``source_hash``, read in pieces: a file of any length is hashed, and its bytes go nowhere."""
    return read_in_tasks(files, _digest, "source_hash", T.StringType())


def in_arrival_order(files: DataFrame) -> DataFrame:
    """Adds ``seq``: position in the order (argument, source_file), from 0 without gaps.

    The rows are written first: a sort reads its input twice, and the second time would list and hash all files again.
    The sorted rows get their provisional numbers while they are written out, so that a
    partition computed again can no longer change them.
    """
    ordered = settled(files, "listed").orderBy("argument", "source_file").withColumn(
        "_at", F.monotonically_increasing_id()
    )
    numbered = dense_position(settled(ordered, "arrivals"), "_at", "seq")
    return settled(numbered.withColumn("seq", F.col("seq") - 1).drop("_at"), "numbered")
