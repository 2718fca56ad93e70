"""Log files of a directory: listing and line readers for text, gzip and tar+gzip files."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence
from itertools import accumulate

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F

from hitledger import session
from hitledger.operators.ledger import ARCHIVE, GZIP, TEXT

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy of this package

LINES = "source string, file string, line string, error string"
BLOCKS = "source string, file string, block binary, error string"
BLOCK_BYTES = 4 * 2**20
TASK_BYTES = 64 * 2**20  # compressed bytes of the files that share a task
FILE_BYTES = 2**17  # what opening a file counts beside its size: at most 512 files share a task
CHECK_BYTES = 2**20  # at each end of what was read of a growing file
LISTING_PARTS = 64  # parts in which running sums over a listing are taken


def as_listing(files: DataFrame) -> DataFrame:
    """Name, path, modification time (seconds) and size of ``binaryFile`` rows; their content is not read."""
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source"), "path",
        (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """The files directly in ``directory``."""
    return as_listing(spark.read.format("binaryFile").load(directory))


def empty_files(spark: SparkSession, directory: str) -> DataFrame:
    """The empty files directly in ``directory``, which Spark's listings leave out."""
    return spark.createDataFrame(session.empty_files(spark, directory), "source string, path string, mtime double, size bigint")


def _opened(path: str, seekable: bool = False):
    """A file of any of Arrow's file systems, as its bytes are."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    elif "://" not in path:
        system, name = fs.LocalFileSystem(), path
    else:
        system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_file(name) if seekable else system.open_input_stream(name, compression=None)


def _whole_lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of lines without the last line's end, which is \\n, \\r or both."""
    rest = b""
    for chunk in chunks:
        data = rest + chunk
        cut = max(data.rfind(b"\n"), data.rfind(b"\r", 0, -1))  # what follows a last \r is not known yet
        if cut >= 0:
            yield data[:cut].removesuffix(b"\r") if data[cut:cut + 1] == b"\n" else data[:cut]
        rest = data[cut + 1:]
    if rest:
        yield rest.removesuffix(b"\r")


def _unpack(frames: Iterator) -> Iterator:
    """Stream compressed files as blocks of whole lines; a file, or a compressed member of an archive, that fails ends with one null
    block that tells why."""
    import gzip
    import io
    import tarfile

    import pandas as pd

    class Bytes(io.RawIOBase):
        """Forward-only reader, as archive members of a stream cannot seek."""

        def __init__(self, stream):
            self.stream = stream

        def readable(self):
            return True

        def readinto(self, buffer):
            data = self.stream.read(len(buffer))
            buffer[:len(data)] = data
            return len(data)

    def members(path: str, kind: str, name: str):
        with _opened(path) as raw:
            if kind != "archive":
                yield name, gzip.GzipFile(fileobj=raw)
                return
            with tarfile.open(fileobj=raw, mode="r|gz") as archive:
                for member in archive:
                    if member.isfile():
                        stream = archive.extractfile(member)
                        packed = member.name.lower().endswith(".gz")
                        yield f"{name}/{member.name.removeprefix('./')}", gzip.GzipFile(fileobj=stream) if packed else stream

    def chunks(stream) -> Iterator[bytes]:
        reader = io.BufferedReader(Bytes(stream))
        return iter(lambda: reader.read(BLOCK_BYTES), b"")

    def blocks(path: str, kind: str, name: str):
        try:
            for source, stream in members(path, kind, name):
                try:
                    for block in _whole_lines(chunks(stream)):
                        yield source, name, block, None
                except Exception as problem:
                    if source == name or not isinstance(stream, gzip.GzipFile):
                        raise
                    yield source, name, None, repr(problem)  # a compressed member is damaged, the archive is not
        except Exception as problem:  # damage of the file itself; the caller reports it
            yield name, name, None, repr(problem)

    for frame in frames:
        for row in frame.itertuples(index=False):
            for block in blocks(row.path, row.kind, row.source):
                yield pd.DataFrame([block], columns=["source", "file", "block", "error"])


def packed(listing: DataFrame, task_bytes: int = TASK_BYTES, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, int]:
    """A listing dealt to tasks by size, as a column ``task``, and the number of tasks.

    Files lie one after another, each as long as its size (``task_bytes`` at most) and ``file_bytes``; those that begin in the same stretch
    of ``task_bytes`` share a task. Small listings are cut into as many stretches as the cluster has cores. Running sums are taken in parts
    of the listing, whose totals alone come to the driver. A task holds no more than one file beyond its stretch; a null size counts as none.
    """
    length = F.least(F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)), F.lit(task_bytes)) + F.lit(file_bytes)
    parts = listing.withColumns({"_length": length, "_part": F.pmod(F.xxhash64("path"), F.lit(LISTING_PARTS)).cast("int")})
    totals = dict(tuple(r) for r in parts.groupBy("_part").agg(F.sum("_length")).collect())
    begin = list(accumulate((totals.get(p, 0) for p in range(LISTING_PARTS)), initial=0))
    stretch = min(task_bytes, max(file_bytes, -(-begin[-1] // listing.sparkSession.sparkContext.defaultParallelism)))
    before = Window.partitionBy("_part").orderBy("path", "size").rowsBetween(Window.unboundedPreceding, -1)
    place = F.element_at(F.lit(begin), F.col("_part") + 1) + F.coalesce(F.sum("_length").over(before), F.lit(0))
    dealt = parts.withColumn("task", F.floor(place / F.lit(stretch)).cast("int")).drop("_length", "_part")
    return dealt, max(1, -(-begin[-1] // stretch))


def _compressed_lines(spark: SparkSession, files: Sequence[Row]) -> DataFrame:
    listing = spark.createDataFrame([(f.source, f.path, f.kind, f.size) for f in files], "source string, path string, kind string, size bigint")
    dealt, tasks = packed(listing)
    return _split(dealt.repartitionById(tasks, "task").select("source", "path", "kind").mapInPandas(_unpack, BLOCKS))


def _split(blocks: DataFrame) -> DataFrame:
    line = F.explode_outer(F.split(F.make_valid_utf8(F.col("block").cast("string")), r"\r\n|\r|\n"))
    return blocks.select("source", "file", line.alias("line"), "error")


def _text_lines(spark: SparkSession, files: Sequence[Row]) -> DataFrame:
    literal = [re.sub(r"([\\\[\]{}*?])", r"\\\1", f.path) for f in files]
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))  # the name is URL-encoded
    return spark.read.text(literal).select(
        name.alias("source"), name.alias("file"), F.make_valid_utf8("value").alias("line"),
        F.lit(None).cast("string").alias("error"))


def read_lines(spark: SparkSession, files: Sequence[Row]) -> DataFrame:
    """``(source, file, line)`` of classified listing rows; archive members are sources named ``archive/member``.

    Text is read in splits by many tasks. A compressed stream has one reader, which hands on blocks of
    some megabytes; these are split into lines by Spark. Small compressed files share readers.
    """
    text = [f for f in files if f.kind == TEXT]
    compressed = [f for f in files if f.kind in (GZIP, ARCHIVE)]
    parts = ([_text_lines(spark, text)] if text else []) + ([_compressed_lines(spark, compressed)] if compressed else [])
    if not parts:
        return spark.createDataFrame([], LINES)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# growing text files, read by ranges of bytes


def _line_start(file, at: int, size: int) -> int:
    """Where the first line begins at or after byte ``at``; ``size`` if none does before it. Line ends are \\n, \\r or both."""
    if at <= 0:
        return 0
    place = at - 1
    while place < size:
        file.seek(place)
        chunk = file.read(min(2**16, size - place))
        if not chunk:
            break
        if found := re.search(rb"\r\n|\r|\n", chunk):
            if found.end() < len(chunk) or found.group() != b"\r" or place + found.end() >= size:
                return place + found.end()
            file.seek(place + found.end())
            return place + found.end() + (file.read(1) == b"\n")
        place += len(chunk)
    return size


def _read_ranges(frames: Iterator) -> Iterator:
    """Blocks of the lines that begin inside ranges of bytes, nothing beyond the size a file had in its listing."""
    import pandas as pd

    def chunks(file, place: int, end: int) -> Iterator[bytes]:
        file.seek(place)
        while place < end:
            chunk = file.read(min(BLOCK_BYTES, end - place))
            if not chunk:
                raise EOFError(f"the file ends at byte {place}, {end} were listed")
            place += len(chunk)
            yield chunk

    def blocks(row) -> Iterator[tuple]:
        try:
            with _opened(row.path, seekable=True) as file:
                if file.size() < row.size:
                    raise EOFError(f"the file ends at byte {file.size()}, {row.size} were listed")
                begin, end = _line_start(file, row.begin, row.size), _line_start(file, row.end, row.size)
                for block in _whole_lines(chunks(file, begin, end)):
                    yield row.source, row.source, block, None
        except Exception as problem:  # the caller reports it
            yield row.source, row.source, None, repr(problem)

    for frame in frames:
        for row in frame.itertuples(index=False):
            for block in blocks(row):
                yield pd.DataFrame([block], columns=["source", "file", "block", "error"])


def read_ranges(files: DataFrame, range_bytes: int = TASK_BYTES) -> DataFrame:
    """``(source, file, line, error)`` of the lines of text files from byte ``begin``, where a line has to begin, up to ``size``.

    A long file is cut into ranges of ``range_bytes``, read by tasks of their own; a line belongs to the range it begins in. Short ones share
    tasks. Bytes that a writer appends meanwhile are left for the next time; a file that is shorter than listed gives one row with the error.
    """
    begins = F.explode(F.sequence("begin", F.greatest("begin", F.col("size") - 1), F.lit(range_bytes)))
    cut = files.filter(F.col("size") > F.col("begin")).select("source", "path", F.col("size").alias("whole"), begins.alias("begin"))
    ranges = cut.withColumns({"end": F.least(F.col("begin") + F.lit(range_bytes), F.col("whole")), "file_path": F.col("path")})
    unique = ranges.withColumns({"path": F.concat_ws("#", "path", "begin"), "size": F.col("end") - F.col("begin")})
    dealt, tasks = packed(unique)
    given = dealt.repartitionById(tasks, "task").select("source", F.col("file_path").alias("path"), "begin", "end", F.col("whole").alias("size"))
    return _split(given.mapInPandas(_read_ranges, BLOCKS))


def endings(files: DataFrame, column: str, check_bytes: int | None = CHECK_BYTES) -> DataFrame:
    """``(path, ending)`` of text files: what tells whether a file still begins with the same ``column`` bytes.

    The ending is a checksum over the first and the last ``check_bytes`` of them (over all if None); null where they do not end with a
    line end \\n, where the file is shorter, or can't be read.
    """
    def read(frames: Iterator) -> Iterator:
        import hashlib

        import pandas as pd

        def ending(path: str, size: int) -> str | None:
            try:
                with _opened(path, seekable=True) as file:
                    if size <= 0 or file.size() < size:
                        return None
                    digest, last = hashlib.blake2b(f"{size} {check_bytes}".encode(), digest_size=16), b""
                    near = size if check_bytes is None else min(size, check_bytes)
                    for place, end in ((0, near), (max(near, size - near), size)):
                        file.seek(place)
                        while place < end:
                            last = file.read(min(BLOCK_BYTES, end - place))
                            if not last:
                                return None
                            digest.update(last)
                            place += len(last)
                    return digest.hexdigest() if last.endswith(b"\n") else None
            except OSError:
                return None

        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "ending": [ending(p, int(n)) for p, n in zip(frame["path"], frame["n_bytes"])]})

    known = files.filter(F.col(column).isNotNull()).select("path", F.col(column).alias("n_bytes"))
    dealt, tasks = packed(known.withColumn("size", F.least("n_bytes", F.lit(2 * (check_bytes or TASK_BYTES)))))
    return dealt.repartitionById(tasks, "task").select("path", "n_bytes").mapInPandas(read, "path string, ending string")
