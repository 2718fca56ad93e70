"""Write log lines as files the way a log directory holds them: text, gzip and tar+gzip, by many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hitledger import session

# How each source is stored; the tasks number their files, so no task holds a whole source.
KINDS = {"access_0.log": "text", "access_1.log": "gzip", "access_2.log": "archive", "access_3.log": "archive"}


def write_log_files(lines: DataFrame, directory: str, all_text: bool = False, key: str = "event_id", prefix: str = "",
                    order: Sequence[str] = ()) -> int:
    """Write ``(source, line)`` rows into ``directory``; returns the number of lines. ``prefix`` begins all names; lines are in ``order``."""
    spark = lines.sparkSession
    target = session.qualified(spark, directory)
    kinds = {name: "text" for name in KINDS} if all_text else KINDS

    def write(frames):
        import gzip
        import io
        import os
        import tarfile

        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, root = ((fs.LocalFileSystem(), "/" + target[5:].lstrip("/")) if target.startswith("file:")
                        else fs.FileSystem.from_uri(target))
        system.create_dir(root, recursive=True)
        outputs, bundle, members, count = {}, None, 0, 0

        def output(name):
            if name not in outputs:
                outputs[name] = system.open_output_stream(os.path.join(root, name), compression=None)
            return outputs[name]

        if task == 0:  # two files that no log reader may take
            output("notes.json").write(b'{"not": "a log"}\n')
            output("old.zip").write(b"PK")
        for frame in frames:
            for source, rows in frame.groupby("source"):
                data = ("\n".join(rows["line"]) + "\n").encode()
                stem = prefix + source.removesuffix(".log")
                count += len(rows)
                if kinds[source] == "text":
                    output(f"{stem}-{task}.log").write(data)
                elif kinds[source] == "gzip":
                    output(f"{stem}-{task}.log.gz").write(gzip.compress(data))  # members of one stream
                else:
                    bundle = bundle or tarfile.open(fileobj=output(f"{prefix}bundle-{task}.tar.gz"), mode="w|gz")
                    if members % 2:  # rotated members are compressed themselves
                        data = gzip.compress(data)
                    entry = tarfile.TarInfo(f"{stem}-{members}.log{'.gz' if members % 2 else ''}")
                    entry.size, members = len(data), members + 1
                    bundle.addfile(entry, io.BytesIO(data))
        if bundle:
            bundle.close()
        for stream in outputs.values():
            stream.close()
        yield pd.DataFrame({"n": [count]})

    spread = lines.repartition(spark.sparkContext.defaultParallelism, key)
    spread = spread.sortWithinPartitions(*order) if order else spread
    return spread.select("source", "line").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0]
