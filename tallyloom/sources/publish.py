"""Exclusive publishing: a data source whose commit messages carry every file's rows, bytes and digest; the manifest is the commit.

Tasks write files of their own into a folder of the write's own below the root. On commit the driver removes what failed
attempts left, and writes `manifest.json`, which names the folder, last and only if there is none. On abort the folder is
removed, as far as tasks have ended. A driver that is killed leaves a folder that no manifest names: nothing is published, and a rerun succeeds. Nothing
is read back. Paths are any that pyarrow's filesystems open; on a local one two writers can't both create the manifest, on a
store without exclusive creation the later one may win.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FORMAT = "exclusive_parquet"


def _data_source():
    """The data source's class; made in a function, so that it travels by value to workers without this package."""
    from dataclasses import dataclass

    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

    @dataclass
    class Written(WriterCommitMessage):
        name: str | None
        rows: int = 0
        size: int = 0
        sha256: str = ""

    class Digested:
        """A sink that hashes what it passes on."""

        def __init__(self, sink):
            self.sink, self.sha, self.size, self.closed = sink, hashlib.sha256(), 0, False

        def write(self, data):
            data = bytes(data)
            self.sha.update(data)
            self.size += len(data)
            self.sink.write(data)
            return len(data)

        def tell(self):
            return self.size

        def flush(self):
            self.sink.flush()

        def writable(self):
            return True

        def readable(self):
            return False

        def seekable(self):
            return False

        def close(self):
            self.closed = True

    class Writer(DataSourceArrowWriter):
        def __init__(self, path, folder, store):
            self.path, self.folder, self.store = path, folder, store

        def write(self, iterator):
            import pyarrow as pa
            import pyarrow.parquet as pq

            files, root = self.store(self.path)
            writer = sink = out = None
            name, rows = f"part-{uuid.uuid4().hex}.parquet", 0
            try:
                for batch in iterator:
                    if not batch.num_rows:
                        continue
                    if writer is None:
                        files.create_dir(f"{root}/{self.folder}", recursive=True)
                        sink = files.open_output_stream(f"{root}/{self.folder}/{name}")
                        out = Digested(sink)
                        writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema, compression="zstd")
                    writer.write_batch(batch)
                    rows += batch.num_rows
            finally:
                if writer is not None:
                    writer.close()
                    sink.close()
            return Written(name, rows, out.size, out.sha.hexdigest()) if rows else Written(None)

        def commit(self, messages):
            from pyarrow import fs

            files, root = self.store(self.path)
            listed = sorted(({"path": f"{self.folder}/{m.name}", "rows": m.rows, "length": m.size, "sha256": m.sha256} for m in messages if m is not None and m.name), key=lambda x: x["path"])
            names = {x["path"].split("/")[1] for x in listed}
            files.create_dir(f"{root}/{self.folder}", recursive=True)
            for info in files.get_file_info(fs.FileSelector(f"{root}/{self.folder}")):
                if info.base_name not in names:  # of an attempt that failed
                    files.delete_file(info.path)
            text = json.dumps({"folder": self.folder, "rows": sum(x["rows"] for x in listed), "files": listed}, sort_keys=True).encode()
            pending = f"{root}/.{self.folder}.json"
            with files.open_output_stream(pending) as sink:
                sink.write(text)
            try:
                if isinstance(files, fs.LocalFileSystem):
                    os.link(pending, f"{root}/manifest.json")  # fails if it is there
                elif files.get_file_info(f"{root}/manifest.json").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{self.path} is published already")
                else:
                    files.copy_file(pending, f"{root}/manifest.json")
            except FileExistsError:
                files.delete_dir(f"{root}/{self.folder}")
                raise FileExistsError(f"{self.path} is published already") from None
            finally:
                files.delete_file(pending)

        def abort(self, messages):
            from pyarrow import fs

            files, root = self.store(self.path)
            for _ in range(5):  # tasks that are being cancelled may still write
                try:
                    if files.get_file_info(f"{root}/{self.folder}").type == fs.FileType.NotFound:
                        return
                    files.delete_dir(f"{root}/{self.folder}")
                except OSError:
                    pass
                time.sleep(0.2)

    def store(path):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)

    class Exclusive(DataSource):
        @classmethod
        def name(cls):
            return _name

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], self.options["folder"], store)

    _name = "exclusive_parquet"
    return Exclusive


def _uri(path: str) -> str:
    """A URI that pyarrow opens: file:/x and plain paths as file:///x."""
    if "://" in path and not path.startswith("file:"):
        return path
    return "file:///" + (os.path.abspath(path) if not path.startswith("file:") else path.split(":", 1)[1]).lstrip("/")


def publish(df: DataFrame, path: str) -> dict:
    """Writes df as the one published state of a root folder, and returns its manifest: folder, rows, files (path, rows, length, sha256).

    Raises if the root is published already, before anything is written, and again at the commit. An empty df is published
    as no files and no rows.
    """
    from pyarrow import fs

    spark, uri = df.sparkSession, _uri(path)
    files, root = fs.FileSystem.from_uri(uri)
    if files.get_file_info(f"{root}/manifest.json").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} is published already")
    spark.dataSource.register(_data_source())
    df.write.format(_FORMAT).option("folder", f"data-{uuid.uuid4().hex}").mode("append").save(uri)
    return manifest(path)


def manifest(path: str) -> dict:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(_uri(path))
    with files.open_input_stream(f"{root}/manifest.json") as source:
        return json.loads(source.read())


def published(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The published rows: of the files that the manifest names, and of no other."""
    listed = manifest(path)
    if not listed["files"]:
        if schema is None:
            raise ValueError("nothing was published but no rows; give a schema")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*(f"{_uri(path)}/{f['path']}" for f in listed["files"]))


def publish_violations(spark: SparkSession, path: str) -> DataFrame:
    """(path, problem) of the files of the published folder that aren't as its manifest says: missing, extra or changed. Hashes every file."""
    from .tables import artifact_hashes

    listed = manifest(path)
    want = spark.createDataFrame([(f["path"], f["sha256"]) for f in listed["files"]] or [(None, None)], "path string, want string").filter("path is not null")
    found = artifact_hashes(spark, f"{_uri(path)}/{listed['folder']}").select(F.concat(F.lit(listed["folder"] + "/"), F.element_at(F.split("path", "/"), -1)).alias("path"), F.col("sha256").alias("have")).filter("path like '%.parquet'")
    both = want.join(found, "path", "full")
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("have") != F.col("want"), "changed")
    return both.select("path", problem.alias("problem")).filter("problem is not null")
