"""Small files on any Hadoop file system, and atomic commits of numbered JSON logs."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


#: Stores whose rename is atomic and fails if the target exists.
ATOMIC_RENAME = ("hdfs", "abfs", "abfss")
#: Hadoop's option for "create only if absent, as one request".
CONDITIONAL_PUT = "fs.option.create.conditional.overwrite"


class AlreadyThere(Exception):
    """Another writer has created the file."""


class Folder:
    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        raw = self.jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = raw.getFileSystem(self.conf)
        self.uri = self.fs.makeQualified(raw).toString().rstrip("/")

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        """The names in a folder, sorted; none if there is no such folder."""
        at = self.path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read_text(self, name: str) -> str:
        source = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self.path(name), True)

    def create_exclusively(self, name: str, text: str) -> None:
        """The file appears whole and at once; raises AlreadyThere if it is there already.

        How depends on the store, as a check followed by a rename is a race:
        local disks publish a draft by a hard link, HDFS and ADLS by their atomic
        rename, object stores by a conditional put.  A store with none of these
        is refused."""
        target = self.path(name)
        self.fs.mkdirs(target.getParent())
        # views such as viewfs:// lead to another store, whose ways hold
        target = self.jvm.org.apache.hadoop.fs.Path(self.fs.resolvePath(target.getParent()), target.getName())
        scheme = target.toUri().getScheme()
        if scheme == "file":
            self._link(target, text)
        elif scheme in ATOMIC_RENAME:
            self._rename(target, text)
        else:
            self._put(target, text)

    def _draft(self, fs, target, text: str):
        draft = self.jvm.org.apache.hadoop.fs.Path(target.getParent(), f".draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text, "utf-8"))
        out.hsync()
        out.close()
        return draft

    def _link(self, target, text: str) -> None:
        # below Hadoop's checksum layer: a .crc beside the file would be a second file to race for
        raw = self.jvm.org.apache.hadoop.fs.FileSystem.getLocal(self.conf).getRawFileSystem()
        draft = self._draft(raw, target, text)
        place = self.jvm.java.nio.file.Paths.get
        try:
            self.jvm.java.nio.file.Files.createLink(place(target.toUri()), place(draft.toUri()))
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                raise AlreadyThere(f"{target} exists") from error
            raise
        finally:
            raw.delete(draft, False)

    def _rename(self, target, text: str) -> None:
        fs = target.getFileSystem(self.conf)
        draft = self._draft(fs, target, text)
        kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = getattr(kinds, "NONE")
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, options)
        except Py4JJavaError as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise AlreadyThere(f"{target} exists") from error
            raise

    def _put(self, target, text: str) -> None:
        fs = target.getFileSystem(self.conf)
        try:
            # a store that doesn't know the option refuses to build
            out = fs.createFile(target).overwrite(False).must(CONDITIONAL_PUT, True).build()
            out.write(bytearray(text, "utf-8"))
            out.close()
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error) or "PreconditionFailed" in str(error) or "status code: 412" in str(error).lower():
                raise AlreadyThere(f"{target} exists") from error
            if "IllegalArgumentException" in str(error):
                raise ValueError(f"{target}: this store has no conditional put, so that commits would not be atomic") from error
            raise

    def files(self, name: str) -> list[tuple[str, int]]:
        """(path below this folder, bytes) of all files below ``name``, sorted."""
        at, out = self.path(name), []
        if self.fs.exists(at):
            found = self.fs.listFiles(at, True)
            while found.hasNext():
                f = found.next()
                out.append((f.getPath().toString()[len(self.uri) + 1 :], f.getLen()))
        return sorted(out)

    def parquet_rows(self, name: str) -> int:
        """The row count in a Parquet file's footer."""
        hadoop = self.jvm.org.apache.parquet.hadoop
        reader = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(self.path(name), self.conf))
        try:
            return reader.getRecordCount()
        finally:
            reader.close()

    def create_json(self, name: str, body: dict) -> None:
        self.create_exclusively(name, json.dumps(body))

    def read_json(self, name: str) -> dict:
        return json.loads(self.read_text(name))
