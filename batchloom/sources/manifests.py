"""Files that exist once: numbered manifests and lease tokens, created only if absent."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from typing import Any
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder of small JSON files on the cluster's file system, told apart by a number.

    A file is written aside and then published under its name, which fails if the name is taken: by a hard link on a
    local disk, else by a rename that doesn't overwrite, as HDFS has it. A file system whose rename isn't atomic
    can't hold such a folder.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = p.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(p)
        self.local = self.fs.getUri().getScheme() == "file"

    def at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        if not self.fs.exists(self.path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path))

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.names() if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.at(f"{number:020}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, number: int, content: dict) -> bool:
        """Publish a file under a number; False if that is taken already."""
        final, aside = self.at(f"{number:020}.json"), self.at(f".{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        stream.close()
        try:
            if self.local:
                os.link(_local(aside), _local(final))
                return True
            never = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(aside, final, never)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName() or self.fs.exists(final):
                return False
            raise
        finally:
            with contextlib.suppress(Py4JJavaError):
                self.fs.delete(aside, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _local(path: Any) -> str:
    return unquote(urlparse(path.toUri().toString()).path)
