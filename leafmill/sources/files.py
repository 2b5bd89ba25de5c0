"""Small steps on the file system of a path: exclusive creation, listing, removal."""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content unless it exists; False if it does.

    The content is written beside it and then moved there in one step that fails if the place is
    taken, so readers see a whole file or none. HDFS does that by a rename without overwriting,
    a local disk by a hard link. Object stores need a committer that offers such a rename.
    """
    fs, target = _place(spark, path)
    pending = spark._jvm.org.apache.hadoop.fs.Path(target.getParent().getParent(), f"pending/{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(pending, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(pending.toUri().getPath(), target.toUri().getPath())
        else:
            jvm = spark._jvm
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(pending, target, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(pending, False)


def list_dirs(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Folders directly below ``path``, with the hours since each was changed; none if it is missing."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    now = time.time()
    found = [s for s in fs.listStatus(place) if s.isDirectory()]
    return [(s.getPath().getName(), (now - s.getModificationTime() / 1000) / 3600) for s in found]


def remove_dir(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)
