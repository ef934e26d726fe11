"""Versions of a stored table: immutable folders and one small head file per version.

A writer fills a folder of its own and then puts the head of the next version
in place with a single rename. Until then readers see the version before, and a
crash leaves a folder that nothing names. Of two writers that started from the
same version the second finds the head taken and fails. A reader keeps the head
it opened, so its files stay the same while others write.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer published this version first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose names don't begin with a mark."""
    fs, p = _fs(spark, path), _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName()[0] not in "._")


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    heads = f"{root.rstrip('/')}/_heads"
    fs = _fs(spark, heads)
    if not fs.exists(_path(spark, heads)):
        return []
    return sorted(int(n) for n in (s.getPath().getName() for s in fs.listStatus(_path(spark, heads))) if n.isdigit())


def head(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """(version, content of its head); (0, {}) where nothing is published."""
    known = versions(spark, root)
    if not known:
        return 0, {}
    version = known[-1] if version is None else version
    path = f"{root.rstrip('/')}/_heads/{version}"
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return version, json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def new_folder(root: str) -> str:
    """A folder for the data of the next version."""
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, version: int, content: dict) -> None:
    """Make ``content`` the head of ``version``, all at once; raises ``VersionTaken`` if it has one."""
    heads = f"{root.rstrip('/')}/_heads"
    fs = _fs(spark, heads)
    fs.mkdirs(_path(spark, heads))
    staged = _path(spark, f"{heads}/.staged-{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(staged, _path(spark, f"{heads}/{version}"), options)
    except Exception as error:
        fs.delete(staged, False)
        if fs.exists(_path(spark, f"{heads}/{version}")):
            raise VersionTaken(f"version {version} of {root} is published already") from error
        raise


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Drop all but the last ``keep`` versions and the folders only they name; returns the number of folders.

    Not while a writer is at work: its folder isn't named by any head yet.
    """
    root, known = root.rstrip("/"), versions(spark, root)
    fs = _fs(spark, root)
    named = json.dumps([head(spark, root, v)[1] for v in known[-keep:]])
    gone = 0
    for v in known[:-keep]:
        fs.delete(_path(spark, f"{root}/_heads/{v}"), False)
    for name in folders_in(spark, root):
        if name not in named:
            gone += fs.delete(_path(spark, f"{root}/{name}"), True)
    return gone
