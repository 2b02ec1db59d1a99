"""Copies of folders between file systems that Spark reaches, by name patterns."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import SparkSession


def _path(spark, name):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark, folder):
    return _path(spark, folder).getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str, allow: tuple[str, ...] = ("*",), ignore: tuple[str, ...] = ()) -> dict[str, int]:
    """Names below the folder, and bytes, of files that some pattern of allow matches and none of ignore."""
    fs, out = _fs(spark, folder), {}
    if not fs.exists(_path(spark, folder)):
        return out
    root = fs.makeQualified(_path(spark, folder)).toString().rstrip("/") + "/"
    found = fs.listFiles(_path(spark, folder), True)
    while found.hasNext():
        s = found.next()
        name = s.getPath().toString().removeprefix(root)
        if any(fnmatch(name, p) for p in allow) and not any(fnmatch(name, p) for p in ignore):
            out[name] = s.getLen()
    return out


def copied(spark: SparkSession, source: str, target: str, allow: tuple[str, ...] = ("*",), ignore: tuple[str, ...] = (), delete: bool = False) -> list[str]:
    """Copies files that the target lacks or has with another size; with delete, files that only the target has go. The names of copied files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    want, have = listed(spark, source, allow, ignore), listed(spark, target)
    changed = sorted(n for n, size in want.items() if have.get(n) != size)
    for n in changed:
        to = _path(spark, f"{target}/{n}")
        _fs(spark, target).mkdirs(to.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(_fs(spark, source), _path(spark, f"{source}/{n}"), _fs(spark, target), to, False, True, conf)
    if delete:
        for n in have.keys() - want.keys():
            _fs(spark, target).delete(_path(spark, f"{target}/{n}"), False)
    return changed
