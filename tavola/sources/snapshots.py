"""Several tables written as one commit.

A commit writes its tables to a folder of its own and then makes them visible by renaming
one small manifest to the next free number, which fails if someone else took it. Readers see
the tables of the highest manifest, all of one commit; what a failed writer left is not
named by any manifest. Works on file systems whose rename does not replace files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

DIGITS = 12


class Conflict(RuntimeError):
    """Another commit came first."""


def _files(spark: SparkSession, folder: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    path = make(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), make


def versions(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the commits, ascending."""
    files, make = _files(spark, base)
    folder = make(f"{base}/manifests")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def commit(spark: SparkSession, base: str, tables: dict[str, DataFrame], expected: int | None = None) -> int:
    """Write all `tables` and make them the next version; returns its number.

    `expected` is the version that the tables were made from (the highest, if not given); with
    another commit since, nothing becomes visible and `Conflict` is raised.
    """
    before = expected if expected is not None else max(versions(spark, base), default=0)
    folder = f"{base}/data/{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    files, make = _files(spark, base)
    manifest = json.dumps({name: f"{folder}/{name}" for name in tables}).encode()
    staged = make(f"{base}/staged/{uuid.uuid4().hex}.json")
    out = files.create(staged)
    out.write(bytearray(manifest))
    out.close()
    final = make(f"{base}/manifests/{before + 1:0{DIGITS}d}.json")
    files.mkdirs(final.getParent())
    if files.exists(final) or not files.rename(staged, final):
        files.delete(staged, False)
        raise Conflict(f"version {before + 1} of {base} is taken")
    return before + 1


def read(spark: SparkSession, base: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (the last one, if not given), all of the same commit."""
    known = versions(spark, base)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no version {version or ''} in {base}")
    number = version if version is not None else known[-1]
    text = spark.read.text(f"{base}/manifests/{number:0{DIGITS}d}.json", wholetext=True).first()[0]
    return {name: spark.read.parquet(path) for name, path in json.loads(text).items()}
