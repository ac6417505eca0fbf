"""Tables that are replaced as a whole or in parts, under commits.

A commit is one small JSON file that names the folders a table consists of.  It is created only if
it is absent: of two writers that start from the same commit one comes too late and starts again from
the other's.  Folders are never changed once they are written, so readers keep what they have begun with.

Tables of earlier releases are folders ``version=N``, complete once Spark has written its marker; they are still read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobmarket.sources.staging import no_rows

#: how often a writer starts again before it gives up
ATTEMPTS = 20


def _folder(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _folder(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def read_commit(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest commit; 0 and nothing before the first one."""
    numbers = [int(n[:-5]) for n in _names(spark, f"{root}/commits") if n.endswith(".json") and n[0] != "."]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{root}/commits/{max(numbers):08d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file unless it is there; whether it was created."""
    jvm = spark._jvm
    fs, target = _folder(spark, path)
    hidden = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(hidden)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(hidden, target, options)  # fails where the target is there
    except Exception:
        fs.delete(hidden, False)
        if fs.exists(target):
            return False
        raise
    return True


def update(spark: SparkSession, root: str, change: Callable[[dict], dict | None]) -> dict:
    """Commit what ``change`` makes of the newest commit, and return it.

    ``change`` may write folders and is called again when another writer was faster.  A change to None
    commits nothing.
    """
    for _ in range(ATTEMPTS):
        number, content = read_commit(spark, root)
        new = change(content)
        if new is None:
            return content
        if _create(spark, f"{root}/commits/{number + 1:08d}.json", json.dumps(new)):
            return new
    raise RuntimeError(f"{root}: other writers were faster {ATTEMPTS} times")


def write_part(df: DataFrame, root: str, by: str | None = None) -> str:
    """Write rows to a new folder of a table of parts, laid out by the column ``by``; they count once committed."""
    folder = f"data/part={uuid.uuid4().hex}"
    if by:
        df.repartition(by).write.partitionBy(by).parquet(f"{root}/{folder}")
    else:
        df.write.parquet(f"{root}/{folder}")
    return folder


def commit_part(spark: SparkSession, root: str, part: str, **folders: str) -> None:
    """Add a part, the folders of its kinds of rows, in one commit; a part of the same name is replaced."""
    update(spark, root, lambda old: {**old, "parts": {**old.get("parts", {}), part: folders}})


def read_parts(spark: SparkSession, root: str, kind: str, schema, without: str | None = None) -> DataFrame:
    """Rows of one kind of all parts, or of all but one part."""
    parts = read_commit(spark, root)[1].get("parts", {})
    folders = [f"{root}/{part[kind]}" for name, part in parts.items() if name != without]
    if not folders:
        return no_rows(spark, schema)
    return spark.read.option("basePath", f"{root}/data").schema(schema).parquet(*folders).drop("part")


def _versions(spark: SparkSession, root: str) -> list[tuple[int, bool]]:
    found = []
    for name in _names(spark, root):
        if name.startswith("version="):
            found.append((int(name.split("=")[1]), "_SUCCESS" in _names(spark, f"{root}/{name}")))
    return sorted(found)


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest complete version of a table of an earlier release."""
    complete = [n for n, done in _versions(spark, root) if done]
    return f"{root}/version={complete[-1]:08d}" if complete else None
