"""The folder that the driver and all executors share, and tables staged in it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used in local mode only: on a
    cluster a machine-local folder would not be seen by the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="folia-shared-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, zstd_level: int = 3) -> DataFrame:
    """``df`` written to the shared folder and read back.

    This cuts the lineage, survives lost executors and makes values that
    depend on task numbering final.
    """
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", zstd_level).parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._staged_at = path
    return got


def shuffle_joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input: one plan for every size, never a broadcast.

    Spark guesses the size of staged tables from their compressed files, and takes
    an exploded array for as small as the column was: a table of some 50 MB of files
    was broadcast as millions of rows through the driver.
    """
    return left.join(right.hint("merge"), on, how)


def dropped(*tables: DataFrame | str | None) -> None:
    """Deletes staged tables, or folders, that nothing reads any more; what isn't staged is left alone."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "__dict__", {}).get("_staged_at")
        if path:
            from pyarrow import fs as pafs

            fs, at = filesystem(path)
            if fs.get_file_info(at).type == pafs.FileType.Directory:
                fs.delete_dir(at)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


#: Row numbers are (task << TASK_BITS) + place; rows with equal higher bits are a chunk.
TASK_BITS, CHUNK_BITS = 40, 20


def row_numbers(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with numbers for its rows, final once the rows are staged with them."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << TASK_BITS
    for b in batches:
        yield b, np.arange(at, at + b.num_rows, dtype=np.int64)
        at += b.num_rows


def by_chunk(marks: DataFrame, name: str) -> str:
    """The folder with a file for each chunk that has a row (row, value) of ``marks``.

    Rows are found again by their number where they were staged: a task that
    reads staged rows looks into the files of their chunks, so the rows
    themselves need no shuffle.  A chunk has 2^20 rows at most.
    """
    folder = new_folder(marks.sparkSession, name)
    out = pa.schema([("chunk", pa.int64())])

    def save(table: pa.Table) -> pa.Table:
        row, value = (table[c].to_numpy() for c in ("row", "value"))
        order = np.lexsort((value, row))
        with tempfile.NamedTemporaryFile() as f:
            f.write(np.concatenate([row[order], value[order]]).astype("<i8").tobytes())
            f.flush()
            publish(folder, str(row[0] >> CHUNK_BITS), f.name)
        return pa.table([[int(row[0] >> CHUNK_BITS)]], schema=out)

    from pyspark.sql import functions as F

    marks.select("row", "value", F.shiftright("row", CHUNK_BITS).alias("chunk")).groupBy("chunk").applyInArrow(save, "chunk bigint").count()
    return folder


@lru_cache(maxsize=8)
def _chunk(folder: str, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    from pyarrow import fs as pafs

    fs, base = filesystem(folder)
    if fs.get_file_info(f"{base}/{chunk}").type != pafs.FileType.File:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with fs.open_input_file(f"{base}/{chunk}") as f:
        return tuple(np.split(np.frombuffer(f.read(), dtype="<i8"), 2))


def marked(folder: str, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``rows`` that have a mark, its value), from the files of ``by_chunk``."""
    places, values = [], []
    chunks = rows >> CHUNK_BITS
    for c in np.unique(chunks).tolist():
        row, value = _chunk(folder, c)
        if len(row):
            at = np.flatnonzero(chunks == c)
            i = np.minimum(np.searchsorted(row, rows[at]), len(row) - 1)
            hit = row[i] == rows[at]
            places.append(at[hit])
            values.append(value[i[hit]])
    if not places:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at, value = np.concatenate(places), np.concatenate(values)
    order = np.argsort(at, kind="stable")
    return at[order], value[order]


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a folder URI, on any node."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, name: str, data_path: str) -> str:
    """Copies a finished local file into the folder under ``name``.

    The copy is made under a name of its own and then moved, so a reader never
    sees half a file and a repeated task replaces its own earlier copy.
    """
    import shutil

    fs, base = filesystem(uri)
    fs.create_dir(base, recursive=True)
    tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
    with open(data_path, "rb") as src, fs.open_output_stream(tmp) as out:
        shutil.copyfileobj(src, out, 1 << 20)
    fs.move(tmp, f"{base}/{name}")
    return f"{base}/{name}"
