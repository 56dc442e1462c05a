"""Helpers shared by the Arrow-batch operators.

Every operator of this subpackage reads two columns of its input, an
identifier and a text, by the names it is given; other columns of the input,
whatever they are called, are never read, so they can't clash with the columns
that an operator adds.  Texts travel to Python as UTF-8 bytes, because most
kernels work on bytes and skip decoding.
"""

from __future__ import annotations

import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A text longer than this is worked on in blocks cut at white space.
BLOCK_BYTES = 1 << 20
_ASCII_SPACE = b" \t\n\v\f\r"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per Spark context, so that they can import it.

    Spark's own file server hands the archive to the executors, later ones included.
    """
    context = spark.sparkContext
    if getattr(context, "_millrace_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="millrace")), "millrace_package.zip")
    with zipfile.ZipFile(archive, "w") as made:
        for file in sorted(top.rglob("*.py")):
            made.write(file, file.relative_to(top.parent))
    context.addPyFile(archive)
    context._millrace_shipped = True


_HELD: dict[tuple, object] = {}


def worker_memo(key: tuple, make: Callable[[], object]) -> object:
    """The memo of this Python worker for ``key``.

    A worker holds one at a time: it outlives tasks, and a later stage that needs
    another kind shouldn't find its memory taken by an earlier one's.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[key] = make()
    return _HELD[key]


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body): the identifier as it is and the text's UTF-8 bytes, null texts as empty."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))


def map_docs(df: DataFrame, row: Callable[[dict], dict], schema: str, names: list[str]) -> DataFrame:
    """Apply ``row`` to each input row; it returns one tuple of values in the order of ``names``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = [c.to_pylist() for c in batch.columns]
            made = list(map(row, *columns))
            if made:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*made, strict=True)), strict=True)))

    return df.mapInArrow(batches, schema)


def blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Cut ``data`` after ASCII white space into blocks of about ``size`` bytes; nothing is dropped.

    A run without white space is never cut, so a word is always whole.
    """
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end - 1] not in _ASCII_SPACE:
            end += 1
        yield data[at:end]
        at = end
