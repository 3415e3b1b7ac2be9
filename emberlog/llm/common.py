"""What the operators of this subpackage share: table access, word splitting and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.runtime import ensure_importable

#: ASCII letters lower-cased; every ASCII byte that is neither letter nor digit becomes a space. Bytes from 0x80 stay.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: ASCII letters lower-cased, all else as it is.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, ASCII digits and non-ASCII characters of a UTF-8 text."""
    return text.translate(WORD_TABLE).split()


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs between ASCII white space of a UTF-8 text."""
    return text.translate(LOWER_TABLE).split()


def utf8(column) -> F.Column:
    """The text as bytes, a null text as empty: Python workers then need no decoding."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def sliced(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text, a longer row by itself: what a worker holds stays small."""
    for batch in batches:
        if batch.nbytes <= limit or batch.num_rows < 2:
            yield batch
            continue
        size = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + batch.num_rows + 1]
                size += np.diff(ends)
        part = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(begin, end - begin)


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, limit: int = 4 << 20) -> DataFrame:
    """mapInArrow over slices of bounded size, with this package importable on the workers."""
    ensure_importable(df.sparkSession)
    return df.mapInArrow(lambda batches: rows(sliced(batches, limit)), schema)


def clash_free(df: DataFrame, *wanted: str) -> DataFrame:
    """Only the wanted columns, whatever other columns the table carries."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
