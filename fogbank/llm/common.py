"""Small helpers the operators share: reading tables, bounded text chunks, word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters. ``bytes.split()`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in Python in chunks of about this many bytes, so that token lists stay small.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))


def texts_of(df: DataFrame, key: str, text: str, **more: Column) -> DataFrame:
    """``doc_id``, ``text`` and the named columns only: other columns cannot clash."""
    return df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"),
                     *[c.alias(name) for name, c in more.items()])


def hash_sample(df: DataFrame, rows: int, where: Column, key: str = "doc_id", text: str = "text") -> list:
    """The ``rows`` rows with ``where`` that come first by a hash of their id, on the driver; reruns agree.

    Only rows below a bound of the hash are gathered, about as many as asked for, so that what tasks send to the driver does
    not grow with their number; the bound is raised until there are enough rows.
    """
    h, part = F.xxhash64(key), min(1.0, 2 * rows / max(df.count(), 1))
    while True:
        bound = int(-(1 << 63) + part * ((1 << 64) - 1))
        got = df.where((h <= F.lit(min(bound, (1 << 63) - 1))) & where).orderBy(h, key, text).limit(rows).collect()
        if len(got) >= rows or part >= 1:
            return got
        part = min(1.0, part * min(64.0, 2 * rows / max(len(got), 1)))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = used = 0
        for i, n in enumerate(lengths):
            if used and used + n > size:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < len(lengths):
            yield batch.slice(start)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]],
              column: str = "text") -> DataFrame:
    """Apply ``make()`` (built once a task) to bounded chunks; it returns columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for chunk in chunks(batches, column):
            out = apply(chunk)
            yield pa.RecordBatch.from_arrays(
                [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in types],
                schema=types)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], column: str = "text") -> DataFrame:
    """Like ``map_texts`` for whole rows: ``make()`` returns chunks with all columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for chunk in chunks(batches, column):
            yield apply(chunk)

    return df.mapInArrow(run, df.schema)


def replaced(batch: pa.RecordBatch, column: str, values: pa.Array) -> pa.RecordBatch:
    return batch.set_column(batch.schema.get_field_index(column), batch.schema.field(column), values.cast(batch.schema.field(column).type))
