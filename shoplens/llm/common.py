"""Shared helpers: table access, staged tables, CRC split, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the controls tab..carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only a single-JVM local session that has none gets a temporary folder, as in tests.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shoplens-ckpt-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/llm/{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_bucket(column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; NULL ids give NULL."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def utf8_values(array: pa.Array) -> Iterator[np.ndarray | None]:
    """Each value's UTF-8 bytes as an array (None for NULL), without copying."""
    if isinstance(array, pa.ChunkedArray):
        for chunk in array.chunks:
            yield from utf8_values(chunk)
        return
    n = len(array)
    if not n:
        return
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    missing = array.is_null().to_numpy(zero_copy_only=False) if array.null_count else np.zeros(n, bool)
    for i in range(n):
        yield None if missing[i] else whole[at[i] : at[i + 1]]


def utf8_pieces(array: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The values' bytes in runs of rows of about ``most`` bytes: (first row, bytes, where each row begins; one more).

    NULL values have no bytes; a run holds one row at least.
    """
    n = len(array)
    if not n:
        return
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, whole[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


#: Rows handed to a batch function at once.
PIECE = 1024


def over_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` with a function from a batch to the columns of the answer, in the schema's order.

    Batches are handed on in pieces of at most ``PIECE`` rows, which bounds what a worker holds.
    """
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(types)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                columns = make(batch.slice(at, PIECE))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns.values(), want)],
                    schema=want,
                )

    return df.mapInArrow(run, types)


class IdFilter:
    """A Bloom filter of an id column for use inside tasks: lets a scan drop rows that a later join would drop.

    Two hashes, ``BITS`` bits an id and never more than ``MOST`` bits (16 MB),
    so what is broadcast is bounded; beyond that it lets more rows pass and
    the join, which follows in any case, drops them.
    """

    BITS, MOST = 10, 1 << 27

    def __init__(self, ids: DataFrame, column: str, digest: bool = False):
        """``digest``: the ids are digests of 12 bytes or more, whose own bits serve as hashes."""
        self.digest = digest
        size = min(self.MOST, 1 << max(16, (ids.count() * self.BITS).bit_length()))
        self.size = size
        slot = ids.select(F.explode(F.array(*self._hashes(column))).alias("slot"))
        words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")
        )
        found = words.toArrow()
        table = np.zeros(size // 64, np.int64)
        table[found.column("word").to_numpy()] = found.column("mask").to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def __getstate__(self):
        return {"size": self.size, "table": self.table, "digest": self.digest}

    def _hashes(self, column: str) -> list[Column]:
        if self.digest:
            parts = [F.conv(F.hex(F.substring(F.col(column), at, 6)), 16, 10).cast("long") for at in (1, 7)]
            return [p % F.lit(self.size) for p in parts]
        return [F.pmod(F.xxhash64(F.lit(i), F.col(column)), F.lit(self.size)) for i in (1, 2)]

    def may_hold(self, digest: bytes) -> bool:
        table = self.table.value
        at = [int.from_bytes(digest[i : i + 6], "big") % self.size for i in (0, 6)]
        return all(int(table[s >> 6]) >> (s & 63) & 1 for s in at)

    def slots(self, column: str) -> list[Column]:
        """Columns that ``rows`` reads."""
        return [F.when(F.col(column).isNotNull(), h).alias(f"_slot{i}") for i, h in enumerate(self._hashes(column))]

    def marks(self, batch: pa.RecordBatch) -> np.ndarray:
        """Which of the batch's rows have an id that may be in the filter; NULL ids have not."""
        table, keep = self.table.value, np.ones(batch.num_rows, bool)
        for i in range(2):
            column = batch.column(f"_slot{i}")
            s = column.fill_null(0).to_numpy()
            keep &= ((table[s >> 6] >> (s & 63)) & 1 == 1) & column.is_valid().to_numpy(zero_copy_only=False)
        return keep

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(self.marks(batch)))


def tallied(df: DataFrame, add: Callable[[pa.RecordBatch, dict], None], keys: str, most: int = 200_000) -> DataFrame:
    """Counts by key, partially added up in the tasks: ``add(batch, tally)`` adds to a dictionary.

    ``keys`` is the schema of the key columns; the tally maps a key (a tuple if
    there are several) to a count, named n. It is handed on and emptied at ``most`` entries or after 128 MB of
    input, so a worker's memory is bounded; a ``groupBy`` of the keys adds up the rest.
    """
    types = df.sparkSession.createDataFrame([], f"{keys}, n long").schema
    wide = len(types) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(types)

        def rows(tally: dict) -> Iterator[pa.RecordBatch]:
            found = list(tally.items())
            for at in range(0, len(found), 16 * PIECE):
                some = found[at : at + 16 * PIECE]
                columns = [[k for k, _ in some]] if wide == 1 else [[k[i] for k, _ in some] for i in range(wide)]
                columns.append([v for _, v in some])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, want)], schema=want)

        tally: dict = {}
        fed = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                add(part, tally)
                fed += part.nbytes
                if len(tally) >= most or fed >= 1 << 27:
                    yield from rows(tally)
                    tally, fed = {}, 0
        yield from rows(tally)

    return df.mapInArrow(run, types)
