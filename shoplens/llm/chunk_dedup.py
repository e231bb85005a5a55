"""Substring deduplication by content-defined chunks: a gear rolling hash cuts, digests decide.

The gear hash of a position covers its last 16 bytes, so cuts depend on
content alone and fall into step again 16 bytes after an insertion. Chunks
average about ``MEAN`` bytes; a cut closer than ``LEAST`` bytes to the candidate
before it is skipped and chunks end at ``MOST`` bytes at the latest. Chunks with
equal 128-bit digests are copies: the one with the smallest (doc_id, text digest, start)
is kept, the others are removed. Digests are counted with partial aggregates
and joined back, so a chunk held by a third of all documents is one row per
task before the shuffle.

Defined results: NULL and empty texts have no chunks; rows with equal doc_id and
text are one document, also where both ids are NULL, and different texts are different
documents under whatever id; a NULL doc_id sorts after all others; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import over_batches, staged, utf8_values

MEAN, LEAST, MOST = 40, 16, 1024
#: A document is reported when its longest run of neighbouring chunks that other documents hold has this many bytes.
RUN = 64
GEAR = np.random.Generator(np.random.PCG64(41)).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """Chunk edges of a text, 0 and its length included."""
    n = len(data)
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # sum of GEAR[data[i - j]] << j over the last 16 bytes
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    hit = np.flatnonzero((h >> np.uint32(4)) & np.uint32(0xFFF) < 4096 // mean) + 1
    if len(hit):
        hit = hit[np.diff(hit, prepend=-LEAST) >= LEAST]
    edges = np.unique(np.concatenate([[0], hit, [n]]))
    gaps = np.diff(edges)
    if len(gaps) and gaps.max() > MOST:
        more = [np.arange(a + MOST, a + g, MOST) for a, g in zip(edges[:-1], gaps) if g > MOST]
        edges = np.unique(np.concatenate([edges, *more]))
    return edges


def _chunks(batch: pa.RecordBatch) -> dict:
    rows, starts, sizes, digests, texts = [], [], [], [], []
    for data in utf8_values(batch.column("text")):
        if data is None or not len(data):
            rows.append(0)
            texts.append(0)
            continue
        edges = cuts(data)
        body = data.tobytes()
        texts.append(int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True))
        digests += [hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        starts.append(edges[:-1])
        sizes.append(np.diff(edges))
        rows.append(len(edges) - 1)
    own = np.repeat(np.arange(batch.num_rows), rows)
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    none = np.zeros(0, np.int32)
    return {
        "doc_id": batch.column("doc_id").take(pa.array(own)), "txt": np.array(texts, np.int64)[own], "start": np.concatenate([none, *starts]).astype(np.int32),
        "size": np.concatenate([none, *sizes]).astype(np.int32), "d1": halves[:, 0], "d2": halves[:, 1],
    }


def chunk_table(docs: DataFrame) -> DataFrame:
    """doc_id, txt (the text's digest), start, size and digest (d1, d2) of every chunk."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(docs, _chunks, "doc_id long, txt long, start int, size int, d1 long, d2 long")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks whose digest occurs again: doc_id, txt, start, size, kept_doc, removed; shared if two documents hold it."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "txt", "start")
    document = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "txt")
    copies = chunks.groupBy("d1", "d2").agg(
        F.count(F.lit(1)).alias("n"), F.min(place).alias("first"), (F.min(document) < F.max(document)).alias("shared")
    ).where("n > 1")
    return chunks.join(copies, ["d1", "d2"]).select(
        "doc_id", "txt", "start", "size", F.col("first.doc_id").alias("kept_doc"), "shared", (~place.eqNullSafe(F.col("first"))).alias("removed")
    )


def chunk_report(docs: DataFrame) -> DataFrame:
    """One row per document with chunks that occur again, in it or in another.

    doc_id, repeated_bytes, removed_bytes (chunks kept elsewhere), n_removed
    chunks, longest_run (of neighbouring chunks that other documents hold),
    kept_docs (the documents that keep its removed chunks; itself for its own copies).
    """
    repeated = repeated_chunks(staged(chunk_table(docs), "cdc_chunks"))
    lists = repeated.groupBy("doc_id", "txt").agg(
        F.array_sort(F.collect_set(F.struct("start", "size", "removed", "kept_doc", "shared"))).alias("chunks")
    )
    # Walk the sorted chunks: a chunk that starts where the one before ended lengthens the run.
    walk = F.aggregate(
        F.filter("chunks", lambda x: x["shared"]),
        F.expr("named_struct('end', -1, 'run', 0, 'best', 0)"),
        lambda acc, x: F.struct(
            (x["start"] + x["size"]).alias("end"),
            F.when(x["start"] == acc["end"], acc["run"] + x["size"]).otherwise(x["size"]).alias("run"),
            F.greatest(acc["best"], F.when(x["start"] == acc["end"], acc["run"] + x["size"]).otherwise(x["size"])).alias("best"),
        ),
        lambda acc: acc["best"],
    )
    size = lambda where: F.aggregate(F.filter("chunks", where), F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    return lists.select(
        "doc_id", size(lambda x: F.lit(True)).alias("repeated_bytes"), size(lambda x: x["removed"]).alias("removed_bytes"),
        F.size(F.filter("chunks", lambda x: x["removed"])).alias("n_removed"), walk.alias("longest_run"),
        F.array_sort(F.array_distinct(F.transform(F.filter("chunks", lambda x: x["removed"]), lambda x: x["kept_doc"]))).alias("kept_docs"),
    )


def dedup_report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents of ``chunk_report`` with runs of ``run`` bytes or more that other documents hold too."""
    return chunk_report(docs).where(F.col("longest_run") >= run)


def removal_report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """The documents of ``dedup_report`` and every other one with a removed chunk, be its copy elsewhere or in itself."""
    return chunk_report(docs).where((F.col("n_removed") > 0) | (F.col("longest_run") >= run))
