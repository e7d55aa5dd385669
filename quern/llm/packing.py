"""Packing by power-of-two decomposition.

A document's ids, end mark included, are cut into pieces whose lengths are powers
of two: as many of the longest as fit, then the binary digits of the rest, longest
first.  Pieces of one length form a bucket and each piece is one sequence of just
that length: there is no padding and no sequence crosses documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import pieces
from .encode import default_path, encoder

_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to n, descending, none above longest."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pack(docs: DataFrame, *, longest: int = 2048, end_id: int = 1, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: the columns in keep, start, length, ids_crc32,
    doc_tokens, sequence_id, offset (always 0), bucket (log2 of the length), and
    with_ids the ids.

    Null and empty texts are a single piece: the end mark.  Repeated rows are
    packed separately; sequence_id is unique for each piece.  Columns outside of
    keep are dropped, so clashing names do no harm.  An empty table gives an empty
    table.  Encoding needs memory in proportion to the longest single text."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_path()
    source = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))
    kept_type = source.schema["kept"].dataType.simpleString()
    schema = f"kept {kept_type}, {_PIECE}" + (", ids array<int>" if with_ids else "")

    def rows(batches):
        from pyspark import TaskContext

        encode = encoder(path)
        number = TaskContext.get().partitionId() << 33
        for batch in pieces(batches, "text"):
            of, columns, ids_out = [], [], []
            for at, value in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(value or ""), end_id], dtype="<u4")
                start = 0
                for length in binary_lengths(len(ids), longest):
                    piece = ids[start : start + length]
                    of.append(at)
                    columns.append((start, length, zlib.crc32(piece.tobytes()), len(ids), number, 0, length.bit_length() - 1))
                    if with_ids:
                        ids_out.append(piece.astype(np.int32))
                    start += length
                    number += 1
            table = np.array(columns, dtype=np.int64).reshape(-1, 7)
            arrays = [batch.column("kept").take(pa.array(of, pa.int64()))]
            arrays += [pa.array(table[:, k]) for k in range(6)] + [pa.array(table[:, 6].astype(np.int32))]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            names = ["kept", *[x.split()[0] for x in _PIECE.split(", ")], *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = source.mapInArrow(rows, schema)
    return out.select("kept.*", *[c for c in out.columns if c != "kept"])


def write_buckets(docs: DataFrame, path: str, **settings) -> None:
    """The pieces with their ids as Parquet under path/bucket=K: sequences of one
    length lie together, so a batch of any bucket needs no padding.

    Null and empty texts are one piece, the end mark; repeated rows are packed each; an
    empty table gives an empty folder.  Rows of a bucket come together in few files, large
    buckets in several."""
    pack(docs, with_ids=True, **settings).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
