"""Packing tokenised documents into sequences: bounded-space online best fit.

A document of more than ``capacity`` tokens is cut into full pieces, each a sequence of its own; the
rest of it, its first piece, and every shorter document are items. An item goes to the open bin with
the least free space that holds it. Open bins stand in a bitset keyed by free space, so this is one
shift and one lowest bit; their number is fixed, and where another bin must open, the fullest closes.
Items are placed as they arrive, with a look-ahead of a fixed number of items: those that wait go from long to
short, then the next ones are taken up. Without look-ahead a fiftieth of the space stays empty.

Scale: tokenising is a map without a shuffle and leaves some 40 bytes a piece, written once; only
those small rows are dealt out, evenly, into groups of about ``group_items`` items that pack alone. Within a
group items arrive from long to short, so small ones fill what long ones leave; a group's last bins
are the only loss.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .textbuf import pieces as runs

CAPACITY, END_ID, OPEN_BINS, LOOK_AHEAD, GROUP_ITEMS = 1024, 2, 512, 512, 131072
_PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "piece", "start", "length", "ids_crc32")])


class BestFit:
    """Online best fit into bins of ``capacity`` with at most ``open_bins`` open ones."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = self.opened = self.now_open = 0

    def _pop(self, free: int) -> int:
        found = self.levels[free].pop()
        if not self.levels[free]:
            self.mask &= ~(1 << free)
        self.now_open -= 1
        return found

    def add(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item of ``0 < size <= capacity``."""
        if fits := self.mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            at = self._pop(free)
        else:
            if self.now_open >= self.open_bins:
                self._pop((self.mask & -self.mask).bit_length() - 1)
            at, free, self.opened = self.opened, self.capacity, self.opened + 1
        if left := free - size:
            self.levels[left].append(at)
            self.mask |= 1 << left
            self.now_open += 1
        return at, self.capacity - free


    def add_all(self, sizes: np.ndarray, look_ahead: int = LOOK_AHEAD) -> np.ndarray:
        """Bins and offsets of items that arrive in this order, ``look_ahead`` of them at a time from long to short."""
        out = np.zeros((len(sizes), 2), np.int64)
        for a in range(0, len(sizes), look_ahead):
            for i in (a + np.argsort(-sizes[a : a + look_ahead], kind="stable")).tolist():
                out[i] = self.add(int(sizes[i]))
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces of ``n`` tokens: the first takes the remainder."""
    first = n % capacity or capacity
    return [(0, first), *((a, a + capacity) for a in range(first, n, capacity))]


def token_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", *, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids`` of every piece.

    ``path`` is the vocabulary file, which every worker can read. A null text counts as empty: the end
    id alone. Repeated rows and null keys stay as they are; an empty table gives no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import Tokens

        tokens = Tokens(path)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for first, last, _, _ in runs(column):
                out, kept = [], []
                texts = column.slice(first, last - first).to_pylist()
                for doc, ids in zip(batch.column(0).slice(first, last - first).to_pylist(), tokens.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for i, (a, b) in enumerate(cut(len(ids), capacity)):
                        out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())))
                        if with_ids:
                            kept.append(ids[a:b].astype(np.int32))
                cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], [*_PIECE.names, *["ids"] * with_ids])

    schema = T.StructType([*_PIECE.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def pack_pieces(parts: DataFrame, *, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, look_ahead: int = LOOK_AHEAD, group_items: int = GROUP_ITEMS) -> DataFrame:
    """All rows of ``parts`` (a stored table with ``length``) with ``sequence_id`` and ``offset``.

    Full pieces have odd sequence numbers, packed sequences even ones.
    """
    full = parts.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = parts.where(F.col("length") < capacity)
    groups = max(1, -(-items.count() // group_items))
    arrival = F.xxhash64(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in parts.columns])
    dealt = items.repartition(groups).withColumn("_group", F.spark_partition_id()).sortWithinPartitions(arrival)
    where = dealt.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_bins)
        for batch in batches:
            group = batch.column(batch.num_columns - 1).to_numpy()
            placed = bins.add_all(batch.column(where).to_numpy(), look_ahead)
            ids = (placed[:, 0] + (group.astype(np.int64) << 40)) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids), pa.array(placed[:, 1])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return full.unionByName(dealt.mapInArrow(run, full.schema))


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """Pieces of all documents with their sequence and place; see :func:`token_pieces` for edge cases."""
    own = {k: options.pop(k) for k in ("end_id", "path", "with_ids") if k in options}
    parts = materialize(token_pieces(docs, text, key, capacity=options.get("capacity", CAPACITY), **own), "pieces")
    return pack_pieces(parts, **options)


def query(spark, sf_dir: str) -> DataFrame:
    """``op4_pack_documents``: all documents in sequences of at most 1024 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
