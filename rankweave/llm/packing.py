"""Harmonic packing of documents into sequences of a fixed capacity.

A document of a length in (C/(k+1), C/k] is of class k and goes whole into the bin of its class, which takes k of them;
lengths up to the grain are the last class, filled next-fit.  Only what closes the room that a bin then has left is cut:
the next documents go there, and the rest of the one that does not fit is packed by its own length.  A document longer than C
gives pieces of C first.  What a task has left at its end is closed in sequences whose lengths are powers of two, so no sequence
needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from rankweave.llm.common import id_and_text
from rankweave.llm.word_tokens import encode_text

LOCAL_BITS = 36  # sequences of one task; the task's number stands above them
FLUSH = 4096
COLUMNS = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Open bins of one task.  A piece is (doc_id, start, ids, doc_tokens); ``placed`` receives finished rows."""

    def __init__(self, capacity: int, grain: int, first_sequence: int):
        if capacity & (capacity - 1) or grain & (grain - 1) or not 0 < grain <= capacity:
            raise ValueError("capacity and grain must be powers of two, grain at most the capacity")
        self.capacity, self.next_sequence = capacity, first_sequence
        self.last = capacity // grain
        self.open = {k: [] for k in range(1, self.last + 1)}
        self.tail = 0  # ids in the bin of the last class
        self.closing, self.room = [], 0  # the bin that has its documents, and what it has left
        self.placed = []

    def _close(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.placed.append((doc_id, start, len(ids), ids.tobytes(), total, self.next_sequence, offset))
            offset += len(ids)
        self.next_sequence += 1

    def _fill(self, k: int) -> None:
        """Closes the bin of class k, or leaves its room to what comes next."""
        bin_, self.open[k] = self.open[k], []
        room = self.capacity - sum(len(p[2]) for p in bin_)
        if room:
            self.closing, self.room = bin_, room
        else:
            self._close(bin_)

    def _put(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            if self.room:
                now = ids[:self.room]
                self.closing.append((doc_id, start, now, total))
                start, ids, self.room = start + len(now), ids[len(now):], self.room - len(now)
                if not self.room:
                    self._close(self.closing)
                    self.closing = []
                continue
            k = min(self.capacity // len(ids), self.last)
            if k == self.last:
                if self.tail + len(ids) > self.capacity:
                    self._fill(k)
                    self.tail = 0
                self.tail += len(ids)
            self.open[k].append((doc_id, start, ids, total))
            if k < self.last and len(self.open[k]) == k:
                self._fill(k)
            return

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            self._close([(doc_id, at, ids[at:at + self.capacity], total)])
            at += self.capacity
        self._put(doc_id, at, ids[at:], total)

    def finish(self) -> None:
        """Closes the bins that are not full: one after the other in full sequences, the rest by the binary digits of its length."""
        rest = self.closing + [p for bin_ in self.open.values() for p in bin_]
        left, size, now, room = sum(len(p[2]) for p in rest), self.capacity, [], 0
        for doc_id, start, ids, total in rest:
            while len(ids):
                if not room:
                    while size > left:
                        size //= 2
                    room = size
                    left -= size
                now.append((doc_id, start, ids[:room], total))
                start, ids, room = start + len(now[-1][2]), ids[room:], room - len(now[-1][2])
                if not room:
                    self._close(now)
                    now = []

    def take(self) -> list[tuple]:
        rows, self.placed = self.placed, []
        return rows


def pack(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, grain: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Every task packs the rows it reads on its own, without a shuffle, and holds at most one open bin per class.  If a
    task runs again, its rows are replaced as a whole, so each id still lies in exactly one piece.  A null or empty text
    is the end id alone; null and repeated doc_ids are packed row by row like any others; an empty table has no pieces.
    """
    source = id_and_text(docs, id_col, text_col)
    schema = StructType([
        StructField("doc_id", source.schema["doc_id"].dataType), StructField("start", LongType()),
        StructField("length", LongType()), StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()), StructField("offset", LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, grain, TaskContext.get().partitionId() << LOCAL_BITS)
        kind = pa.int64()

        def out() -> pa.RecordBatch:
            rows = packer.take()
            arrow = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(arrow)], COLUMNS)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                packer.add(doc_id, encode_text(text.as_py(), tokenizer_path, end_id))
                if len(packer.placed) >= FLUSH:
                    yield out()
        packer.finish()
        if packer.placed:
            yield out()

    return source.mapInArrow(run, schema)
