"""Sum-of-squares online packing of token sequences.

Open sequences are counted by how full they are: ``level[h]`` holds those with h
tokens, for 0 < h < capacity.  A piece of s tokens may start a new sequence or
go on top of an open one of level h <= capacity - s.  It goes where the sum of
squares of the counts, over the partly filled levels, ends up least:

    new sequence:  + 2 n[s] + 1                     (nothing, if s = capacity)
    onto level h:  - 2 n[h] + 1   and + 2 n[h+s] + 1 (nothing, if h + s = capacity)

Ties go to the fullest level.  Documents longer than a sequence are cut into
whole sequences and a rest.  Each task packs the documents that it reads, so
nothing is shuffled.  At its end the level array is settled: the fullest open
sequence takes the largest pieces that fit from the emptiest ones, and a part of
a piece only where no whole one fits, until one open sequence is left.  So a task
leaves one sequence with padding at most, and most pieces stay where the sum of
squares put them.  A sequence identifier holds the task's partition in its upper
bits; a task that is run again gives the same ones, since it reads the same split
in the same order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.arrow import id_and_bytes
from millrace.llm.vocabulary import default_vocabulary, word_memo

#: Bits of a sequence identifier below the partition's number.
SEQUENCE_BITS = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class SumOfSquares:
    """The level array and its open sequences; pieces are opaque to it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # counts[0] and counts[capacity] stay 0
        self.level: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.moved = 0

    def choose(self, size: int) -> int:
        """The level to put a piece of ``size`` tokens on; 0 is a new sequence."""
        n, most = self.counts, self.capacity - size
        cost = np.full(most + 1, np.iinfo(np.int64).max)
        at = np.flatnonzero(n[1 : most + 1]) + 1
        top = 2 * n[at + size] + 1
        top[at == most] = 0
        cost[at] = top - 2 * n[at] + 1
        cost[0] = 0 if most == 0 else 2 * n[size] + 1
        return most - int(np.argmin(cost[::-1]))

    def place(self, size: int, piece: tuple) -> list | None:
        """Place a piece; returns the sequence's pieces if it is now full."""
        h = self.choose(size)
        sequence = [] if h == 0 else self.level[h].pop()
        if h:
            self.counts[h] -= 1
        sequence.append(piece)
        if h + size == self.capacity:
            return sequence
        self.level[h + size].append(sequence)
        self.counts[h + size] += 1
        return None

    def settle(self, size_of: Callable[[tuple], int], split: Callable[[tuple, int], tuple[tuple, tuple]]) -> Iterator[list]:
        """The open sequences, filled from the emptiest of them; all but the last are full.  They are open no more.

        ``split`` cuts a piece into one of so many tokens and the rest.  ``moved``
        counts the tokens that changed their sequence.
        """
        order = [x for h in range(self.capacity - 1, 0, -1) for x in self.level[h]]  # fullest first
        self.level = [[] for _ in self.level]
        self.counts[:] = 0
        loose: list[tuple[int, int, tuple]] = []  # pieces of the emptiest sequences that were dissolved, by size
        tie = 0
        at, past = 0, len(order)
        while at < past:
            sequence = order[at]
            at += 1
            room = self.capacity - sum(map(size_of, sequence))
            while room:
                if not loose or loose[0][0] > room and at < past and sum(x[0] for x in loose) < 2 * self.capacity:
                    if at == past:
                        break
                    past -= 1
                    for piece in order[past]:
                        insort(loose, (size_of(piece), tie, piece))
                        tie += 1
                    continue
                k = bisect_right(loose, room, key=lambda x: x[0]) - 1
                if k >= 0:
                    size, _, piece = loose.pop(k)
                else:
                    _, _, whole = loose.pop()
                    piece, left = split(whole, room)
                    insort(loose, (size_of(left), tie, left))
                    size, tie = room, tie + 1
                sequence.append(piece)
                room -= size
                self.moved += size
            yield sequence
        while loose:  # the sequences that were dissolved last
            sequence, room = [], self.capacity
            while room and loose:
                k = bisect_right(loose, room, key=lambda x: x[0]) - 1
                size, _, piece = loose.pop(k)
                if size > room:
                    piece, left = split(piece, room)
                    insort(loose, (size_of(left), tie, left))
                    size, tie = room, tie + 1
                sequence.append(piece)
                room -= size
                self.moved += size
            yield sequence


def pack_pieces(documents: Iterator[tuple[int | None, bytes]], capacity: int, first_id: int, packer: SumOfSquares | None = None) -> Iterator[list[tuple]]:
    """Sequences of (doc_id, start, ids, doc_tokens, sequence_id, offset) rows from (doc_id, ids) pairs, ids as bytes."""
    packer, wide = packer or SumOfSquares(capacity), 4 * capacity
    number = first_id

    def lay(pieces: list[tuple]) -> list[tuple]:
        nonlocal number
        rows, offset = [], 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, ids, total, number, offset))
            offset += len(ids) // 4
        number += 1
        return rows

    for doc_id, ids in documents:
        total = len(ids) // 4
        for at in range(0, len(ids), wide):
            piece = ids[at : at + wide]
            full = packer.place(len(piece) // 4, (doc_id, at // 4, piece, total))
            if full is not None:
                yield lay(full)

    def split(piece: tuple, tokens: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[: 4 * tokens], total), (doc_id, start + tokens, ids[4 * tokens :], total)

    for sequence in packer.settle(lambda piece: len(piece[2]) // 4, split):
        yield lay(sequence)


def pack_documents(docs: DataFrame, capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and ``ids`` if asked for.

    A document is the ids of its text and then ``end_id``, so an empty or null
    text is one id and nothing is lost; a text of any length is packed whole.
    Repeated rows are packed each, rows without an identifier with a null one.
    An empty table gives no sequences.  Other columns are never read.
    """
    path = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()
    kinds = pa.schema([(n, pa.int64()) for n in _NAMES] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(path)

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for batch in it:
                for doc_id, body in zip(batch.column(0), batch.column(1), strict=True):
                    yield doc_id.as_py(), memo.encode(body.as_py()) + end

        rows: list[tuple] = []
        for sequence in pack_pieces(documents(), capacity, TaskContext.get().partitionId() << SEQUENCE_BITS):
            for doc_id, start, ids, total, number, offset in sequence:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, number, offset, *([np.frombuffer(ids, "<u4").tolist()] if with_ids else [])))
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(batches, SCHEMA + (", ids array<long>" if with_ids else ""))
