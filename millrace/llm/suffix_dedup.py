"""Suffix-array dedup of byte strings: a logarithmic family of suffix arrays.

Windows of WINDOW bytes that may repeat meet by their key (see ``repeats``), as
runs of neighbouring windows with their bytes.  Keys are dealt out to groups; a
task reads the runs of a group in the order of the documents and feeds them, in
batches, to the group's ``IndexFamily``.  A new batch is scanned against the
existing levels: a run that a level holds whole is a match of all its windows;
the others get a suffix array over their windows' starts (suffixes compared by
their first WINDOW bytes, more never matters), which is merge-scanned against
each level for matches that long.  Then it becomes a level, and two levels of one
size are merged, so n batches make at most log2(n) + 1 levels.

A family lives as long as its group, across all documents; windows of different
groups differ.  Groups hold about GROUP_RUNS runs, which bounds a family's
memory; a key with more runs than KEY_ROWS is dealt out over several groups,
whose windows meet once more by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.repeats import RUN_WINDOWS, covered, fresh_rows, places, repeated, run_bounds, salts, sliding_least, spans
from millrace.llm.shared import cut
from millrace.llm.shingles import mixed, rolled

#: Bytes of a window, and of the grams whose least hash is its key.
WINDOW, GRAM = 200, 32
#: Bytes of runs in a batch, and about how many runs make a group of keys.
BATCH_BYTES, GROUP_RUNS = 1 << 15, 1_000
#: Bytes of a text that are hashed at once, and runs of a text sent at once.
BLOCK, PIECES = 1 << 21, 10_000
_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, starts array<long>, ends array<long>"


def byte_grams(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's grams and the keys of its windows (none if it is shorter than a window)."""
    if len(body) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    raw = np.frombuffer(body, np.uint8)
    grams = [mixed(rolled(raw[at : at + BLOCK + GRAM - 1].astype(np.uint64) + np.uint64(1), GRAM), 200) for at in range(0, len(raw) - GRAM + 1, BLOCK)]
    gram = grams[0] if len(grams) == 1 else np.concatenate(grams)
    return gram, sliding_least(gram, WINDOW - GRAM + 1)


class SuffixArray:
    """Windows in the order of their bytes: ``rows`` (sorted), ``owners`` (entry << 32 | step) and whether each occurs again; ``whole``: run -> its entry."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray, again: np.ndarray, whole: dict[bytes, int]):
        self.rows, self.owners, self.again, self.whole = rows, owners, again, whole

    @classmethod
    def of(cls, whole: dict[bytes, int]) -> SuffixArray:
        """Sort the windows of different runs; equal neighbours occur again."""
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        n = sizes - WINDOW + 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        owners = np.repeat(np.fromiter(whole.values(), np.int64, len(whole)), n) * (1 << 32) + step
        starts = np.repeat(np.cumsum(sizes) - sizes, n) + step
        text = np.frombuffer(b"".join(whole), np.uint8)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[starts]).view(f"S{WINDOW}").ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        again, same = np.zeros(len(rows), bool), rows[1:] == rows[:-1]
        again[1:] |= same
        again[:-1] |= same
        return cls(rows, owners[order], again, whole)

    def scan(self, new: SuffixArray) -> np.ndarray:
        """Mark, in both, the windows that occur in both; returns where the new ones go among the old."""
        at = np.searchsorted(self.rows, new.rows)
        inside = at < len(self.rows)
        hit = inside & (self.rows[np.minimum(at, len(self.rows) - 1)] == new.rows)
        new.again |= hit
        if hit.any():
            # all equals of the first one found, up to the end of their run in the order
            first = np.concatenate(([True], self.rows[1:] != self.rows[:-1]))
            group = np.cumsum(first) - 1
            marked = np.zeros(group[-1] + 1, bool)
            marked[group[at[hit]]] = True
            self.again |= marked[group]
        return at

    def merge(self, other: SuffixArray) -> SuffixArray:
        at = self.scan(other) + np.arange(len(other.rows))
        mine = np.ones(len(self.rows) + len(other.rows), bool)
        mine[at] = False
        made = [np.empty(len(mine), x.dtype) for x in (self.rows, self.owners, self.again)]
        for out, a, b in zip(made, (self.rows, self.owners, self.again), (other.rows, other.owners, other.again), strict=True):
            out[mine], out[~mine] = a, b
        return SuffixArray(*made, self.whole | other.whole)


class IndexFamily:
    """Levels of suffix arrays: ``levels[k]`` is None or what 2**k batches brought.

    ``places[e]`` lists where the run with entry e stands; ``by_batch`` and
    ``by_levels`` count the windows marked inside their batch and by levels.
    """

    def __init__(self) -> None:
        self.levels: list[SuffixArray | None] = []
        self.places: list[list[tuple[int, int]]] = []
        self.by_batch = self.by_levels = 0

    def _held(self, piece: bytes) -> int | None:
        return next((e for level in self.levels if level is not None and (e := level.whole.get(piece)) is not None), None)

    def add(self, batch: list[tuple[bytes, tuple[int, int]]]) -> None:
        """Scan a batch of (run, place) against the levels and make a level of what is new."""
        fresh: dict[bytes, int] = {}
        for piece, place in batch:
            entry = self._held(piece)
            if entry is not None:
                self.by_levels += len(piece) - WINDOW + 1
            elif (entry := fresh.get(piece)) is not None:
                self.by_batch += len(piece) - WINDOW + 1
            else:
                entry = fresh[piece] = len(self.places)
                self.places.append([])
            self.places[entry].append(place)
        if not fresh:
            return
        new = SuffixArray.of(fresh)
        inside = int(new.again.sum())
        for level in self.levels:
            if level is not None:
                level.scan(new)
        self.by_batch += inside
        self.by_levels += int(new.again.sum()) - inside
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            new, self.levels[k] = self.levels[k].merge(new), None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = new

    def different(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One of each different window: its bytes, rid and at, and whether it occurs once."""
        levels = [x for x in self.levels if x is not None]
        if not levels:
            return np.zeros(0, f"S{WINDOW}"), *(np.zeros(0, k) for k in (np.int64, np.int64, bool))
        whole = reduce(lambda a, b: a.merge(b), levels)
        first = np.concatenate(([True], whole.rows[1:] != whole.rows[:-1]))
        which, step = whole.owners[first] >> 32, whole.owners[first] & ((1 << 32) - 1)
        counts = np.fromiter(map(len, self.places), np.int64, len(self.places))
        place = np.array([x[0] for x in self.places], np.int64).reshape(-1, 2)[which]
        return whole.rows[first], place[:, 0], place[:, 1] + step, ~whole.again[first] & (counts[which] == 1)

    def marked(self) -> tuple[np.ndarray, np.ndarray]:
        """(rid, at) of the windows that occur again."""
        counts = np.fromiter(map(len, self.places), np.int64, len(self.places))
        found = [x.owners[x.again | (counts[x.owners >> 32] > 1)] for x in self.levels if x is not None]
        owners = np.concatenate(found) if found else np.zeros(0, np.int64)
        which, step = owners >> 32, owners & ((1 << 32) - 1)
        flat = np.array([x for places in self.places for x in places], np.int64).reshape(-1, 2)
        times = counts[which]
        index = np.repeat((np.cumsum(counts) - counts)[which], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        return flat[index, 0], flat[index, 1] + np.repeat(step, times)


def _runs(texts: DataFrame, total: int) -> DataFrame:
    """(group, key, salt, rid, at, piece): neighbouring windows with one repeated key, as the bytes that they cover."""
    kinds = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("rid", pa.int64()), ("at", pa.int64()), ("piece", pa.binary())])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in it:
            rids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rid, tag, fresh, body, keys, spread in zip(rids, tags, fresh_rows(seen, rids, tags), *batch.columns[2:], strict=True):
                if not fresh:
                    continue
                data = body.as_py()
                key = byte_grams(data)[1]
                if not len(key):
                    continue
                wanted = np.asarray(keys.values, np.int64).view(np.uint64)
                order = np.argsort(wanted)
                wanted, parts = wanted[order], np.asarray(spread.values, np.int32)[order]
                starts, ends = run_bounds(key, RUN_WINDOWS)
                place = np.minimum(np.searchsorted(wanted, key[starts]), len(wanted) - 1)
                good = wanted[place] == key[starts]
                starts, ends, place = starts[good], ends[good], place[good]
                for i in range(0, len(starts), PIECES):
                    first, past, which = starts[i : i + PIECES], ends[i : i + PIECES], place[i : i + PIECES]
                    pieces = [data[a : b + WINDOW - 1] for a, b in zip(first.tolist(), past.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(salts(rid, first, parts[which])), pa.array(np.full(len(first), rid)), pa.array(first + tag), pa.array(pieces, pa.binary())], schema=kinds)

    made = texts.select("rid", "tag", "body", "keys", "spread").mapInArrow(make, "key long, salt int, rid long, at long, piece binary")
    groups = max(1, -(-total // GROUP_RUNS))
    # a key that is dealt out has a group for each part
    group = F.when(F.col("salt") < 0, F.pmod(F.col("key"), F.lit(groups).cast("long"))).otherwise(F.xxhash64("key", "salt"))
    return made.select(group.alias("group"), "key", "salt", "rid", "at", "piece").repartition("group")


def _spans_of(rid: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Neighbouring marked starts of a text as (rid, first, past the last)."""
    order = np.lexsort((at, rid))
    rid, at = rid[order], at[order]
    new = np.concatenate(([True], (rid[1:] != rid[:-1]) | (at[1:] > at[:-1] + 1))) if len(rid) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    last = np.concatenate((start[1:], [len(rid)])) - 1 if len(rid) else start
    return [rid[start], at[start], at[last] + 1]


def _met(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by group, then by document -> (rid, at, past): spans of starts of repeated windows.

    For the parts of a key that is dealt out, also one row (rid, at, h1, h2, alone)
    for each different window: 128 bits of it, and whether it stands there once.
    """
    kinds = pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("past", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("alone", pa.bool_())])

    def close(family: IndexFamily, part: bool) -> Iterator[pa.RecordBatch]:
        spans_ = _spans_of(*family.marked())
        yield pa.RecordBatch.from_arrays([*map(pa.array, spans_), *(pa.nulls(len(spans_[0]), k) for k in kinds.types[3:])], schema=kinds)
        if part:
            rows, rid, at, alone = family.different()
            for i in range(0, len(rows), PIECES):
                h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, rows[i : i + PIECES].tolist())), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(rid[i : i + PIECES]), pa.array(at[i : i + PIECES]), pa.nulls(len(h), pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(alone[i : i + PIECES])], schema=kinds)

    family, last, part, waiting, held = IndexFamily(), None, False, [], 0
    for batch in it:
        group, salt, rid, at = (c.to_pylist() for c in batch.columns[:4])
        for i, piece in enumerate(batch.column(4).to_pylist()):
            now = group[i], salt[i] >= 0
            if now != (last, part) or held >= BATCH_BYTES:
                family.add(waiting)
                waiting, held = [], 0
            if now != (last, part):
                yield from close(family, part)
                family, (last, part) = IndexFamily(), now
            waiting.append((piece, (rid[i], at[i])))
            held += len(piece)
    family.add(waiting)
    yield from close(family, part)


def _marks(runs: DataFrame) -> DataFrame:
    """(rid, at, past) of repeated windows.

    What meets in a group is judged by its suffix arrays.  A key that is dealt out
    to several groups may repeat across them: of its windows, one of each content
    and group is counted by its hash at a second meeting.
    """
    ordered = runs.select("group", "salt", "rid", "at", "piece").sortWithinPartitions("group", "salt", "rid", "at")
    made = cut(ordered.mapInArrow(_met, "rid long, at long, past long, h1 long, h2 long, alone boolean"))
    parts = made.filter(F.col("h1").isNotNull()).withColumn("parts", F.count("*").over(Window.partitionBy("h1", "h2")))
    far = parts.filter((F.col("parts") > 1) & F.col("alone")).select("rid", "at", (F.col("at") + 1).alias("past"))
    return made.filter(F.col("past").isNotNull()).select("rid", "at", "past").union(far)


def _remove(body: Column, copied: Column, told: Column, told_past: Column, keep: bool) -> Column:
    @F.pandas_udf(_RESULT)
    def removed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for bodies, flags, firsts, pasts in parts:
            rows = []
            for data, whole, first, past in zip(bodies, flags, firsts, pasts, strict=True):
                n = len(data)
                if whole:
                    mask = np.full(n, n >= WINDOW)
                else:
                    mask = covered(places(first), places(past) - 1 + WINDOW, n)
                a, b = spans(mask)
                kept = bytes(np.frombuffer(data, np.uint8)[~mask]) if len(a) else data
                rows.append((n, int(mask.sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if keep else None, a.tolist(), b.tolist()))
            yield pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "starts", "ends"])

    return removed(body, copied, told, told_past)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with a struct ``removed``: n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, if asked for), starts and ends of removed runs.

    A byte is removed if a 200-byte string that covers it also starts anywhere
    else in the UTF-8 texts; matches never cross texts, and all are judged on the
    input.  Null and empty texts have no bytes; a repeated row is one more copy
    of its text; null identifiers stay null, and their rows are judged by their
    texts like any other.  Texts of any length are read whole; an empty table
    gives no rows.  Other columns of ``docs`` are passed through, whatever they
    are called.
    """
    fresh = {c: f"in_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the operator's own
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in fresh.items()))
    made = repeated(inner, byte_grams, _runs, _marks, fresh[id_col], fresh[text_col])
    made = made.select(*fresh.values(), _remove(F.col("body"), F.col("copied"), F.col("told"), F.col("told_past"), keep).alias("removed"))
    return made.select(*(F.col(n).alias(c) for c, n in fresh.items()), "removed")


#: The query's rows in DuckDB's SQL, on the texts in hexadecimal.
ORACLE = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) x, strlen(coalesce(text, '')) n from documents),
p as (select doc_id, unnest(range(0, greatest(n - 199, 0))) i from d),
h as (select p.doc_id, i, md5(substr(x, 2 * i + 1, 400)) h from p join d using (doc_id)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) c from h) where c > 1),
g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end fresh from r),
s as (select doc_id, min(i) a, max(i) + 200 b from (select doc_id, i, sum(fresh) over (partition by doc_id order by i) k from g) group by doc_id, k),
e as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) before from s),
k as (select e.doc_id, count(*) n_spans, sum(b - a) n_removed, max(b) past, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) kept from e join d using (doc_id) group by e.doc_id)
select d.doc_id, n n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, coalesce(n_spans, 0) n_spans,
  sha256(unhex(case when k.doc_id is null then x else kept || substr(x, 2 * past + 1) end)) kept_sha256
from d left join k on k.doc_id = d.doc_id
"""
