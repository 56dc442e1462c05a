"""Substring dedup: fixed-length windows of words that start more than once are removed.

Every window of WINDOW words has a Rabin-Karp hash, rolled over the hashes of its
words.  Equal windows meet by their key (see ``repeats``) and are counted there
by hash in Spark; repeated windows of a text merge into maximal removal
intervals.  Two windows count as equal if both their 64-bit hash and the 64-bit
hash of their least gram are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.repeats import RUN_WINDOWS, covered, fresh_rows, places, repeated, run_bounds, salts, sliding_least, spans
from millrace.llm.shingles import hashed, mixed, rolled

#: Words of a window, and of the grams whose least hash is its key.
WINDOW, GRAM = 35, 7
_RESULT = "n_words long, n_removed long, kept_sha256 string, kept string, starts array<long>, ends array<long>"


def _grams(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gram = mixed(rolled(values, GRAM), 35)
    return gram, sliding_least(gram, WINDOW - GRAM + 1)


def word_grams(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's grams and the keys of its windows (none if it has fewer words than a window)."""
    words = body.split()
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return _grams(hashed(words))


def _runs(texts: DataFrame, total: int) -> DataFrame:
    """(key, salt, rid, at, hashes): neighbouring windows with one repeated key and their Rabin-Karp hashes."""
    kinds = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("rid", pa.int64()), ("at", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in it:
            rids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rid, tag, fresh, body, keys, spread in zip(rids, tags, fresh_rows(seen, rids, tags), *batch.columns[2:], strict=True):
                if not fresh:
                    continue
                values = hashed(body.as_py().split())
                if len(values) < WINDOW:
                    continue
                wanted = np.asarray(keys.values, np.int64).view(np.uint64)
                order = np.argsort(wanted)
                wanted, parts = wanted[order], np.asarray(spread.values, np.int32)[order]
                key = _grams(values)[1]
                place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                good = wanted[place] == key
                starts = run_bounds(key, RUN_WINDOWS)[0]
                starts = starts[good[starts]]
                if not len(starts):
                    continue
                h = mixed(rolled(values, WINDOW))[good].view(np.int64)
                offsets = np.concatenate((np.cumsum(good)[starts] - 1, [len(h)])).astype(np.int32)
                salt = salts(rid, starts, parts[place[starts]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[starts].view(np.int64)), pa.array(salt), pa.array(np.full(len(starts), rid)), pa.array(starts + tag), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))],
                    schema=kinds,
                )

    made = texts.select("rid", "tag", "body", "keys", "spread").mapInArrow(make, "key long, salt int, rid long, at long, hashes array<long>")
    return made.repartition("key", "salt")


def _marks(runs: DataFrame) -> DataFrame:
    """(rid, at) of windows whose hash occurs again under their key.

    Keys in one part only are counted there.  Windows of a key that is dealt out
    are counted in their part; one of each hash and part then meets at (key,
    hash), so at most as many rows as there are parts.
    """
    each = runs.select("key", "salt", "rid", "at", F.posexplode("hashes").alias("step", "h"))
    here = Window.partitionBy("key", "salt", "h")
    counted = each.select("key", "h", "rid", (F.col("at") + F.col("step")).alias("at"), F.count("*").over(here).alias("n"), F.when(F.col("salt") >= 0, F.row_number().over(here.orderBy("rid", F.col("at") + F.col("step")))).alias("nth"))
    second = counted.filter(F.col("nth") == 1).withColumn("parts", F.count("*").over(Window.partitionBy("key", "h")))
    return counted.filter(F.col("n") > 1).select("rid", "at").union(second.filter((F.col("parts") > 1) & (F.col("n") == 1)).select("rid", "at"))


def _remove(body: Column, copied: Column, told: Column, keep: bool) -> Column:
    @F.pandas_udf(_RESULT)
    def removed(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for bodies, flags, lists in parts:
            rows = []
            for data, whole, marks in zip(bodies, flags, lists, strict=True):
                words = data.split()
                n = len(words)
                if whole:
                    mask = np.full(n, n >= WINDOW)
                else:
                    starts = places(marks)
                    mask = covered(starts, starts + WINDOW, n)
                kept = b" ".join([w for w, gone in zip(words, mask.tolist(), strict=True) if not gone] if mask.any() else words)
                a, b = spans(mask)
                rows.append((n, int(mask.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep else None, a.tolist(), b.tolist()))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept", "starts", "ends"])

    return removed(body, copied, told)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with a struct ``removed``: n_words, n_removed, kept_sha256, kept (the text left, if asked for), starts and ends of removed intervals.

    Words are what stands between ASCII white space.  A word is removed if a
    window of 35 words that covers it also starts anywhere else; all windows are
    judged on the input.  Null and empty texts have no words; a repeated row is
    one more copy of its text; null identifiers stay null, and their rows are
    judged by their texts like any other.  Texts of any length are read whole; an
    empty table gives no rows.  Columns of ``docs`` other than the two named are
    passed through, whatever they are called.
    """
    fresh = {c: f"in_{i}" for i, c in enumerate(docs.columns)}  # so that no column clashes with the operator's own
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in fresh.items()))
    made = repeated(inner, word_grams, _runs, _marks, fresh[id_col], fresh[text_col])
    made = made.select(*fresh.values(), _remove(F.col("body"), F.col("copied"), F.col("told"), keep).alias("removed"))
    return made.select(*(F.col(n).alias(c) for c, n in fresh.items()), "removed")


#: The query's rows in DuckDB's SQL.
ORACLE = r"""
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) i from d),
h as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) h from p),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) n from h) where n > 1),
c as (select distinct doc_id, unnest(range(i, i + 35)) j from r),
e as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) j from d),
k as (select e.doc_id, count(*) n, string_agg(x, ' ' order by e.j) t from e left join c on c.doc_id = e.doc_id and c.j = e.j where c.j is null group by e.doc_id)
select d.doc_id, len(w) n_words, len(w) - coalesce(k.n, 0) n_removed, sha256(coalesce(k.t, '')) kept_sha256 from d left join k on k.doc_id = d.doc_id
"""
