"""Finding what repeats: windows of a fixed length that start more than once in a corpus.

Shared by the operators that remove repeated windows of words or of bytes.

A window's *key* is the least hash of the short grams inside it, so windows with
equal content have equal keys, and neighbouring windows mostly share one.  A key
that occurs once in the corpus (at one place of one document) can't belong to a
repeated window.  The steps:

1. each text gives its distinct keys; keys are counted over all texts;
2. texts that are equal as a whole form classes; one text stands for its class,
   and windows of a text that has copies are all repeated;
3. texts with repeated keys give *runs*: neighbouring windows with one such key;
   runs meet by key, and whatever repeats there is marked;
4. the marks come back to the texts.

The whole texts are shuffled once, by identifier, and that exchange is used by
steps 3 and 4.  Keys with very many occurrences are dealt out over several
tasks (``salt``), and one run or window of each task stands for it at a second
meeting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.arrow import ship
from millrace.llm.shared import cut, release

#: Runs under one key that may meet in one task, and the most windows of a run: a longer one is cut into several.
KEY_ROWS, RUN_WINDOWS = 1_000, 256
#: A place in a text and 31 bits of the text's hash share a long.
PLACES = 1 << 32


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size, part = 1, values
    while 2 * size <= width:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[:n], part[width - size : width - size + n])


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Places where a key differs from the one before."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))


def run_bounds(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of neighbouring windows with one key, none of more than ``most`` windows."""
    starts = run_starts(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    if (sizes > most).any():
        parts = -(-sizes // most)
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * most
    return starts, np.append(starts[1:], len(keys)) if len(starts) else starts


def salts(rid: int, starts: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """The part that each of a text's runs goes to under a key dealt out to ``spread`` tasks; -1 for a key with one."""
    own = (starts.astype(np.uint64) + np.uint64(rid & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
    return np.where(spread > 1, own.astype(np.int64) % np.maximum(spread.astype(np.int64), 1), -1).astype(np.int32)


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with rid (the identifier; without one, a hash of the text), k1 and k2 (128 bits of the text) and body (its bytes).

    Rows without an identifier are so dealt out by their texts.  Where a text's
    rid is that of others, by identifier or by hash, its tag tells them apart.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"rid": F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.lit(2), text)), "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text), "body": text.cast("binary")})


def text_keys(texts: DataFrame, grams: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(rid, k1, k2, keys, several): the distinct keys of each text, and how often each occurs in it: 2 at least if its gram does, else its runs.

    ``grams`` gives a text's gram hashes and its windows' keys.
    """
    kinds = pa.schema([("rid", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("keys", pa.list_(pa.int64())), ("several", pa.list_(pa.int32()))])

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found, several = [], []
            for body in batch.column(3):
                gram, key = grams(body.as_py())
                keys, runs = np.unique(key[run_bounds(key, RUN_WINDOWS)[0]], return_counts=True)
                at = np.searchsorted(keys, gram)
                hit = (at < len(keys)) & (keys[np.minimum(at, max(0, len(keys) - 1))] == gram) if len(keys) else np.zeros(len(gram), bool)
                several.append(np.maximum(np.minimum(np.bincount(at[hit], minlength=len(keys)), 2), runs).astype(np.int32))
                found.append(keys.view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, kinds.types[3]), pa.array(several, kinds.types[4])], schema=kinds)

    return texts.select("rid", "k1", "k2", "body").mapInArrow(make, "rid long, k1 long, k2 long, keys array<long>, several array<int>")


def _tag(k1: str = "k1"):
    return F.col(k1).bitwiseAND(F.lit((1 << 31) - 1).cast("long")) * F.lit(PLACES)


def candidates(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From text_keys: (rid, tag, keys, spread) of the texts with repeated keys, one a class; (rid, tag) of the texts with copies.

    ``tag`` tells texts under one identifier apart; ``spread`` is the number of
    tasks that a key's occurrences are dealt out to.
    """
    # written, so that joins with it are between plain exchanges, which Spark can split where a text has very many copies
    classes = cut(keyed.groupBy("k1", "k2").agg(F.min("rid").alias("first"), F.count("*").alias("copies")))
    known = keyed.select("rid", "k1", "k2").join(classes, ["k1", "k2"])
    copied = known.filter(F.col("copies") > 1).select("rid", _tag().alias("tag")).distinct()
    heads = classes.select(F.col("first").alias("rid"), "k1", "k2")
    own = keyed.join(heads, ["rid", "k1", "k2"], "left_semi").dropDuplicates(["rid", "k1", "k2"])
    rows = own.select("rid", _tag().alias("tag"), F.explode(F.arrays_zip("keys", "several")).alias("x")).select("rid", "tag", F.col("x.keys").alias("key"), F.col("x.several").alias("n"))
    counts = rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > 1).select("key", F.ceil(F.col("n") / KEY_ROWS).cast("int").alias("spread"))
    met = rows.drop("n").join(counts, "key")
    return met.groupBy("rid", "tag").agg(F.collect_list("key").alias("keys"), F.collect_list("spread").alias("spread")), copied


def places(told: list | None) -> np.ndarray:
    """The sorted places of told marks, which are all of one tag."""
    return np.zeros(0, np.int64) if told is None else np.sort(np.asarray(told, np.int64) % PLACES)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` elements lie between a start and its end."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(np.minimum(ends, size), minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def repeated(
    docs: DataFrame,
    grams: Callable[[bytes], tuple[np.ndarray, np.ndarray]],
    runs: Callable[[DataFrame, int], DataFrame],
    marks: Callable[[DataFrame], DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with rid, k1, body, tag, copied (whether the whole text has copies) and told (marked window starts with the tag added).

    ``runs`` turns (rid, tag, body, keys, spread), and about how many runs they
    give, into rows that meet by key;
    ``marks`` turns those into (rid, at), repeated windows, or (rid, at, past),
    runs of them; the latter give a column told_past as well.
    """
    texts = keyed_texts(docs, id_col, text_col)
    keyed = cut(text_keys(texts, grams))
    wanted, copied = candidates(keyed)
    wanted = cut(wanted)
    total = wanted.agg(F.sum(F.size("keys"))).first()[0] or 0
    release(docs.sparkSession)  # the keys' shuffles aren't needed beside those of the texts

    # one exchange of the whole texts, by identifier and tag; both uses below read it
    dealt = texts.withColumn("tag", _tag()).repartition("rid", "tag")
    here = dealt.select("rid", "tag", "body").join(wanted.hint("shuffle_hash"), ["rid", "tag"])
    marked = marks(runs(here, total)).withColumn("tag", F.col("at").bitwiseAND(F.lit(-PLACES)))
    lists = {"told": "at", "told_past": "past"}
    found = marked.groupBy("rid", "tag").agg(*(F.collect_list(c).alias(n) for n, c in lists.items() if c in marked.columns))
    told = found.join(copied.withColumn("copied", F.lit(True)), ["rid", "tag"], "full")
    out = dealt.join(told.hint("shuffle_hash"), ["rid", "tag"], "left")
    return out.withColumn("copied", F.coalesce("copied", F.lit(False))).drop("k2")


def fresh_rows(seen: set, rids: list, tags: list) -> list[bool]:
    """Whether each row is the first of its text and identifier in a task: rows that repeat one whole would only say the same again."""
    out = []
    for at in zip(rids, tags, strict=True):
        out.append(at not in seen)
        seen.add(at)
    return out
