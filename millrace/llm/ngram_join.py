"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

A set is the hashes of a text's distinct shingles.  Under any fixed order of all
shingles, two sets of n and m elements with a Jaccard similarity of at least 4/5
share an element among the first n - ceil(4n/5) + 1 of the one and the first
m - ceil(4m/5) + 1 of the other: their prefixes.  The order is by hash, except
that shingles found in very many texts come last.

Documents with equal sets are one class; classes with equal prefixes and sizes
are one group.  Groups meet at the prefix shingles that they share; pairs are
filtered by size and by the shingle's places, expanded to classes and verified
on whole sets, after short parity sketches of the sets have ruled out most pairs
that are no links and none that are.  A meeting place is not expanded into all its pairs at once:
first every group is tried against the least group there; links make
components; then only pairs across components are tried.  So every link
between different components is found, and a large cluster of copies costs a
number of trials in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.arrow import id_and_bytes
from millrace.llm.components import components
from millrace.llm.shared import cut
from millrace.llm.shingles import hashed, mixed, rolled

SHINGLE = 5
#: A shingle is ordered last if it is in at least so many texts, as a share of the documents and as a count.
HOT_SHARE, HOT_LEAST = 1 / 4000, 128
#: Places of a shingle in a set, and sizes, share a long: size * PLACES + place.
PLACES = 1 << 31
#: Candidates up to which a table of bits (so many for each, rounded up) lets the last pass skip other texts; with more, they are joined.
TABLE_CANDIDATES, CANDIDATE_BITS = 8_000_000, 16
#: Bits of a part of that table.
BUCKET_BITS = 32_768
#: Rows at a meeting place that are tried against all others there in one task, in the second round.
PAIR_ROWS = 5_000
#: Shingles that a task counts at once.
FOLD = 1_000_000
_EMPTY = np.zeros(0, np.uint64)


def shingle_set(body: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words is one shingle, one without words none."""
    words = body.lower().split()
    if not words:
        return _EMPTY
    if len(words) < width:
        return mixed(rolled(hashed(words), len(words)), len(words))
    return np.unique(mixed(rolled(hashed(words), width)))


def parity_sketch(found: np.ndarray) -> bytes:
    """For each of at least 2 * n bits, whether an odd number of the hashes fall on it (the count of bits is a power of 2).

    Two sets' sketches of one size differ in at most as many bits as the sets do
    in elements, since each element that only one has flips one bit.
    """
    bits = 1 << max(6, (2 * len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(x: bytes, y: bytes) -> int:
    """Bits that differ once the longer sketch is folded to the shorter one's size."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrow lists of 64-bit hashes."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else _EMPTY
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(flat)))


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles in very many different texts.

    Tasks count in their own texts and report what occurs twice or more; the
    sums needn't be exact, as any set of shingles may be ordered last.  At most
    2 * (mean shingles of a text) / HOT_SHARE shingles reach the driver.
    """
    kinds = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), 0
        waiting: list[np.ndarray] = []
        known, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold() -> None:
            nonlocal waiting, held, known, times
            tokens, n = np.unique(np.concatenate(waiting), return_counts=True)
            both = np.concatenate((known, tokens[n > 1]))
            known, place = np.unique(both, return_inverse=True)
            times = np.bincount(place, np.concatenate((times, n[n > 1])), len(known)).astype(np.int64)
            waiting, held = [], 0

        for batch in it:
            for body in batch.column(1):
                data = body.as_py()
                key = xxhash.xxh3_128_digest(data)
                if key in seen:
                    continue
                seen.add(key)
                waiting.append(shingle_set(data))
                held += len(waiting[-1])
                if held >= FOLD:
                    fold()
        if waiting:
            fold()
        if len(known):
            yield _batch([_signed(known), times], kinds)

    n = docs.count()
    sums = docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    kept = sums.filter(F.col("n") >= max(HOT_LEAST, HOT_SHARE * n) / 2)
    return np.array(sorted(r["token"] for r in kept.select("token").collect()), np.int64).view(np.uint64)


def signatures(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(doc_id, named, n, s1, s2, p, sketch, cold, hot): set size, 128 bits of the set, 64 of its prefix, its parity sketch, the prefix in order."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(hot))
    kinds = pa.schema([("doc_id", pa.int64()), ("named", pa.bool_()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("p", pa.int64()), ("sketch", pa.binary()), ("cold", pa.list_(pa.int64())), ("hot", pa.list_(pa.int64()))])

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for batch in it:
            sizes, whole, heads, sketches, colds, warms = [], [], [], [], [], []
            for body in batch.column(1):
                found = shingle_set(body.as_py())
                n = len(found)
                k = prefix_length(n)
                if len(last) and n:
                    late = last[np.minimum(np.searchsorted(last, found), len(last) - 1)] == found
                    cold = found[~late][:k]
                    warm = found[late][: k - len(cold)]
                else:
                    cold, warm = found[:k], _EMPTY
                sizes.append(n)
                whole.append(xxhash.xxh3_128_digest(found))
                heads.append(xxhash.xxh3_64_intdigest(cold.tobytes() + b"|" + warm.tobytes()))
                sketches.append(parity_sketch(found))
                colds.append(cold)
                warms.append(warm)
            if sizes:
                both = np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)
                p = np.array(heads, np.uint64).view(np.int64)
                yield _batch([batch.column(0), batch.column(2), sizes, both[:, 0], both[:, 1], p, sketches, _lists(colds), _lists(warms)], kinds)

    return docs.mapInArrow(sign, "doc_id long, named boolean, n long, s1 long, s2 long, p long, sketch binary, cold array<long>, hot array<long>")


def _pair_filter(w1: str, w2: str) -> Column:
    """Whether sets with a shared shingle as their first common one, at these packed sizes and places, can have enough in common."""
    n1, n2 = F.expr(f"{w1} div {PLACES}"), F.expr(f"{w2} div {PLACES}")
    i1, i2 = F.expr(f"{w1} % {PLACES}"), F.expr(f"{w2} % {PLACES}")
    return (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * F.least(n1 - i1, n2 - i2) >= 4 * (n1 + n2))


def _candidate_table(ids: DataFrame, buckets: int) -> np.ndarray:
    """A table of ``buckets`` parts with the bits of all ``id`` set."""
    place = F.pmod(F.xxhash64("id"), F.lit(buckets * BUCKET_BITS).cast("long"))
    bits = ids.select(place.alias("x")).select(F.expr(f"x div {BUCKET_BITS}").alias("bucket"), F.expr(f"x % {BUCKET_BITS}").alias("bit"))
    rows = bits.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")).collect()
    table = np.zeros((buckets, BUCKET_BITS // 8), np.uint8)
    for r in rows:
        got = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        table[r["bucket"], : len(got)] = got
    return table.reshape(-1)


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, items): the whole sets of at least the documents in ``pairs`` (a, b); most other texts are skipped before they are split.

    The table of bits is as large as the candidates need (16 MB at most); if they
    are too many for one, the texts are joined with them.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    n = 2 * pairs.count()
    kinds = pa.schema([("id", pa.int64()), ("items", pa.list_(pa.int64()))])
    if n > TABLE_CANDIDATES:
        sent, bits = None, 1
        docs = docs.join(ids.distinct(), docs.doc_id == ids.id, "left_semi")
    else:
        bits = max(1, -(-CANDIDATE_BITS * n // BUCKET_BITS)) * BUCKET_BITS
        sent = docs.sparkSession.sparkContext.broadcast(_candidate_table(ids, bits // BUCKET_BITS))
    placed = docs.select("doc_id", "body", F.pmod(F.xxhash64("doc_id"), F.lit(bits).cast("long")).alias("x"))

    def make(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = batch.column(2).to_numpy()
            wanted = np.arange(len(x)) if sent is None else np.flatnonzero((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
            for at in range(0, len(wanted), 2000):
                part = wanted[at : at + 2000].tolist()
                yield _batch([batch.column(0).take(part), _lists([shingle_set(batch.column(1)[i].as_py()) for i in part])], kinds)

    return placed.mapInArrow(make, "id long, items array<long>")


def _near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, m, x, n, y) -> the pairs (a, b) whose sketches leave room for a similarity of at least 4/5."""
    for batch in it:
        m, n = batch.column(2).to_pylist(), batch.column(4).to_pylist()
        # sets of m and n elements with at least 4/9 (m + n) in common differ in at most so many
        good = [i for i, (k, x, h, y) in enumerate(zip(m, batch.column(3).to_pylist(), n, batch.column(5).to_pylist(), strict=True)) if sketch_distance(x, y) <= k + h + 2 * (-4 * (k + h) // 9)]
        yield batch.select([0, 1]).take(pa.array(good, pa.int64()))


def _linked(pairs: DataFrame, signed: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of at least 4/5.

    Parity sketches, which are short, first rule out most of those that don't.
    ``repeats``: many rows may have one key, so their equal sets are reduced to one.
    """
    known = signed.select("doc_id", "n", "sketch")
    met = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a").join(known.select(F.col("doc_id").alias("b"), "n", F.col("sketch").alias("y")), "b")
    pairs = cut(met.select("a", "b", "m", "x", "n", "y").mapInArrow(_near, "a long, b long").distinct())
    sets = _sets_of(docs, pairs)
    if repeats:
        sets = sets.distinct()
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    n = F.size("x") + F.size("y")
    return met.filter(9 * F.size(F.array_intersect("x", "y")) >= 4 * n).select("a", "b")


def _by_identifier(named: DataFrame, final: DataFrame, keys: DataFrame) -> DataFrame:
    """``named`` with the least identifier in place of a component that is one of ``keys``, which stand for texts without one; null if there is none."""
    roots = keys.withColumnRenamed("id", "root")
    own = final.join(roots, "root", "left_semi").join(keys.withColumnRenamed("id", "node"), "node", "left_anti").groupBy("root").agg(F.min("node").alias("least"))
    turned = roots.join(own, "root", "left").withColumn("key", F.lit(True))
    return named.join(turned, named.component == turned.root, "left").select("s1", "s2", "n", F.when(F.col("key"), F.col("least")).otherwise(F.col("component")).alias("component"))


def shingle_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``.

    Two documents are linked if 100 * intersection >= 80 * union of their sets of
    5-word shingles (words between ASCII white space, A-Z in lower case).  A text
    with fewer than 5 words is one shingle, if it has words; null, empty and blank
    texts are linked with nothing.  component_id is the least doc_id that links
    reach, null if they reach none.  Rows with one identifier count as linked;
    those with a null one are linked by their texts only.  Texts of any length are
    read whole; other columns are never read; an empty table gives no rows.
    """
    # a row without an identifier goes by a hash of its text, and so together with exact copies only
    texts = id_and_bytes(docs, id_col, text_col).select(F.coalesce("doc_id", F.xxhash64("body")).alias("doc_id"), "body", F.col("doc_id").isNotNull().alias("named"))
    signed = cut(signatures(texts, hot_shingles(texts)))
    nulls = not signed.filter("not named").isEmpty()
    once = cut(signed.filter("named").union(signed.filter("not named").dropDuplicates(["doc_id"]))) if nulls else signed
    filled = once.filter(F.col("n") > 0)
    classes = cut(filled.groupBy("s1", "s2", "n", "p").agg(F.coalesce(F.min(F.when(F.col("named"), F.col("doc_id"))), F.min("doc_id")).alias("id"), F.max("named").alias("named")))
    groups = classes.groupBy("n", "p").agg(F.min("id").alias("group"), F.count("*").alias("classes"))
    several = groups.filter(F.col("classes") > 1)
    members = cut(classes.join(several, ["n", "p"]).select("group", "id", "n").distinct())  # of groups with several classes

    heads = filled.join(groups.hint("shuffle_hash"), (filled.doc_id == groups["group"]) & (filled.n == groups.n) & (filled.p == groups.p)).select("group", filled.n.alias("n"), "cold", "hot")
    packed = F.col("n") * F.lit(PLACES)
    cold = heads.select("group", packed.alias("base"), F.posexplode("cold").alias("place", "token")).select("token", "group", (F.col("base") + F.col("place")).alias("w"))
    warm = heads.filter(F.size("hot") > 0).select("group", (packed + F.size("cold")).alias("base"), F.posexplode("hot").alias("place", "token")).select("token", "group", (F.col("base") + F.col("place")).alias("w"))

    here = Window.partitionBy("token")
    own = F.struct("group", "w")
    cold = cold.withColumn("met", F.count("*").over(here)).filter(F.col("met") > 1).drop("met").withColumn("least", F.min(own).over(here))
    leaders = warm.groupBy("token").agg(F.min(own).alias("least"))  # as many rows as hot shingles, at most
    met = cold.unionByName(warm.join(F.broadcast(leaders), "token"))
    partner = F.when((F.col("group") != F.col("least.group")) & _pair_filter("w", "least.w"), F.col("least.group"))
    meetings = cut(met.select("token", "group", "w", partner.alias("partner")))

    # the first round: everything against the least group of a meeting, and the classes of a group against its least
    tried = meetings.filter(F.col("partner").isNotNull()).select(F.col("partner").alias("a"), F.col("group").alias("b"))
    inner = members.filter(F.col("group") != F.col("id")).select(F.col("group").alias("a"), F.col("id").alias("b"))
    first = cut(tried.unionByName(inner).distinct())
    links = cut(_linked(first, once, texts, nulls))
    roots = cut(components(links))

    # the second round: what meets and isn't connected yet, groups expanded to their classes
    rooted = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("group", "id", "n", F.coalesce("root", "id").alias("root"))
    bounds = rooted.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    at = meetings.select("token", "group", "w").join(roots.select(F.col("node").alias("group"), "root"), "group", "left").join(bounds, "group", "left")
    at = at.select("token", "group", "w", F.coalesce("root", "group").alias("root"), F.coalesce("lo", "root", "group").alias("lo"), F.coalesce("hi", "root", "group").alias("hi"))
    torn = at.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).filter("l <> h").select("token")
    open_ = at.join(torn, "token").select("token", "group", "w", F.col("root").alias("own"))
    open_ = open_.join(rooted.drop("n"), "group", "left").select("token", F.coalesce("id", "group").alias("id"), F.coalesce("root", "own").alias("root"), "w", F.lit(False).alias("inner"))
    split = bounds.filter("lo <> hi").select("group")
    inside = rooted.join(split, "group").select(F.col("group").alias("token"), "id", "root", (F.col("n") * F.lit(PLACES)).alias("w"), F.lit(True).alias("inner"))
    rest = cut(open_.unionByName(inside))
    # a place where very many meet is dealt out: each row of one side goes to one part, each of the other to all
    parts = rest.groupBy("token", "inner").agg(F.ceil(F.count("*") / PAIR_ROWS).cast("int").alias("parts"))
    rest = rest.join(parts, ["token", "inner"])
    left = rest.select("token", "inner", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("a"), F.col("root").alias("ra"), F.col("w").alias("w1"))
    right = rest.select("token", "inner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("root").alias("rb"), F.col("w").alias("w2"))
    across = left.join(right, ["token", "inner", "part"]).filter((F.col("ra") < F.col("rb")) & _pair_filter("w1", "w2"))
    second = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    second = cut(second.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    final = components(links.unionByName(_linked(second, once, texts, nulls)))

    named = classes.join(final.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", "n", F.coalesce("root", "id").alias("component"))
    # written, so that the join's two sides are plain exchanges and Spark can split one with very many copies of a text
    named = cut(named.groupBy("s1", "s2", "n").agg(F.min("component").alias("component")))
    if nulls:
        named = cut(_by_identifier(named, final, classes.filter("not named").select("id")))
    done = signed.select("doc_id", F.col("named").alias("own"), "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    doc_id = F.when(F.col("own"), F.col("doc_id"))
    return done.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(doc_id).alias("component_id"))


#: The query's rows in DuckDB's SQL.
ORACLE = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) x from d),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id p, b.doc_id q, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as (select p, q from c join n a on a.doc_id = p join n b on b.doc_id = q where 100 * c >= 80 * (a.n + b.n - c)),
e as (select p, q from l union select q, p from l),
r as (select doc_id, doc_id o from documents union select e.q, r.o from r join e on e.p = r.doc_id)
select d.doc_id, coalesce(n.n, 0) n_shingles, (select min(o) from r where r.doc_id = d.doc_id) component_id from d left join n on n.doc_id = d.doc_id
"""
