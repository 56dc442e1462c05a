"""Document fingerprints: I-Match with randomised lexicon subsets, in DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band, which is a
band of inverse document frequency.  A document keeps its distinct lexicon
terms, sorted; each of several random subsets of the lexicon picks some of them,
and the hash of those picked, in order, is one value of the fingerprint.  The
subsets keep small parts of the lexicon, of several sizes, so that short and long
documents both have some that pick a few terms: a text with a third replaced
then still has subsets in common with what it was, which subsets that drop only
a few terms wouldn't show.  One more value is the hash of all the text's distinct
terms, which tells apart texts without lexicon terms.  Two fingerprints are as
alike as the share of equal values, of those that pick anything in either document.

A term in at least a share s of the documents is counted at least s * N times,
so the lexicon has at most (mean distinct terms of a document) / s terms however
many documents there are.  Up to LEXICON_SENT terms it is sent to the tasks as a
set; a larger one is joined with the documents' terms instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import cut

#: The band: least and most share of documents that a lexicon term occurs in.
LEAST_SHARE, MOST_SHARE = 0.005, 0.1
#: The most terms of a lexicon that is sent to the tasks (8 bytes each).
LEXICON_SENT = 100_000
#: Subsets of each size, and the sizes: one in so many terms (powers of 2), read from bits of the term's hash.
SUBSETS, SIZES = 16, (16, 64, 256)
#: Rows of a range of identifiers in which neighbours are found, and the most ranges.
RANGE_ROWS, RANGES = 2_000, 4_096
_LEAST = -(1 << 63)


def terms_of(text: Column) -> Column:
    """Hashes of a text's distinct lower-case terms."""
    words = F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


@dataclass
class Lexicon:
    """Term hashes of the band: ``band`` (term), and the same as a list if they are few."""

    band: DataFrame
    hashes: list[int] | None

    def keep(self, df: DataFrame, keys: list[str], terms: str, name: str) -> DataFrame:
        """``df`` with the sorted lexicon terms of the column ``terms``; ``keys`` tell rows with different terms apart."""
        if self.hashes is None:
            pairs = df.select(*keys, F.explode(terms).alias("term")).distinct()
            kept = pairs.join(self.band, "term").groupBy(*keys).agg(F.sort_array(F.collect_list("term")).alias(name))
            return df.join(kept, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<bigint>")))
        if not self.hashes:
            return df.withColumn(name, F.array().cast("array<bigint>"))
        band = ", ".join(f"{h}L" if h != _LEAST else "shiftleft(1L, 63)" for h in self.hashes)
        return df.withColumn(name, F.expr(f"sort_array(filter({terms}, h -> h in ({band})))"))

    def mark(self, df: DataFrame, keys: list[str], terms: str, name: str) -> DataFrame:
        """``df`` with the fingerprint of the column ``terms`` in place of it: of all terms, then one value per subset, 0 where nothing is picked."""
        made = self.keep(df, keys, terms, "__kept")
        values = F.concat(F.array(value_of(F.sort_array(F.col(terms)))), subset_values(F.col("__kept")))
        return made.withColumn(name, values).drop("__kept", terms)


def value_of(picked: Column) -> Column:
    """24 bits of the terms, never 0; 0 if there are none."""
    return F.when(F.size(picked) > 0, F.pmod(F.xxhash64(picked), F.lit((1 << 24) - 1)) + 1).otherwise(0).cast("int")


def _in_subset(bit: int, size: int, k: int):
    return lambda h: F.shiftright(h, bit).bitwiseAND(F.lit(size - 1).cast("long")) == k


def subset_values(terms: Column) -> Column:
    """The subsets' values of sorted term hashes."""
    found, bit = [], 0
    for size in SIZES:
        found += [value_of(F.filter(terms, _in_subset(bit, size, k))) for k in range(SUBSETS)]
        bit += size.bit_length() - 1
    return F.array(*found)


def likeness(a: Column, b: Column) -> Column:
    """Equal values over those that pick anything in either; two documents without terms are alike."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), None).otherwise((x == y).cast("int")))
    seen = F.filter(pairs, lambda x: x.isNotNull())
    return F.when(F.size(seen) == 0, 1.0).otherwise(F.aggregate(seen, F.lit(0.0), lambda t, x: t + x) / F.size(seen))


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 6, "0")), "")


def fit_lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Lexicon:
    """Count every term of every text (column ``text``), combined before the shuffle, and keep the band.

    At most LEXICON_SENT + 1 terms reach the driver.
    """
    n = texts.count()
    counts = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").count()
    band = counts.filter((F.col("count") >= least * n) & (F.col("count") <= most * n) & (F.col("count") > 1)).select("term")
    band = cut(band)
    if band.count() > LEXICON_SENT:
        return Lexicon(band, None)
    return Lexicon(band, sorted(r["term"] for r in band.collect()))


def predecessors(ids: DataFrame) -> DataFrame:
    """For each row the one before it in the order of (z, nk, h), the last standing before the first.

    ``ids``: distinct (z, nk, h, n).  Returns (z, nk, h) and those of the row
    before as (pz, pnk, ph, pn).  Neighbours are found in ranges of that order
    with about equal numbers of rows, wherever the identifiers lie, so no task
    gets all rows; what passes between ranges is one row of each, RANGES at most.
    """
    order = ["z", "nk", "h"]
    ranges = min(RANGES, max(1, -(-ids.count() // RANGE_ROWS)))
    # written, as ranges are bounded by a sample that another run of the plan may draw anew
    placed = cut(ids.repartitionByRange(ranges, *order).withColumn("place", F.spark_partition_id()))
    own = F.struct("z", "nk", "h", "n")
    inside = placed.withColumn("before", F.lag(own).over(Window.partitionBy("place").orderBy(*order)))
    lasts = placed.groupBy("place").agg(F.max(own).alias("last"))
    across = Window.orderBy("place")
    final = F.max("last").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = lasts.select("place", F.coalesce(F.lag("last").over(across), final).alias("carried"))
    met = inside.join(F.broadcast(carried), "place").withColumn("p", F.coalesce("before", "carried"))
    return met.select(*order, F.col("p.z").alias("pz"), F.col("p.nk").alias("pnk"), F.col("p.h").alias("ph"), F.col("p.n").alias("pn"))


def edited_likeness(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).  The edited text has its last floor(n_chars / 3) code points
    replaced by as many of the first of the next document (all, if it has
    fewer), documents in descending order of doc_id and the first after the last.

    Null texts count as empty; texts of any length are read whole.  Rows equal in
    identifier and text are one document among the neighbours and give a row
    each; other rows with one identifier stand in the order of their texts'
    hashes; null identifiers come last.  Any long is an identifier.  A single
    document is its own next one; an empty table gives no rows.  Other columns
    are never read.
    """
    # z: whether the identifier is null; nk: its bits turned over, so that ascending is descending
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(doc_id.isNull().alias("z"), F.bitwise_not(F.coalesce(doc_id, F.lit(0).cast("long"))).alias("nk"), F.xxhash64(text).alias("h"), text.alias("text"))
    lexicon = fit_lexicon(keyed.select("text"), least, most)
    keys = ["z", "nk", "h"]
    pairs = predecessors(keyed.select(*keys, F.char_length("text").cast("long").alias("n")).distinct())

    # one exchange of the texts with their fingerprints, which both joins below read
    dealt = lexicon.mark(keyed.withColumn("terms", terms_of(F.col("text"))), keys, "terms", "mark").select(*keys, "text", "mark").repartition(*keys)
    met = dealt.join(pairs.hint("shuffle_hash"), keys)
    sent = met.select(F.col("pz").alias("z"), F.col("pnk").alias("nk"), F.col("ph").alias("h"), F.expr("substring(text, 1, cast(pn div 3 as int))").alias("head"), F.col("mark").alias("next_mark"))
    both = dealt.join(sent.dropDuplicates(keys).hint("shuffle_hash"), keys)
    edited = F.expr("concat(substring(text, 1, cast(char_length(text) - char_length(text) div 3 as int)), head)")
    made = both.select(*keys, F.char_length("text").cast("long").alias("n_chars"), "mark", "next_mark", edited.alias("edited"))
    made = made.select(*keys, "n_chars", "mark", "next_mark", F.sha2("edited", 256).alias("edited_sha256"), terms_of(F.col("edited")).alias("terms"))
    made = lexicon.mark(made, keys, "terms", "edited_mark")
    return made.select(
        F.when(~F.col("z"), F.bitwise_not("nk")).alias("doc_id"), "n_chars", "edited_sha256",
        as_text(F.col("mark")).alias("fingerprint"), as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
