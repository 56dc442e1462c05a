import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from millrace.llm import arrow, imatch, quality
from millrace.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [(r.score, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_labels_of_held_out_rows_are_never_learned(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(60)], "doc_id long, text string")
    marks = [(i, i % 2, "clash") for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in marks]
    a, b = (quality.fit(docs, spark.createDataFrame(m, "doc_id long, quality int, text string")) for m in (marks, turned))
    assert a.key == b.key


def plain_features(text):
    """Every feature of a text, one by one: n-grams of marked words, words, and pairs of neighbours."""
    found, words = Counter(), text.split()
    for w in words:
        marked = b"<" + w + b">"
        found[zlib.crc32(w, 1) % quality.BUCKETS] += 1
        for n in (2, 3, 4):
            for i in range(len(marked) - n + 1):
                value = (n << 8 * n) | int.from_bytes(marked[i : i + n], "big")
                found[(value * 0x9E3779B97F4A7C15 % 2**64) >> 46] += 1
    for a, b in zip(words, words[1:], strict=False):
        x, y = zlib.crc32(a, 7), zlib.crc32(b, 7)
        mixed = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) % 2**64
        found[0 if x == y else (mixed >> 31) % quality.BUCKETS] += 1
    return dict(found)


LONG = [
    b"",
    b"a",
    "one tw\u00f6 one one".encode(),
    b"x" * 200,
    b"word " * 300,
    b" ".join(b"%d" % (i * i) for i in range(30_000)),
    b"ab " + np.random.default_rng(1).integers(97, 123, 90_000, np.uint8).tobytes() + b" c",
]


def test_features_are_those_of_the_whole_text(monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 1000)
    monkeypatch.setattr(quality, "blocks", lambda data: arrow.blocks(data, 5000))
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS), 0.1)
    scorer = quality.Scorer(model)
    for text in LONG:
        want = plain_features(text)
        buckets, counts = quality.features(text)
        assert dict(zip(buckets.tolist(), counts.tolist(), strict=True)) == want
        z = 0.1 + (sum(model.weights[b] * n for b, n in want.items()) / sum(want.values()) if want else 0)
        assert scorer.score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)


def test_very_long_texts_and_words():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.1)
    words = b" ".join(b"w%d" % v for v in rng.integers(0, 5000, 600_000))
    one = rng.integers(97, 123, 1 << 20, np.uint8).tobytes()
    assert len(words) > 3 << 20
    for text in (words, one):
        buckets, counts = quality.features(text)
        n = len(text.split())
        assert counts.sum() == sum(3 * len(w) for w in text.split()) + n + n - 1
        z = 0.1 + float((model.weights[buckets] * counts).sum() / counts.sum())
        assert quality.Scorer(model).score(text) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    # two texts without blanks that differ in the middle only
    other = one[:1000] + bytes(reversed(one[1000:-1000])) + one[-1000:]
    assert quality.Scorer(model).score(one) != quality.Scorer(model).score(other)
    a, b = (dict(zip(*(x.tolist() for x in quality.features(t)), strict=True)) for t in (one, other))
    assert sum(min(n, b.get(k, 0)) for k, n in a.items()) < 0.95 * sum(a.values())


def test_scores_dont_depend_on_what_came_before():
    model = quality.Model(np.random.default_rng(3).normal(size=quality.BUCKETS), 0.1)
    texts = [b"some words here " * 50, b"z" * 700 + b" words", b"here some"]
    fresh = [quality.Scorer(model).score(t) for t in texts]
    scorer = quality.Scorer(model)
    assert [scorer.score(t) for t in reversed(texts)] == fresh[::-1]


def test_memo_has_bounds(monkeypatch):
    monkeypatch.setattr(quality, "MEMO_BYTES", 4000)
    scorer = quality.Scorer(quality.Model(np.ones(quality.BUCKETS), 0))
    for i in range(50):
        scorer.score(b"%d " % i + b"y" * 1000 + b"%d" % i)
        assert scorer.words.held <= 4000 + 1100


def test_training_against_plain_loops():
    """The same steps, written out feature by feature on dictionaries."""
    texts = [b"good nice words", b"bad junk junk", b"nice good day", b"junk ### bad"]
    labels, epochs, rate = [1, 0, 1, 0], 2, 0.4
    model = quality.train(texts, labels, epochs, rate, 6)
    rng = np.random.default_rng(6)
    start = rng.uniform(-1 / 8, 1 / 8, (quality.BUCKETS, 8)).astype(np.float32)
    vectors, out, bias = {}, [[0.0, 0.0] for _ in range(8)], [0.0, 0.0]
    done, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            found = plain_features(texts[i])
            n, r = sum(found.values()), rate * (1 - done / steps)
            done += 1
            for k in found:
                vectors.setdefault(k, [float(x) for x in start[k]])
            hidden = [sum(vectors[k][d] * c / n for k, c in found.items()) for d in range(8)]
            z = [sum(hidden[d] * out[d][j] for d in range(8)) + bias[j] for j in (0, 1)]
            p = [float(np.exp(x) / (np.exp(z[0]) + np.exp(z[1]))) for x in z]
            error = [p[j] - (labels[i] == j) for j in (0, 1)]
            back = [sum(out[d][j] * error[j] for j in (0, 1)) for d in range(8)]
            for j in (0, 1):
                bias[j] -= 0.1 * r * error[j]
                for d in range(8):
                    out[d][j] -= r * hidden[d] * error[j]
            for k, c in found.items():
                share = min(c / n, 4 / len(found))
                vectors[k] = [v - r * len(found) * 0.5 * share * back[d] for d, v in enumerate(vectors[k])]
    for k, v in vectors.items():
        assert model.weights[k] == pytest.approx(sum(v[d] * (out[d][1] - out[d][0]) for d in range(8)), abs=1e-5)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)


def test_the_sample_has_bounds(spark, monkeypatch):
    """Repeats of a labelled row count once; the bounds of rows and bytes hold; every row is scored."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(texts) or quality.Model(np.zeros(quality.BUCKETS), 0))
    docs = spark.createDataFrame([(i % 40, f"text {i % 80} " + "x" * 90) for i in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    quality.fit(docs, labels)
    quality.fit(docs, labels, 10)
    quality.fit(docs, labels, 3000, 1000)
    kept = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert len(seen[0]) == 2 * len(kept) == len(set(seen[0])) and len(seen[1]) == 10 and 0 < sum(map(len, seen[2])) <= 1000


def test_classifier_odd_tables(spark, no_docs, clashing, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(no_docs, none).collect() == []
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (1, None), (4, 0)], "doc_id long, quality int")
    out = quality.quality_scores(clashing, odd).collect()
    assert len(out) == 4 and sum(r.held_out for r in out if r.doc_id is None) == 0
    kept = quality.keep_good(clashing, odd)
    assert kept.columns == clashing.columns


def test_training_separates():
    texts = [b"good fine nice words here"] * 30 + [b"bad ### ### junk junk"] * 30
    model = quality.train(texts, [1] * 30 + [0] * 30)
    s = quality.Scorer(model)
    assert s.score(texts[0]) > 0.8 and s.score(texts[-1]) < 0.2
    assert quality.train([], []).bias == 0


def spark_hash(values):
    """Spark's xxhash64 of an array of longs, as a signed long."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return h - (h >> 63 << 64)


def plain_terms(text):
    return {(h := xxhash.xxh64_intdigest(w, 42)) - (h >> 63 << 64) for w in re.findall(rb"[^\x20\x09-\x0D]+", text.lower().encode())}


def plain_values(terms, lexicon):
    """A fingerprint by its definition: all terms, then each subset of the lexicon's."""

    def value(picked):
        return spark_hash(sorted(picked)) % (2**24 - 1) + 1 if picked else 0

    out, bit = [value(terms)], 0
    for size in (16, 64, 256):
        out += [value([t for t in terms & lexicon if (t >> bit) % size == k]) for k in range(16)]
        bit += size.bit_length() - 1
    return out


def plain_likeness(a, b):
    seen = [x == y for x, y in zip(a, b, strict=True) if x or y]
    return sum(seen) / len(seen) if seen else 1.0


def brute_rows(rows, least, most):
    """The whole result from its definition; identifiers are distinct but for rows that repeat whole."""
    counts = Counter(t for _, text in rows for t in plain_terms(text or ""))
    lexicon = {t for t, n in counts.items() if least * len(rows) <= n <= most * len(rows) and n > 1}
    order = sorted(dict(rows).items(), key=lambda r: -r[0])
    out = {}
    for (i, t), (_, n) in zip(order, [*order[1:], order[0]], strict=True):
        t, n = t or "", n or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        a, b, c = (plain_values(plain_terms(x), lexicon) for x in (t, edited, n))
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{v:06X}" for v in a), "".join(f"{v:06X}" for v in b), pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c)))
    return out


@pytest.mark.parametrize("sent", [100_000, 3])
def test_fingerprints(docs, rows, corpus, monkeypatch, sent):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 7)
    monkeypatch.setattr(imatch, "LEXICON_SENT", sent)
    found = imatch.edited_likeness(docs, 0.01, 0.5).collect()
    assert len(found) == len(rows) and {r.doc_id: tuple(r)[1:] for r in found} == brute_rows(rows, 0.01, 0.5)
    by_text = {}
    for i, t in corpus:
        by_text.setdefault(t or "", set()).add(next(r.fingerprint for r in found if r.doc_id == i))
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_of_the_tables(spark):
    """Edited texts are more alike than neighbours, by the production parameters."""
    found = imatch.edited_likeness(spark.read.parquet(f"{SF}/documents.parquet")).select("near_edited", "near_next").collect()
    edited, following = (np.array([r[k] for r in found]) for k in (0, 1))
    assert np.mean(edited[:, None] > following) + np.mean(edited[:, None] == following) / 2 > 0.95


def test_far_apart_and_null_identifiers(spark):
    """Any long is an identifier, null is none of them, and their places don't matter to the ranges."""
    ids = [-(1 << 63), 1 - (1 << 63), -9 * 10**18, -1, 0, 1, 9 * 10**18, (1 << 63) - 1]
    rows = [(i, f"text{k} of words " * (k + 1)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([*rows, (None, "abcdef"), (None, "ghijkl"), (None, "abcdef")], "doc_id long, text string").repartition(3)
    found = imatch.edited_likeness(docs).collect()
    assert len(found) == 11
    digests = {r.doc_id: r.edited_sha256 for r in found if r.doc_id is not None}
    order = sorted(rows, reverse=True)
    nulls = sorted(("abcdef", "ghijkl"), key=lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64))
    for (i, t), (_, n) in zip(order, [*order[1:], (None, nulls[0])], strict=True):
        cut = len(t) // 3
        assert digests[i] == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest()
    want = [nulls[0][:4] + nulls[1][:2], nulls[1][:4] + order[0][1][:2]]
    assert {r.edited_sha256 for r in found if r.doc_id is None} == {hashlib.sha256(x.encode()).hexdigest() for x in want}


def test_long_texts_are_read_whole(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2")], "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.edited_likeness(docs, 0.5, 0.9).collect()}
    assert len(text) > 1 << 20 and found[1].n_chars == len(text)
    assert found[2].edited_sha256 == hashlib.sha256((text + " end")[: len(text) + 4 - (len(text) + 4) // 3].encode() + text[: (len(text) + 4) // 3].encode()).hexdigest()
    assert found[2].near_next > 0.9


def test_lexicon_band(spark):
    texts = spark.createDataFrame([(f"all {'half' if i % 2 else 'other'} own{i} ALL",) for i in range(10)], "text string")
    hashes = dict(spark.sql("select w, xxhash64(w) from values ('all'), ('half'), ('other'), ('own1') t(w)").collect())
    made = imatch.fit_lexicon(texts, 0.2, 0.6)
    assert made.hashes == sorted((hashes["half"], hashes["other"])) == sorted(r.term for r in made.band.collect())
    assert imatch.fit_lexicon(texts.filter("false")).hashes == []


def test_fingerprint_odd_tables(spark, no_docs, clashing):
    assert imatch.edited_likeness(no_docs).collect() == []
    out = imatch.edited_likeness(clashing).collect()
    assert len(out) == 4 and sum(r.doc_id is None for r in out) == 2
    one = imatch.edited_likeness(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    plan = imatch.edited_likeness(clashing)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()
    single = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert single.columns == docs.columns and single.count() < kept.count() and single.select("doc_id").distinct().count() == single.count()
    cut = corpus_pipeline.repeated_passages(spark, single, SF)
    assert cut.columns == docs.columns and cut.count() == single.count()
    assert cut.filter("n_chars <> char_length(text)").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert packed.agg({"doc_id": "count"}).first()[0] >= cut.count() and {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in cut.select("doc_id").collect()}


def test_pipeline_odd_tables(spark, no_docs, docs, rows):
    for table, n in ((no_docs, 0), (docs, len({i for i, _ in rows}))):
        single = corpus_pipeline.near_duplicates(spark, table, SF)
        assert single.columns == table.columns and single.count() <= n
        assert corpus_pipeline.repeated_passages(spark, single, SF).count() == single.count()
        corpus_pipeline.packing(spark, single, SF).count()
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, None, None, None, None)], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, nulls, SF).count() == 3
    assert corpus_pipeline.repeated_passages(spark, nulls, SF).count() == 3


def test_names():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(oracle_sql()) <= set(queries())
