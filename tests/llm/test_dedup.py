import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components as stars
from millrace.llm import ngram_join, repeats, substring_dedup, suffix_dedup
from millrace.llm.components import components
from millrace.llm.ngram_join import prefix_length, shingle_components, shingle_set
from millrace.llm.shingles import mixed, rolled
from millrace.llm.substring_dedup import dedup_words
from millrace.llm.suffix_dedup import IndexFamily, SuffixArray, dedup_bytes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
OTHERS = "lang string, source string, n_chars long"


def brute_removed(sequences, width):
    """For each sequence, which elements lie in a window that starts anywhere else."""
    counts = Counter(bytes(s[i : i + width]) if isinstance(s, bytes) else tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - width + 1):
            if counts[bytes(s[i : i + width]) if isinstance(s, bytes) else tuple(s[i : i + width])] > 1:
                mask[i : i + width] = [True] * width
        out.append(mask)
    return out


def expected_words(rows):
    split = [WORDS.findall((t or "").encode()) for _, t in rows]
    return sorted((i, len(w), sum(m), hashlib.sha256(b" ".join(x for x, gone in zip(w, m, strict=True) if not gone)).hexdigest()) for (i, _), w, m in zip(rows, split, brute_removed(split, 35), strict=True))


def expected_bytes(rows):
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (i, _), d, m in zip(rows, data, brute_removed(data, 200), strict=True):
        spans = sum(a and not b for a, b in zip(m, [False, *m], strict=False))
        out.append((i, len(d), sum(m), spans, hashlib.sha256(bytes(x for x, gone in zip(d, m, strict=True) if not gone)).hexdigest()))
    return sorted(out)


def found_words(docs):
    return sorted(map(tuple, dedup_words(docs).select("doc_id", "removed.n_words", "removed.n_removed", "removed.kept_sha256").collect()))


def found_bytes(docs):
    return sorted(map(tuple, dedup_bytes(docs).select("doc_id", "removed.n_bytes", "removed.n_removed", "removed.n_spans", "removed.kept_sha256").collect()))


@pytest.mark.parametrize("key_rows", [2_000, 2])
def test_words_against_brute_force(docs, rows, monkeypatch, key_rows):
    monkeypatch.setattr(repeats, "KEY_ROWS", key_rows)
    want = expected_words(rows)
    assert sum(w[2] for w in want) > 500
    assert found_words(docs) == want


@pytest.mark.parametrize(("key_rows", "batch", "group"), [(1_000, 1 << 15, 1_000), (2, 700, 20)])
def test_bytes_against_brute_force(docs, rows, monkeypatch, key_rows, batch, group):
    monkeypatch.setattr(repeats, "KEY_ROWS", key_rows)
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", group)
    want = expected_bytes(rows)
    assert sum(w[2] for w in want) > 2000
    assert found_bytes(docs) == want


@pytest.mark.parametrize("seed", range(2))
def test_small_alphabets(spark, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 260))) for _ in range(30)]
    texts += [texts[3] + " " + texts[4], "a " * 80, "a" * 450, "ab" * 220]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, " + OTHERS)
    assert found_words(docs) == expected_words(rows)
    assert found_bytes(docs) == expected_bytes(rows)


def test_removed_odd_tables(spark, no_docs, clashing):
    for op in (dedup_words, dedup_bytes):
        assert op(no_docs).collect() == []
        out = op(clashing)
        assert out.columns == [*clashing.columns, "removed"] or out.columns[:-1] == clashing.columns
        assert out.count() == 4
    # two texts under one identifier, and under none, are judged by themselves
    same = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(1, same), (1, "x " + same), (None, same), (None, "other"), (1, None)], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed) for r in dedup_words(docs).select("removed.*").collect())
    assert got == [(0, 0), (1, 0), (40, 40), (40, 40), (41, 40)]
    spans = {r.n_words: (list(r.starts), list(r.ends)) for r in dedup_words(docs).select("removed.*").collect()}
    assert spans[41] == ([1], [41])


def test_rolled_hashes():
    values = np.random.default_rng(0).integers(0, 2**64, 90, np.uint64)
    for width in (1, 2, 5, 7, 32, 35, 90):
        want = []
        for i in range(len(values) - width + 1):
            h = 0
            for v in values[i : i + width].tolist():
                h = (h * 0x9E3779B97F4A7C15 + v) % 2**64
            want.append(h)
        assert rolled(values, width).tolist() == want
    assert len(rolled(values, 91)) == 0 and len(set(mixed(values).tolist())) == 90


def test_sliding_least():
    v = np.random.default_rng(1).integers(0, 50, 60)
    for width in (1, 2, 3, 29, 60):
        assert repeats.sliding_least(v, width).tolist() == [v[i : i + width].min() for i in range(60 - width + 1)]
    assert len(repeats.sliding_least(v, 61)) == 0


def test_index_family_levels():
    rng = random.Random(5)
    pool = [bytes(rng.choice(b"ab\x00") for _ in range(203)) for _ in range(6)]
    family, texts, made = IndexFamily(), [], 0
    for n in range(40):
        text = rng.choice(pool)[rng.randrange(3) :]
        made += text not in texts
        texts.append(text)
        family.add([(text, (n, 0))])
        assert sum(x is not None for x in family.levels) == bin(made).count("1")
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = {(n, i) for n, t in enumerate(texts) for i in range(len(t) - 199) if counts[t[i : i + 200]] > 1}
    assert set(zip(*(x.tolist() for x in family.marked()), strict=True)) == want
    for level in family.levels:
        assert level is None or (level.rows[1:] >= level.rows[:-1]).all()
    assert any(isinstance(x, SuffixArray) for x in family.levels) and family.by_batch == 0 < family.by_levels
    assert len(IndexFamily().marked()[0]) == 0


def test_most_marks_come_from_levels(spark, monkeypatch):
    """Of the windows of the test tables' texts that get marked, most are found by scans of earlier documents' levels."""
    seen = []
    monkeypatch.setattr(suffix_dedup, "IndexFamily", lambda: seen.append(IndexFamily()) or seen[-1])
    runs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    pieces = [(0, -1, r.doc_id, 0, r.text.encode()) for r in sorted(runs) if r.text and len(r.text) > 250]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pieces, strict=True)], ["group", "salt", "rid", "at", "piece"])
    found = pa.Table.from_batches(list(suffix_dedup._met(iter([batch])))).to_pylist()
    counts = Counter(p[4][i : i + 200] for p in pieces for i in range(len(p[4]) - 199))
    want = {(p[2], i) for p in pieces for i in range(len(p[4]) - 199) if counts[p[4][i : i + 200]] > 1}
    assert {(r["rid"], i) for r in found for i in range(r["at"], r["past"])} == want
    assert sum(f.by_levels for f in seen) > sum(f.by_batch for f in seen) > 0


def test_long_runs_are_cut(spark, monkeypatch):
    """Texts whose windows all have one key: of one byte, of a short period, and of lines with one beginning."""
    keys = np.array([5, 5, 5, 5, 5, 7, 7, 5])
    assert [x.tolist() for x in repeats.run_bounds(keys, 2)] == [[0, 2, 4, 5, 7], [2, 4, 5, 7, 8]]
    assert [x.tolist() for x in repeats.run_bounds(keys, 9)] == [[0, 5, 7], [5, 7, 8]]
    assert [len(x) for x in repeats.run_bounds(keys[:0], 9)] == [0, 0]
    rng = random.Random(3)
    lines = ["2024-01-01T00:00:00.000 INFO worker: " + "".join(rng.choice("xyz") for _ in range(40)) for _ in range(200)]
    texts = ["a" * 5000, "ab" * 2000, "\n".join(lines), "\n".join(lines[20:60] + lines[:9]), " ".join(["w"] * 3000)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, " + OTHERS)
    for key_rows in (1_000, 3):
        monkeypatch.setattr(repeats, "KEY_ROWS", key_rows)
        assert found_bytes(docs) == expected_bytes(rows)
        assert found_words(docs) == expected_words(rows)


def test_many_rows_without_identifiers(spark, corpus):
    """They are judged as the same rows with identifiers are."""
    texts = [t for _, t in corpus] * 3 + [f"{i} " + " ".join(f"w{i}_{j}" for j in range(40)) for i in range(1500)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = own.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert Counter(r[1:] for r in found_words(own)) == Counter(tuple(r)[1:] for r in dedup_words(none).select("doc_id", "removed.n_words", "removed.n_removed", "removed.kept_sha256").collect())
    got = Counter(tuple(r)[1:] for r in dedup_bytes(none).select("doc_id", "removed.n_bytes", "removed.n_removed", "removed.n_spans", "removed.kept_sha256").collect())
    assert Counter(r[1:] for r in found_bytes(own)) == got


def test_texts_over_a_mebibyte(spark):
    """One very long text, twice changed in the middle: what both have is removed, and a short text's share of it."""
    rng = random.Random(9)
    words = [f"{rng.randrange(10**6)}" for _ in range(200_000)]
    a, b = " ".join(words), " ".join(words[:100_000] + ["new"] + words[100_001:])
    short = " ".join(words[500:560])
    assert len(a) > 1 << 20
    docs = spark.createDataFrame([(1, a), (2, b), (3, short + " own end")], "doc_id long, text string")
    got = {r.doc_id: r for r in dedup_words(docs, keep=False).select("doc_id", "removed.*").collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (199_999, 199_999, 60)
    assert list(got[1].starts) == [0, 100_001] and list(got[1].ends) == [100_000, 200_000]
    at = len(" ".join(words[:100_000])) + 1
    got = {r.doc_id: r for r in dedup_bytes(docs, keep=False).select("doc_id", "removed.*").collect()}
    assert list(got[1].starts) == [0, at + len(words[100_000])] and list(got[1].ends) == [at, len(a)]
    assert got[2].n_removed == got[1].n_removed and got[3].n_removed in (len(short), len(short) + 1)


def test_one_identifier_with_several_texts(spark):
    """Of rows under one identifier, copies and near copies go, other texts stay; which row stays doesn't depend on the order."""
    near = [f"n{i}" for i in range(80)]
    far = " ".join(f"f{i}" for i in range(30))
    rows = [(5, " ".join(near)), (5, " ".join([*near[:-1], "end"])), (5, far), (5, far), (5, None), (6, " ".join([*near[1:], "more"])), (7, far + " and much more that is said only here " * 3), (8, "alone")]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(i, t, f"l{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(2)
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
        assert Counter(i for i, _ in kept) == Counter({5: 3, 7: 1, 8: 1})
        assert {far, None} < {t for i, t in kept if i == 5}
        if seed:
            assert sorted(kept, key=str) == first
        first = sorted(kept, key=str)


# n-gram join


def brute_components(rows):
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = WORDS.findall((t or "").encode().lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y) or rows[a][0] == rows[b][0]:
                root[find(a)] = find(b)
    least = {}
    for k in sets:
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted((rows[k][0], len(sets[k]), least[find(k)]) for k in sets)


@pytest.mark.parametrize("hot", [64, 2])
def test_join_against_brute_force(docs, rows, monkeypatch, hot):
    if hot == 2:  # every way for many candidates and crowded places as well
        monkeypatch.setattr(ngram_join, "TABLE_CANDIDATES", 3)
        monkeypatch.setattr(ngram_join, "PAIR_ROWS", 2)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len({w[0] for w in want}) - 10
    assert sorted(map(tuple, shingle_components(docs).collect())) == want


@pytest.mark.parametrize("hot", [64, 3])
def test_chains_of_near_copies(spark, monkeypatch, hot):
    """Neighbours in a chain are linked, its ends aren't; near copies that miss the least one are linked all the same."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", hot)
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    rng = random.Random(hot)
    rows, base = [], [f"w{i}" for i in range(100)]
    for step in range(40):
        base = list(base)
        base[rng.randrange(100)] = f"n{step}"
        rows.append((1000 - step, " ".join(base)))
    common = " ".join(f"c{i}" for i in range(30))
    rows += [(2000 + i, common + " " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(20, 60)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, shingle_components(docs).collect())) == brute_components(rows)


def test_crowded_places(spark, monkeypatch):
    """Texts with one common beginning and no link: their places are dealt out; those of two clusters among them are found."""
    monkeypatch.setattr(ngram_join, "PAIR_ROWS", 7)
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 10_000)
    common = " ".join(f"c{i}" for i in range(40))
    rows = [(i, common + " " + " ".join(f"u{i}_{j}" for j in range(25))) for i in range(60)]
    rows += [(100 + i, common + " " + " ".join(f"v{j}" for j in range(40)) + f" e{i}") for i in range(12)]
    rng = random.Random(1)
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, shingle_components(docs).collect())) == brute_components(rows)


def test_join_of_long_texts(spark):
    words = [f"w{i}" for i in range(200_000)]
    a, b, c = " ".join(words), " ".join([*words[:150_000], "x", *words[150_000:]]), " ".join(words[:120_000])
    assert len(a) > 1 << 20
    docs = spark.createDataFrame([(3, a), (2, b), (1, c)], "doc_id long, text string")
    assert sorted(map(tuple, shingle_components(docs).collect())) == [(1, 119_996, 1), (2, 199_997, 2), (3, 199_996, 2)]


def test_join_odd_tables(no_docs, clashing):
    assert shingle_components(no_docs).collect() == []
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in shingle_components(clashing).collect()}
    assert (4, 8, 4) in got and (None, 0, None) in got and len(got) == 4


def test_rows_without_identifiers(spark):
    """They are linked by their texts alone, and a component with one has the least identifier of the others."""
    rng = random.Random(11)
    base = [[f"w{k}_{i}" for i in range(60)] for k in range(4)]

    def near(k):
        made = list(base[k])
        made[rng.choice([0, 59])] = f"n{rng.random()}"
        return " ".join(made)

    rows = [(10 * k + i, near(k)) for k in (1, 2) for i in range(5)]
    rows += [(None, near(k)) for k in (1, 2, 3) for _ in range(3)] + [(None, " ".join(base[1]))] * 4 + [(None, " ".join(base[2]).upper()), (None, ""), (None, None), (7, ""), (-(1 << 63), "one"), (50, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter((i, 10 if "w1_5 " in t.lower() else 20) for i, t in rows if t and ("w1_5 " in t.lower() or "w2_5 " in t.lower()))
    want += Counter({(None, None): 5, (7, 7): 1, (-(1 << 63), -(1 << 63)): 1, (50, 50): 1})
    assert Counter((r.doc_id, r.component_id) for r in shingle_components(docs).collect()) == want
    kept = Counter(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == Counter({None: 16, 10: 1, 20: 1, 7: 1, -(1 << 63): 1, 50: 1})


def test_prefixes_and_sets():
    for n in range(1, 300):
        assert prefix_length(n) == n - next(k for k in range(n + 1) if 5 * k >= 4 * n) + 1
    assert prefix_length(0) == 0
    assert len(shingle_set(b"a b c d e f")) == 2 and len(shingle_set(b"A b")) == 1 and len(shingle_set(b" \n")) == 0
    assert shingle_set(b"A b").tolist() == shingle_set(b"a  B").tolist() != shingle_set(b"a b c").tolist()


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**64, 3000, np.uint64)
    for _ in range(200):
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(2))
        differ = len(np.setxor1d(a, b))
        assert ngram_join.sketch_distance(ngram_join.parity_sketch(a), ngram_join.parity_sketch(b)) <= differ
    assert ngram_join.sketch_distance(ngram_join.parity_sketch(a), ngram_join.parity_sketch(a)) == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300)]
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(k, find(k)) for k in list(root) if find(k) != k}
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_have_no_bound_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(stars, "ROUNDS", 2, raising=False)
    edges = [((7 * i) % 101, (7 * i + 7) % 101) for i in range(100)]
    assert {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(k, 0) for k in range(1, 101)}
