"""Spelling variants, periodic runs and near-duplicate vectors: against their SQL on a table, and against plain enumeration."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumirel.llm import embedding_dedup, minhash, periodic, queries, spelling


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
    return sorted((tuple(str(int(v)) if isinstance(v, (int, float, np.number)) else str(v) for v in r) for r in df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_periodic_runs", "op13_embedding_near_dedup"])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("segment_words", [1, 3, 1 << 15])
def test_pairs_one_edit_apart_by_force(spark, segment_words):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(220)} | {"a" * 40, "a" * 41, "b" + "a" * 40, "a" * 20 + "b" + "a" * 20})
    counts = {w: rng.choice([5, 6, 25, 30, 200]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.form_n, r.nearest) for r in spelling.near_words(frame, [], segment_words=segment_words).collect()}
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        best = min(((-counts[x], x) for x in near), default=None)
        assert got.get(w) == ((len(near), -best[0], best[1]) if near else None)


def test_acceptors_are_minimal():
    fsa = spelling.Acceptors()
    fsa.build(sorted(a + b for a in ("ab", "ac", "bb") for b in ("xx", "xy", "yx")))
    # Behind two letters all words go on alike: 4 states for these, and 2 for the first letters.
    assert len(fsa.ways) == 6 or len(fsa.ways) == 7


def test_variants_in_odd_texts(spark):
    big = "Zürich" * 3000
    rows = [(None, None, 1), (None, "", 2), (1, "Letter letter LETTER leTTer letter. lettre", 3), (1, "Letters letters letters letters letters" + " lettre" * 4, 3), (2, ("letter " * 30), 4), (2, (big + " ") * 5, 4), (3, (big + "x ") * 30, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r for r in spelling.spelling_variants(docs).collect()}
    low = "".join(c.lower() if c < "\x80" else c for c in big)
    assert set(got) == {"letter", "letters", "lettre", low, low + "x"}
    assert (got["letters"].form, got["letters"].root, got["letters"].n_near, got["letters"].form_n) == ("letter", "letter", 1, 35)
    assert got["letter"].form is None and got["letter"].root == "letter" and got["lettre"].n_near == 0
    assert got[low].form == low + "x"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).count() == 0


def test_roots_follow_long_ways(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(forms).collect()} == {(f"w{i}", "w13") for i in range(13)} | {("x", "w13")}


def test_letters_go_where_the_checksum_says(spark):
    docs = spark.createDataFrame([(i, "misspelling") for i in range(300)], "doc_id long, text string")
    want = Counter()
    for i in range(300):
        h = zlib.crc32(f"{i}:misspelling".encode())
        want["misspelling" if h % 7 else "misspelling"[: h % 11] + "misspelling"[h % 11 + 1 :]] += 1
    assert {r.word: r.n for r in spelling.vocabulary(docs, 7, least_count=1).collect()} == want


def test_lyndon_arrays_by_force():
    rng = random.Random(1)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(30))]
        want = []
        for i in range(len(w)):
            j = i + 1
            while j < len(w) and w[i:] < w[j:]:
                j += 1
            want.append(j - i)
        assert periodic.lyndon_array(w) == want


def runs_by_force(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(12, 2 * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def odd_words(rng):
    w, k, n = [], rng.choice([1, 2, 3, 10, 100]), rng.choice([0, 20, 80])
    while len(w) < n:
        if rng.random() < 0.3 and w:
            w += w[-rng.randrange(1, 12) :] * rng.randrange(1, 6)
        else:
            w.append(rng.randrange(k))
    return w


def test_runs_and_what_is_kept_by_force(spark):
    rng = random.Random(2)
    texts = [[f"w{x}" for x in odd_words(rng)] for _ in range(150)] + [["x"] * 5000, [], [str(i) for i in range(600)] * 2]
    rows = [(i, "\n ".join(t), "c") for i, t in enumerate(texts)] + [(None, None, "c"), (None, "x " * 12, "c"), (7, "x\u00a0y " * 12, "c"), (7, "x\u00a0y " * 12, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.periodic_runs(docs).collect()
    digests = periodic.run_digests(docs).collect()
    assert len(got) == len(digests) == len(rows)
    total = 0
    for (_, text, _), r, d in zip(rows, got, digests, strict=True):
        # A no-break space is part of a word.
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want = sorted(runs_by_force(w), key=lambda x: (x[0], x[2]))
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == kept
        top = min(((-n, s, p) for s, n, p in want), default=None)
        assert (d.n_runs, d.length, d.start, d.period) == ((len(want), -top[0], top[1], top[2]) if top else (0, None, None, None))
        assert d.exponent_milli == (1000 * -top[0] // top[2] if top else None)
        assert d.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
        assert d.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        total += len(want)
    assert total > 50
    assert periodic.run_digests(docs.limit(0)).count() == 0


def test_periodic_tails_stand_where_the_checksum_says():
    words = [str(i).encode() for i in range(50)]
    for doc in map(str, range(60)):
        h, got = zlib.crc32(doc.encode()), periodic.repeat_tail(doc, words)
        if h % 10:
            assert got == words
        else:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]


def vectors_by_force(rows, threshold=0.93):
    good = [i for i, (_, e, label) in enumerate(rows) if label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    near = {i: set() for i in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    near[a].add(b)
    out = [None] * len(rows)
    for i in range(len(rows)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            low = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
            for k in seen:
                out[k] = (rows[k][0], len(near[k]), low, rows[k][0] == low)
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "spread", "most"), [(8, 0.15, 1 << 13), (3, 0.1, 16), (16, 0.3, 25)])
def test_links_of_vectors_by_force(spark, size, spread, most):
    """Also with cells so small that groups are split and dealt into blocks."""
    rng = np.random.default_rng(size)
    centres = rng.normal(size=(12, size))
    rows = [(int(i * 7 % 250), [float(np.float32(x)) for x in centres[rng.integers(12)] + spread * rng.normal(size=size)], int(rng.integers(10) == 0)) for i in range(250)]
    for i in range(0, 250, 9):
        rows[i] = (rows[i][0], rows[(i + 18) % 250][1], rows[(i + 18) % 250][2])
    bad = [None, [], [0.0] * size, [float("nan")] * size, [float("inf")] + [1.0] * (size - 1), [None] * size]
    rows += [(300 + i, e, 0) for i, e in enumerate(bad)] + [(400, rows[1][1], None), (401, rows[1][1][:-1], 0), (rows[2][0], rows[3][1], rows[3][2]), (None, rows[5][1], rows[5][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "label as row", "'x' as cell").repartition(3)
    got = [tuple(r) for r in embedding_dedup.near_vectors(frame, cell_vectors=most).collect()]
    assert sorted(got, key=str) == vectors_by_force(rows)


def test_no_vectors(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_centroids_are_of_length_one_and_told_apart():
    x = np.repeat(np.eye(3), 5, axis=0)
    c = embedding_dedup.spherical_kmeans(x, 7)
    assert len(c) == 3 and np.allclose(np.sort(c @ np.eye(3), axis=None), [0] * 6 + [1] * 3)


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_in_one_task_and_in_passes(spark, monkeypatch, few):
    monkeypatch.setattr(minhash, "FEW_LINKS", few)
    links = pd.DataFrame({"u": [1, 2, 9, 20, 7, 7], "v": [2, 5, 4, 21, 9, 8]})
    got = {r.rep: r.comp for r in minhash.components(spark.createDataFrame(links)).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 4: 4, 9: 4, 7: 4, 8: 4, 20: 20, 21: 20}
