"""Each operator against a brute-force version, an exact round trip or held-out accuracy, with the cases that its docstring defines."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirel.llm import byte_bpe, compression_classifier, exact_dedup, html_text, language_id, minhash, mixing, quality_rules, suffix_dedup, warc
from lumirel.llm.common import span_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rep long, block string, fp string"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall((text or "").encode())


def frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, None, None, None, "k", 7, "b", "f") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3000
EDGES = [None, "", " \t\n", "one", "one", "a b c d e", "A B C D E", "a b c d e f", LONG, LONG, "é ü 漢字 \U0001f600 x y z", "a" * 30000, "a\xa0b c"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components_by_force(texts):
    sets = {}
    for i, t in texts:
        w = [x.lower() for x in words_of(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for i in sorted(sets):
        met = Counter()
        for s in sets[i]:
            for o in holders[s]:
                met[o] += 1
            holders[s].append(i)
        for o, n in met.items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[o]) - n):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(df).collect()}


def test_near_dedup_equals_force(spark, docs):
    assert near_rows(docs) == components_by_force([(r.doc_id, r.text) for r in docs.collect()])


def test_near_dedup_edges(spark):
    df = frame(spark, EDGES)
    out = minhash.near_dedup(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == components_by_force(list(enumerate(EDGES)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_of_a_group_of_edited_copies(spark):
    """Many copies of one text with few to many edits: all links count, also those that no star has."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for k in rng.choice(120, rng.integers(1, 9), replace=False):
            w[k] = f"x{rng.integers(0, 40)}"
        if rng.random() < 0.3:
            del w[int(rng.integers(0, 100))]
        texts.append(" ".join(w))
    texts += [" ".join(f"u{j}x{i}" for i in range(60)) for j in range(20)]
    assert near_rows(frame(spark, texts)) == components_by_force(list(enumerate(texts)))


def _groups(pairs):
    groups = defaultdict(set)
    for k, x in pairs:
        groups[k].add(x)
    return groups.values()


def test_stars_pair_a_document_once_a_round(spark):
    """A group of edited copies is joined by about one link a copy, whatever its size."""
    rng = np.random.default_rng(8)
    for n in (100, 400):
        texts = []
        for _ in range(n):
            w = [f"w{i}" for i in range(200)]
            for k in rng.choice(200, rng.integers(1, 6), replace=False):
                w[k] = f"x{rng.integers(0, 1000)}"
            texts.append(" ".join(w))
        df = frame(spark, texts)
        signed = df.select("doc_id", "text").withColumn("print", F.lit(0).cast("long")).mapInArrow(minhash._sign, "doc_id long, print long, key binary, n_shingles long, sig binary")
        reps = signed.select(F.col("doc_id").alias("rep"), "doc_id", "key", "n_shingles", "sig")
        links, comp = minhash.near_links(df.select("doc_id", "text"), reps)
        assert links.count() <= 1.5 * n
        force = components_by_force(list(enumerate(texts)))
        assert {frozenset(g) for g in _groups((r.comp, r.rep) for r in comp.collect())} == {frozenset(g) for g in _groups((c, i) for i, (_, c) in force.items())}


def test_rows_that_share_a_doc_id_are_documents(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = frame(spark, [one, two, one + " x", two + " y", one], [3, 3, 4, 5, 3])
    assert sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_dedup(df).collect()) == [(3, 3, True)] * 3 + [(4, 3, False), (5, 3, False)]


def test_deduplication_keeps_columns_of_any_name(spark):
    clash = ["_slot", "_bucket", "_id", "_sha", "_routed", "row", "routed", "own", "id", "slot", "bucket", "of", "print", "key"]
    df = spark.createDataFrame([(i, t, *[7] * len(clash)) for i, t in enumerate(["a b c d e f", "a b c d e f", "q r s t u v"])], ", ".join(["doc_id int", "text string", *(f"{c} int" for c in clash)]))
    for keep in (minhash.keep_one, exact_dedup.keep_first):
        out = keep(df)
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect())) == [(0, "a b c d e f", *[7] * len(clash)), (2, "q r s t u v", *[7] * len(clash))]


def test_near_dedup_nulls_repeats_and_empty(spark):
    out = minhash.near_dedup(frame(spark, ["a b c d e f", "a b c d e f", "q r s t u v", "a b c d e f"], [None, 5, None, 5])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in out if r.component_id) == [(False, 5, True), (False, 5, True), (True, 5, False)]
    assert [r.kept for r in out if r.component_id is None] == [True]
    assert minhash.near_dedup(frame(spark, [])).count() == 0


def test_keep_one_keeps_columns(spark):
    df = frame(spark, EDGES)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in components_by_force(list(enumerate(EDGES))).items() if i == c)


def test_signature_matches_follow_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, 50, 50))
    x, y = minhash.signature(np.concatenate([shared, a])), minhash.signature(np.concatenate([shared, b]))
    assert abs((x == y).mean() - 0.75) < 0.2


# Byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, tiktoken_encoding):
    rng = np.random.default_rng(1)
    signs = list(" '’\n\t\r\xa0　absStTrelvdmLl019٣²é漢!?.-_\U0001f600́x''  ")
    texts = EDGES + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(800)] + ["don't we'll they're 'S 's'stuff  ", "'" * 50, "ab" * 2000]
    rows = byte_bpe.decode(byte_bpe.encode(frame(spark, texts))).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == tiktoken_encoding.encode_ordinary(text)
        assert bytes(r.data) == text.encode()
        assert r.offsets == sorted(r.offsets) and len(r.offsets) == len(r.ids)


def test_bpe_digests(spark, docs, tiktoken_encoding):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in byte_bpe.token_digests(docs).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert byte_bpe.token_digests(frame(spark, [])).count() == 0


# Quality rules


def base_by_force(text):
    text = text or ""
    w = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_base_equals_force(spark, docs):
    rows = docs.union(frame(spark, EDGES, range(10**6, 10**6 + len(EDGES))).select(docs.columns))
    texts = {r.doc_id: r.text for r in rows.collect()}
    out = quality_rules.quality_rules(rows).collect()
    assert len(out) == len(texts)
    for r in out:
        want = base_by_force(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_line_rules_remove_lines_then_documents(spark):
    good = " ".join(f"word{i}" for i in range(40))
    nav = "Home | News | About | Contact | More"
    texts = [good + "\n" + nav, good + "\n" + "\n".join(f"a{i}{i} | b{i}{i} | c{i}{i} | d{i}{i} | e{i}{i}" for i in range(30)), good + "\nLicensed under the Apache License, Version 2.0."]
    rows = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts), with_text=True).collect()}
    assert rows[0].kept and rows[0].clean_text == good
    assert not rows[1].kept and rows[1].n_lines_removed == 30
    assert rows[2].kept and rows[2].clean_text == good


def test_quality_rules_follow_labels(spark, docs, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in out if r.quality == 1]) > 0.95
    assert np.mean([r.kept for r in out if r.quality == 0]) < 0.1


# Quality classifier


def test_classifier_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    out = compression_classifier.quality_scores(docs, labels)
    rows = out.join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.collect())


def test_classifier_edges(spark):
    df = frame(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in compression_classifier.quality_scores(df, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 0), (8, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")
    assert compression_classifier.quality_scores(df, odd).count() == len(EDGES)
    assert compression_classifier.quality_scores(frame(spark, []), odd).count() == 0


# Mixing


def targets_by_force(sizes):
    """Shares by weight, with what is above twice a source's size shared again, until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: 2 * sizes[s] if s in full else rest * weight[s] / open_ for s in names}
        over = {s for s in names if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return share
        full |= over


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src7", F.col("source")))
    text = {r.doc_id: r for r in docs.collect()}
    out = mixing.taken(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(text)
    sizes = defaultdict(int)
    for r in text.values():
        sizes[r.source] += len(words_of(r.text))
    want = targets_by_force(sizes)
    got = defaultdict(int)
    for r in out:
        assert r.size == len(words_of(text[r.doc_id].text)) and r.source_size == sizes[text[r.doc_id].source]
        assert r.target == pytest.approx(want[text[r.doc_id].source])
        assert 0 <= r.taken <= 2 * r.size
        got[text[r.doc_id].source] += r.taken
    for s in sizes:
        assert abs(got[s] - want[s]) <= 3 * mixing.BLOCK_WORDS
    assert sorted((r.doc_id, r.taken) for r in mixing.taken(docs).collect()) == sorted((r.doc_id, r.taken) for r in out)


def test_mixed_documents_hold_what_was_taken(spark, docs):
    mixed = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        mixed[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text)
    assert mixed == {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken}


def test_mixing_edges(spark):
    out = mixing.taken(frame(spark, [*EDGES, "x y", "x y"], [*range(len(EDGES)), 3, 3])).collect()
    assert len(out) == len(EDGES) + 2 and all(r.taken <= 2 * r.size for r in out)
    for texts in ([], [None, ""]):
        assert mixing.taken(frame(spark, texts)).count() == len(texts)
        assert mixing.mixed_documents(frame(spark, texts)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 1000003, 4096])
def test_permutations_are_one_to_one(spark, n):
    i = F.col("id")
    rows = spark.range(n).select(mixing.permuted(i, F.lit(n).cast("long"), F.lit("k")).alias("p"))
    low, high, distinct = rows.agg(F.min("p"), F.max("p"), F.countDistinct("p")).first()
    assert (low, high, distinct) == (0, n - 1, n)


# Suffix-array deduplication


def spans_by_force(texts, width=400):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[p : p + width] for d in data for p in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - width + 1):
            if count[d[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((len(d), int(gone.sum()), int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_difference_cover_has_every_difference():
    for level in suffix_dedup.LEVELS:
        cover = suffix_dedup.difference_cover(level.order)
        assert {(i - j) % level.v for i in cover for j in cover} == set(range(level.v))
        assert level.depth > 0


def test_fingerprints_are_those_of_the_prime():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, suffix_dedup.P, 2000).astype(np.uint64) for _ in range(2))
    got = suffix_dedup.times(a, b)
    assert (got % np.uint64(suffix_dedup.P)).tolist() == [x * y % suffix_dedup.P for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    data = rng.integers(97, 100, 500).astype(np.uint8)
    shifted = np.r_[rng.integers(97, 100, 77).astype(np.uint8), data]
    at = np.arange(400)
    for symbols in (data, span_hashes(data, np.arange(500), np.arange(500) + 1)):
        own = symbols if symbols.dtype == np.uint8 else np.r_[symbols[:77], symbols]
        moved = shifted if symbols.dtype == np.uint8 else own
        x = suffix_dedup.Fingerprints(symbols, 12345678901).of(at, at + 50)
        y = suffix_dedup.Fingerprints(moved, 12345678901).of(at + 77, at + 127)
        assert (x == y).all()


def passages_by_force(texts, width=51):
    words = [words_of(t) for t in texts]
    holders = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(len(w) - width + 1):
            holders[tuple(w[k : k + width])].add(i)
    out = []
    for w in words:
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - width + 1):
            if len(holders[tuple(w[k : k + width])]) > 1:
                hit[k : k + width] = True
        out.append(int(hit.sum()))
    return out


def thue_morse(n, a="a", b="b"):
    """A word and its complement: sums of powers modulo 2**64 don't tell them apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_hashes_tell_spans_apart():
    x, y = thue_morse(1024)
    for one, other in ((x, y), ("a" * 9, "a" * 10), ("", "\0"), ("abcdefgh", "abcdefgh\0"), ("q" * 2000, "q" * 1999 + "r")):
        data = np.frombuffer((one + other).encode(), np.uint8)
        h = span_hashes(data, np.array([0, len(one)]), np.array([len(one), len(data)]))
        assert h[0] != h[1]


def test_texts_of_thue_morse_are_told_apart(spark):
    x, y = thue_morse(1024)
    rest = " ".join(f"w{i}" for i in range(30))
    rows = quality_rules.quality_rules(frame(spark, [f"{x}\n{y}\n{x}"])).collect()
    assert [(r.n_words, r.n_dup_lines) for r in rows] == [(3, 1)]
    texts = [f"{x} {rest} {x}", f"{y} {rest} {y}", f"{x} a b c d {y} a b c d"]
    assert near_rows(frame(spark, texts)) == components_by_force(list(enumerate(texts)))
    found = suffix_dedup.repeated_spans(frame(spark, [x, y, x[:512] + "c"])).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in found} == dict(enumerate(spans_by_force([x, y, x[:512] + "c"])))


def test_passages_equal_force(spark):
    rng = np.random.default_rng(2)

    def words(n):
        return " ".join("".join(rng.choice(list("abcdef"), rng.integers(1, 9))) for _ in range(n))

    shared, other = words(60), words(51)
    texts = [None, "", words(80) + " " + shared, shared + "\n" + words(5), other, words(30) + "  " + other.replace(" ", "\t") + " " + words(9), words(50), "the " * 300, shared.rsplit(" ", 10)[0] + " x", "x" + other, words(400)]
    texts += [f"{words(3)} {words(60)} {words(2)}"] * 2 + [" ".join([words(52)] * 2)]
    for parts in (1, 3):
        rows = suffix_dedup.repeated_spans(frame(spark, texts).repartition(parts)).collect()
        assert {r.doc_id: r.n_passage_words for r in rows} == dict(enumerate(passages_by_force(texts)))


def test_repeated_spans_equal_force(spark):
    rng = np.random.default_rng(9)

    def text(n):
        return "".join(rng.choice(list("abcdefgh éü \n"), n))

    shared, edge = text(700), "z" * 399
    texts = [None, "", "short", text(900), text(300) + shared + text(50), shared, text(10) + shared[:450] + text(500), shared[:399] + "Q", edge, edge, "y" * 401, "ab" * 400, text(3000), "é" * 250, "é" * 260]
    base = text(5000)
    texts += [base, base, base[:2000] + "!" + base[2000:], text(100) + base[1000:1800] + text(100) + shared[100:650]]
    for parts in (1, 3):
        rows = suffix_dedup.repeated_spans(frame(spark, texts).repartition(parts)).collect()
        assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(spans_by_force(texts)))


def test_repeated_spans_of_more_partitions_than_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh"), 900))
    texts = ["".join(rng.choice(list("abcdefgh"), 700)) + (shared if i % 3 == 0 else "") for i in range(40)]
    limit = "spark.sql.sources.bucketing.maxBuckets"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "4")
        for parts, unit in ((5, 128 << 20), (40, 128 << 20), (6, 2000)):
            monkeypatch.setattr(suffix_dedup, "UNIT_TEXT", unit)
            rows = suffix_dedup.repeated_spans(frame(spark, texts).repartition(parts)).collect()
            assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(spans_by_force(texts)))
        with pytest.raises(Exception, match="nothing of the kind"):
            suffix_dedup.repeated_spans(frame(spark, texts).withColumn("text", F.raise_error(F.lit("nothing of the kind")))).collect()
    finally:
        spark.conf.set(limit, before)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("units_")]


def test_repeated_spans_null_ids_and_empty(spark):
    long = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(900))
    rows = suffix_dedup.repeated_spans(frame(spark, [long, long, "x"], [None, 1, 1])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 900, 900]
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


# HTML


def test_html_layout():
    page = (
        "<html><head><title>T</title><style>.no{display:none}</style><script>x='</p>'</script></head><body><p>One <b>two</b>  three<p>four<br>five<ul><li>a<li>b<ol><li>c<li>d</ol></ul>"
        "<table><tr><th>Name<th>Qty<tr><td>apple<td>3</table><div class=no>hidden</div><span style='display: none'>gone</span><pre>x\n  y</pre>end &amp; &lt;tag&gt; 3 < 4<!-- c --></body>"
    )
    assert html_text.render(page) == (
        "One two three\n\nfour\nfive\n\n- a\n- b\n\n  1. c\n  2. d\n\nName   Qty\napple  3\n\nx\n  y\n\nend & <tag> 3 < 4"
    )
    assert html_text.render(None) == html_text.render("") == ""
    assert html_text.render("<p>open") == "open" and html_text.render("a <") == "a <"
    assert html_text.render("<div>" * 20000 + "x") == "x"
    assert html_text.render("<td>loose<li>item") == "loose\nitem"


def test_html_emits_all_visible_words(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        body = re.sub(r"(?s)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", sources[r.page_id])
        plain = html.unescape(re.sub(r"<[^>]*>", "\n", body)).split()
        got = [w for w in r.text.split() if w != "-"]
        assert got == [w for w in plain if w != "-"]


# Exact deduplication


def test_exact_dedup_equals_force(spark, docs):
    texts = {r.doc_id: re.sub(r"[\x20\t-\r]+", " ", r.text or "") for r in docs.union(frame(spark, EDGES, range(10**6, 10**6 + len(EDGES))).select(docs.columns)).collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    out = exact_dedup.exact_dedup(docs.union(frame(spark, EDGES, range(10**6, 10**6 + len(EDGES))).select(docs.columns))).collect()
    assert len(out) == len(texts)
    for r in out:
        own = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(own), len(own), r.doc_id == min(own))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(4)
    few = rng.integers(0, 2**63, 300).astype(np.uint64)
    parts = [rng.choice(few, 1000) for _ in range(5)] + [np.repeat(few[:1], 70000), few[:0]]
    whole = None
    for p in parts:
        f = exact_dedup.QuotientFilter.from_bytes(exact_dedup.QuotientFilter.build(p).to_bytes())
        whole = f if whole is None else whole.merge(f)
    assert dict(zip(whole.fingerprints().tolist(), whole.counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())


def test_exact_dedup_nulls_repeats_and_empty(spark):
    df = frame(spark, ["a b", "a  b", "a\tb", "c", "c"], [None, 4, 2, 9, 9])
    rows = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.keep_id, r.group_size) for r in rows) == [(2, 3), (2, 3), (2, 3), (9, 2), (9, 2)]
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a\tb"), (9, "c")]
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


# WARC


def test_warc_round_trip_and_revisits(spark, tmp_path):
    big = "<html>" + "é x" * 100 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</html>"
    rows = [(3, "http://a.b/c", big), (1, "http://a.b/d?e", big), (2, None, None), (5, "http://x", "tiny"), (6, "http://x", "tiny"), (7, "u\nv", ""), (8, "http://a", big + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    found = warc.read(spark, str(tmp_path / "w"))
    assert found.groupBy("type").count().count() == 4 and found.count() == 21
    done = {r.page_id: r for r in warc.captures(found).collect()}
    assert len(done) == 7 and all(r.request and r.metadata for r in done.values())
    assert bytes(done[1].response.payload) == big.encode() and done[3].response.payload is None
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_assemble(pages).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        again = page == 3
        assert out[page] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None)


def test_warc_ids_of_any_type_and_clashing_columns(spark):
    same, big = "x" * 200, "y" * 70_000
    rows = [("a b:1>\r\n", same), ("", same), ("é", "tiny"), (None, same), ("z", big), ("z", same), ("zz", big)]
    pages = spark.createDataFrame([(i, "u", h, "c", 1, "d") for i, h in rows], "page_id string, url string, html string, digest string, group int, capture string")
    got = Counter(tuple(r) for r in warc.archive_and_assemble(pages).collect())
    digest = lambda h: hashlib.sha256(h.encode()).hexdigest()
    want = Counter()
    for i, h in rows:
        first = "" if h == same else "z"
        again = len(h) >= 100 and i != first
        want[i, len(h), digest(h), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    assert warc.archive_and_assemble(pages).schema["refers_to"].dataType.simpleString() == "string"


def test_warc_edges(spark):
    assert warc.archive_and_assemble(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    odd = spark.createDataFrame([(None, None, None), (4, "u", "x" * 200), (4, "u", "x" * 200)], "page_id long, url string, html string")
    assert warc.archive_and_assemble(odd).count() == 3
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: 9\r\n\r\nshort"))


# Language identification


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.languages(docs).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_forward_backward_over_chunks_is_exact():
    rng = np.random.default_rng(2)
    crf = language_id.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    counts = np.array([1, 200, 0, language_id.CHUNK, language_id.CHUNK + 1])
    emit = rng.normal(size=(counts.sum(), 3))
    got = language_id.Tagger(crf)._exact(np.exp(emit), counts)
    at = 0
    for n in counts:
        if n:
            want, _ = language_id._forward_backward(emit[None, at : at + n], crf.transitions, crf.start)
            assert np.allclose(got[at : at + n], want[0])
        at += n


def test_code_switched_words_and_edges(spark):
    rng = np.random.default_rng(8)
    kinds = {"xx": ["dog", "the", "runs", "over"], "yy": ["perro", "corre", "sobre", "ella"]}
    rows = [(i, " ".join(rng.choice(kinds[lang], 30)), lang) for i in range(80) for lang in [["xx", "yy"][i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = language_id.train(docs)
    post, _, _ = language_id.Tagger(crf).marginals(["the dog runs over the perro corre sobre ella corre"])
    assert np.argmax(post, axis=1).tolist() == [0] * 5 + [1] * 5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (None, "the dog"), (4, "perro " * 20000)], "doc_id long, text string")
    out = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(odd, crf).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[None][0] == "xx" and out[4][0] == "yy"
    none = language_id.languages(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
