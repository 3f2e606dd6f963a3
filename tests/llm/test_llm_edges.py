"""Cases that the operators' docstrings define: nulls, long texts, repeats, empty tables, names that clash; and bounds that they state."""

import itertools
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lumirel.llm import byte_bpe, compression_classifier, html_text, language_id, mixing, quality_rules, warc

NAMES = ["score", "predicted", "row", "rest", "spans", "_", "key", "nth", "doc", "of", "routed", "times", "text_key", "row_key", "n_chars"]


def crowded(spark, rows):
    """Documents (doc_id, text, source) with many columns whose names clash with the operators' own."""
    schema = ", ".join(["doc_id int", "text string", "source string", *(f"`{c}` int" for c in NAMES)])
    return spark.createDataFrame([(*r, *range(len(NAMES))) for r in rows], schema)


def test_score_is_by_the_difference_of_sizes_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.filter("quality is not null").collect()}
    out = [r for r in compression_classifier.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in out)
    y = np.array([truth[r.doc_id] for r in out])
    score = np.array([r.score for r in out])
    order = np.argsort(np.argsort(score))
    auc = (order[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.98 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    assert np.mean([r.predicted for r, t in zip(out, y, strict=True) if t == 1]) > 0.99


def test_calibration_is_isotonic_regression_by_force():
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(size=60))
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * x))).astype(float)
    want = np.array([max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    found = compression_classifier._calibrated(x, y, 0.5)
    steps = np.array(found.steps)[np.searchsorted(found.knots, x)]
    # Pools are those of the regression; each is counted with half a good label of one more row.
    pools = np.r_[0, np.cumsum(np.diff(want) > 1e-12)]
    for k in range(pools[-1] + 1):
        own = y[pools == k]
        assert len(set(steps[pools == k])) == 1
        if k in (0, pools[-1]):
            assert steps[pools == k][0] == pytest.approx((own.sum() + 0.5) / (len(own) + 1), abs=0.05)


def test_differences_are_of_compressed_segments():
    good, bad = (compression_classifier._dictionary([f"{w} and more {w} of it {i} " * 9 for i in range(60)]) for w in ("fine prose", "$$ junk"))
    scorer = compression_classifier.Scorer(compression_classifier.Model(good, bad, None, None))
    texts = [None, "", "fine prose and more " * 200, "$$ junk $$ junk", "é" * 3000]
    x, sizes = scorer.differences(texts)
    plain = {"level": compression_classifier.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    for t, got, size in zip(texts, x, sizes, strict=True):
        data = (t or "").encode()
        parts = [data[i : i + 1024] for i in range(0, len(data), 1024)]
        by = [sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain).compress(p)) for p in parts) for d in (good, bad)]
        assert size == len(data) and got == pytest.approx((by[1] - by[0]) / (len(data) + 1), abs=0.02)


def test_marginals_equal_a_sum_over_all_paths():
    rng = np.random.default_rng(4)
    k, n = 3, 6
    crf = language_id.Crf(["a", "b", "c"], np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k))
    emit = rng.normal(size=(n, k))
    got = language_id.Tagger(crf)._exact(np.exp(emit), np.array([n]))
    want = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(crf.start[path[0]] + sum(emit[i, p] for i, p in enumerate(path)) + sum(crf.transitions[p, q] for p, q in itertools.pairwise(path)))
        want[np.arange(n), list(path)] += weight
    assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_isotonic_steps_rise():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-3 * x))).astype(float)
    found = compression_classifier._calibrated(x, y, 0.5)
    grid = np.linspace(-5, 5, 400)
    score = found.score(grid)
    assert (np.diff(score) > 0).all() and 0 <= score.min() and score.max() <= 1
    assert compression_classifier._calibrated(x[:0], y[:0], 0.25).score(np.zeros(2)).tolist() == pytest.approx([0.25, 0.25])


def test_classifier_keeps_columns_of_any_name(spark):
    good, bad = "the quick brown fox jumps over the lazy dog and runs. ", "$$ ## | buy >> now !! "
    df = crowded(spark, [(i, (good if i % 2 else bad) * (3 + i % 5), "s") for i in range(120)] + [(500, None, None), (501, "", None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (7, None), (9999, 1)], "doc_id int, quality int")
    model = compression_classifier.train(df, labels)
    out = compression_classifier.keep_good(df, model)
    assert out.columns == df.columns
    assert {r.doc_id % 2 for r in out.filter("doc_id < 120").collect()} == {1}
    again = compression_classifier.keep_good(df.union(df), model)
    assert again.count() == 2 * out.count()
    assert compression_classifier.keep_good(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        compression_classifier.classify(df, model)


def test_mix_keeps_columns_of_any_name_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text + f" {i}", "ab"[i % 2]) for i in range(20)] + [(3, "same text here " * 9, "a")] * 4 + [(None, "no id " * 30, None)] * 2 + [(77, None, "a"), (78, "", "b")]
    df = crowded(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.withColumn("n", F.regexp_count("text", F.lit(mixing.WORD)))
    words = {r.doc_id: r.n for r in got.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    taken = {r.doc_id: r.n for r in mixing.taken(df).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}
    assert words == taken
    assert all(r.n_chars == len(r.text) and r.key == NAMES.index("key") for r in out.collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0


def test_operators_take_ids_of_any_type(spark):
    df = spark.createDataFrame([("x", "a b c"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in quality_rules.quality_rules(df).collect()} == {"x", None}
    assert quality_rules.quality_rules(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id int, html string")
    assert sorted(r.text for r in html_text.extract(pages).collect()) == ["", "a", "a"]
    assert html_text.extract(pages.limit(0)).count() == 0
    crf = language_id.train(spark.createDataFrame([(1, "the dog", "xx")], "doc_id long, text string, lang string"))
    assert language_id.identify(df.limit(0), crf).count() == 0


@pytest.mark.parametrize("unit, n", [("<a ", 300_000), ('<a ">', 150_000), ("<p>", 150_000), ("<tr><td>x", 50_000), ("<!--", 200_000), ("<b>x</i>", 100_000)])
def test_rendering_takes_time_in_proportion(unit, n):
    began = time.time()
    html_text.render(unit * n)
    assert time.time() - began < 15


ODD_SHEETS = [
    ("<style>", "/*a", ""),
    ("<style>", "/*a", "</style>x"),
    ("<script>", "</script ", ""),
    ("<script>", "</script ", "</script>x"),
    ("<style media='x", " ", "y'>p{display:none}</style><p>x"),
    ("<p style='a:\"", '\\"', "'>x"),
    ('<style>a:"', '\\"', "</style>x"),
    ("<style>", '"\n', "</style>x"),
    ("<style>", "a;", "</style>x"),
    ("<style>", "@media a{", "</style>x"),
    ("<style>", "{", "</style>x"),
    ("<p style='", "visibility : ", "'>x"),
]


@pytest.mark.parametrize(("head", "unit", "tail"), ODD_SHEETS)
def test_odd_sheets_take_time_in_proportion(head, unit, tail):
    times = []
    for size in (250_000, 1_000_000):
        began = time.process_time()
        assert html_text.render(head + unit * (size // len(unit)) + tail) == tail[-1:]
        times.append(time.process_time() - began)
    assert times[1] < 4 and times[1] < 8 * times[0] + 0.5


def test_sheets_by_their_parts():
    render = html_text.render
    for sheet in ("/* .a{} */.x{display:none}", "@import 'a';.x{display:none}", ".y{a:'}';b:1}.x{display:none}", ".x{color:red;display:none;}", "@media screen , all{.x{display:none}}", "@media ONLY   screen{.x{display:none}}", "@charset \"u\"; /**/ .x{display:none}/* open"):
        assert render(f"<style>{sheet}</style><p class=x>no<p>yes") == "yes", sheet
    for sheet in ("/* .x{display:none}", ".x{content:'display:none", "@media print{.x{display:none}}", "@x .x{display:none}", ".y .x{display:none}", ".y{.x{display:none}}"):
        assert render(f"<style>{sheet}</style><p class=x>seen") == "seen", sheet
    assert render("<script>a</script x>b") == "b" and render("<script>a</scripts></script\n>b") == "b" and render("<script>a</script b") == ""


def test_rendering_of_visibility_and_tables():
    render = html_text.render
    assert render("<style>@media print{.x{display:none}}</style><p class=x>keep me</p>") == "keep me"
    assert render("<p style=\"content:'display:none'\">keep</p>") == "keep"
    assert render('<div style="visibility:hidden">no<b style="visibility:visible">yes</b></div>') == "yes"
    assert render("<style>.v{visibility:hidden} .n{display:none}</style><p class=v>a<i style='visibility:visible'>b</i></p><p class=n><i style='visibility:visible'>c</i></p>") == "b"
    assert render("<svg><title>t</title><text>seen</text></svg>") == "seen"
    assert render("<div hidden><div>b</div>c</div>d") == "d"
    assert render("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>") == "A  b1\n   b2"
    assert render("<table><tr><td colspan=2>long long<tr><td>a<td>b<tr><td>cc<td>d</table>") == "long long\na   b\ncc  d"


def test_archives_are_bounded_in_bytes(spark, tmp_path):
    rng = np.random.default_rng(1)
    text = "".join(chr(c) for c in rng.integers(97, 123, 2_000_000))
    rows = [(i, "http://a/b", text[i : i + size]) for i, size in enumerate([10] * 50 + [900_000] * 3 + [1_500_000] * 6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"))
    sizes = [r.length for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(str(tmp_path / "w")).select("length").collect()]
    assert len(sizes) == 4
    assert warc.captures(warc.read(spark, str(tmp_path / "w"))).count() == len(rows)


def test_languages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert language_id.languages(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "a b c", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred, r.score) for r in language_id.languages(unlabelled).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}


def test_tokens_of_repeated_ids(spark):
    rows = [(1, "the same"), (1, "the same"), (1, "another text"), (None, "the same"), (None, None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, n_tokens string")
    got = byte_bpe.token_digests(docs).collect()
    assert len(got) == 5 and len({(r.ids_sha256, r.decoded_sha256) for r in got}) == 3
    assert sorted((r.doc_id is None, r.n_tokens == 0) for r in got) == [(False, False)] * 3 + [(True, False), (True, True)]
