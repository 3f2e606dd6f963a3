"""Runs of periodic words in documents, by Lyndon roots.

A run is a stretch of words with a smallest period that fits in it twice and that no neighbouring
word extends. Its root is, under one of two opposite orders of the words, the longest Lyndon
word at the place where it begins, so Lyndon arrays under both orders hold the roots of all runs.
The first phase of Baier's suffix sorting finds a Lyndon array without sorting suffixes: groups of
suffixes are gone through from the last one down, and each sends what it has in common
to the nearest suffix before it that is in a lower group. Roots are then extended to both
sides by the longest common extensions of their two ends, from names of all stretches
of 1, 2, 4 ... words; those that fill two periods are runs.

Only words that a repeated stretch of 6 words covers go through this. That loses nothing: a run of period q and
of max(12, 2 q) words or more has q words or more, and 6 at least, that return q places on, so each of its words
is in a stretch of 6 that occurs twice.

Words are compared by what they are, never by hashes. Defined cases: a null or empty text has no words and no
runs; repeated rows and null ids are documents of their own; long texts are handled whole, one in a
task's memory at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kind, mix64, text_batches, tidy, window_hashes

#: A run has so many words at least, and two periods.
LEAST_WORDS = 12
#: Any run has a stretch of so many words that returns one period on.
STRETCH = LEAST_WORDS // 2


def lyndon_array(words: list[int]) -> list[int]:
    """The length of the longest Lyndon word at each place, by phase one of Baier's grouping.

    Suffixes are grouped by what is known of their longest Lyndon word, first by one word. Groups are taken in
    descending order; each of a group's suffixes adds the group's word to the word of the nearest suffix before it that
    is in a lower group, and those that got the same anew are split off, to be right above their old group.
    """
    n = len(words)
    if not n:
        return []
    size = [1] * n
    order = sorted(set(words))
    ids = {w: k for k, w in enumerate(order)}
    group = [ids[w] for w in words]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    # Groups in a chain, each with the next lower and the next higher one; -1 ends it.
    below, above = list(range(-1, len(order) - 1)), [*range(1, len(order)), -1]
    # left[i] leads to the last place before place i that is in no group taken so far; 0 stands for none.
    left = list(range(n + 1))
    g = len(order) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        for i in own:
            left[i + 1] = i
        counts: dict[int, int] = {}
        for i in own:
            at = i
            while left[at] != at:
                left[at] = left[left[at]]
                at = left[at]
            if at:
                counts[at - 1] = counts.get(at - 1, 0) + 1
        if counts:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, times in counts.items():
                size[j] += times * size[own[0]]
                parts.setdefault((times, group[j]), []).append(j)
            for times, old in sorted(parts, reverse=True):
                new = len(members)
                members.append(parts[times, old])
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
                for j in members[new]:
                    group[j] = new
        members[g] = []
        g = below[g]
    return size


def _names(words: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4 ... words at each place: equal names, equal stretches. Ends where all names differ."""
    levels = [np.unique(words, return_inverse=True)[1]]
    while int(levels[-1].max()) + 1 < len(words):
        half = 1 << (len(levels) - 1)
        after = np.zeros(len(words), np.int64)
        after[: max(0, len(words) - half)] = levels[-1][half:] + 1
        levels.append(np.unique(levels[-1].astype(np.int64) * (len(words) + 1) + after, return_inverse=True)[1])
    return levels


def _alike(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words from the places i and j on are alike, forward (step 1) or backward (step -1)."""
    n = len(levels[0])
    found = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        a, b = (x + found if step > 0 else x - found - size + 1 for x in (i, j))
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        found += same * size
    return found


def _stretches(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the places, LEAST_WORDS or more on end, that stretches of STRETCH words cover which occur twice in their document."""
    n = len(words) - STRETCH + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Equal hashes of different stretches only send more words on.
    marks = window_hashes(mix64(words.astype(np.uint64) + np.uint64(1)), STRETCH)
    marks = np.where(docs[:n] == docs[STRETCH - 1 :], mix64(marks ^ mix64(docs[:n].astype(np.uint64))), np.arange(n, dtype=np.uint64))
    order = np.argsort(marks)
    same = marks[order[1:]] == marks[order[:-1]]
    twice = np.unique(np.r_[order[1:][same], order[:-1][same]])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + STRETCH, -1)
    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    # A document's end ends a stretch.
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | np.r_[True, docs[1:] != docs[:-1]]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | np.r_[docs[1:] != docs[:-1], True])) + 1
    long = last - first >= LEAST_WORDS
    return first[long], last[long]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of LEAST_WORDS words or more of texts of so many words each, given as numbers of words one after the other: arrays of text, start, length, period, in this order."""
    docs = np.repeat(np.arange(len(sizes)), sizes)
    first, last = _stretches(words, docs)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    # The stretches one after the other, with a word of its own before each and behind the last.
    apart = iter(range(-1, -len(first) - 2, -1))
    joined, roots, base = [], [], []
    for a, b in zip(first, last, strict=True):
        part = words[a:b].tolist()
        joined.append(next(apart))
        at = len(joined)
        base.append((at, a))
        for one in (part, [-w for w in part]):
            size = np.array(lyndon_array(one), np.int64)
            short = np.flatnonzero(2 * size <= len(part))
            roots.append(np.stack([short + at, size[short]], axis=1))
        joined += part
    joined.append(next(apart))
    i, period = np.unique(np.concatenate(roots), axis=0).T
    levels = _names(np.array(joined, np.int64))
    before, behind = _alike(levels, i - 1, i + period - 1, -1), _alike(levels, i, i + period, 1)
    start, length = i - before, before + period + behind
    found = length >= np.maximum(LEAST_WORDS, 2 * period)
    rows = np.unique(np.stack([start[found], period[found], length[found]], axis=1), axis=0)
    places, origins = np.array(base).T
    part = np.searchsorted(places, rows[:, 0], side="right") - 1
    start = rows[:, 0] - places[part] + origins[part]
    doc = docs[start]
    return doc, start - (np.cumsum(sizes) - sizes)[doc], rows[:, 2], rows[:, 1]


def repeat_tail(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail in one of ten documents, told by the crc32 of the id: runs at known places."""
    h, n = zlib.crc32(doc_id.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def _runs(rewrite: Callable[[str, list[bytes]], list[bytes]] | None, names: list[str]):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("_name").to_pylist()
            for a, b in chunks(texts):
                words = [(t or b"").split() for t in texts[a:b]]
                if rewrite:
                    words = [rewrite(x or "", w) for x, w in zip(ids[a:b], words, strict=True)]
                flat = [w for t in words for w in t]
                number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
                numbers = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
                doc, start, length, period = find_runs(numbers, np.array([len(t) for t in words], np.int64))
                lo, hi = np.searchsorted(doc, np.arange(b - a)), np.searchsorted(doc, np.arange(b - a), side="right")
                out = []
                for k, own in enumerate(words):
                    s, n, q = (x[lo[k] : hi[k]].tolist() for x in (start, length, period))
                    for x, y, z in zip(s, n, q, strict=True):
                        own[x + z : x + y] = [None] * (y - z)
                    out.append((list(zip(s, n, q, strict=True)), b" ".join([w for w in own if w is not None] if s else own)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs, _ in out], RUN),
                        pa.array([hashlib.sha256(kept).hexdigest() for _, kept in out], pa.string()) if "collapsed_sha256" in names else pa.array([kept.decode() for _, kept in out], pa.string()),
                    ],
                    names,
                )

    return run


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS = "array<struct<start: long, length: long, period: long>>"


def _found(docs: DataFrame, last: str, rewrite: Callable[[str, list[bytes]], list[bytes]] | None) -> DataFrame:
    text_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("_name"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_runs(rewrite, ["doc_id", "runs", last]), f"doc_id {kind(docs, 'doc_id')}, runs {RUNS}, {last} string")


def periodic_runs(docs: DataFrame, rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of docs(doc_id, text): all runs by start and period, and the words joined by blanks without what repeats.

    Of each run the first period stays. rewrite changes the words of a document, given its id as text, before they are looked at.
    """
    return _found(docs, "collapsed", rewrite)


def run_digests(docs: DataFrame, rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) as start, length, period and exponent_milli, and digests of all runs and of the collapsed words."""
    found = _found(docs, "collapsed_sha256", rewrite)
    top = F.array_min(F.transform("runs", lambda r: F.struct(F.negative(r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    own = found.withColumn("top", top)
    length = F.negative("top.less")
    return own.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        length.alias("length"),
        F.col("top.period").alias("period"),
        F.expr("1000 * -top.less div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )
