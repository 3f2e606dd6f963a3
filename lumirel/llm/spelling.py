"""Grouping of spelling variants by finite-state composition.

The vocabulary is taken from all texts. A pair of words that are one edit apart agrees before its
first difference and behind its edit, so words meet by segments: a segment (size, a, b) holds words of
size and size + 1 code points that share their first a code points and their last size - b. The shared
ends lead from the initial state of the vocabulary's acceptor to the state at which the segment's part of it
begins. In each segment the middles are two minimised acyclic acceptors, one for each length, which share their
states; their compositions short * edit * short (replacement) and short * edit * long (insertion)
are walked, and the pairs that they accept are counted. Nothing is emitted for a pair:
a word gets its number of near words and the commonest of them.

Halves of a word are its first segments. A segment of too many words is halved again; pairs whose first
difference is in the left half share what is right of it, the others what is left of it, so every pair has
one segment only. A segment of one code point holds at most 90 + 90^2 words of the alphabet
of 90 letters, so halving ends with segments of a bounded size.

Defined cases: a null or empty text has no words; repeated rows count again; a null doc_id stands as an
empty name where letters are dropped; words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, remove, text_batches, tidy

LETTERS = "A-Za-zÀ-ÿ"
LEAST_POINTS = 6
LEAST_COUNT = 5
#: A word's form is at least so many times as common.
TIMES = 5
#: Words that a task counts before it passes them on.
HELD_WORDS = 1 << 17
#: Words of a segment that one task composes at once.
SEGMENT_WORDS = 1 << 15


def _counts(drop_every: int, least_points: int):
    run = re.compile(f"[{LETTERS}]{{{least_points},}}")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc"), batch.column("text"), strict=True):
                # bytes.lower() touches A-Z only.
                found = run.findall((text.as_py() or "").encode().lower().decode())
                if not drop_every:
                    held.update(found)
                else:
                    start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return count


def vocabulary(docs: DataFrame, drop_every: int = 0, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters of least_points code points and least_count occurrences in all of docs(doc_id, text).

    With drop_every, a run loses one letter in documents where that number divides the crc32 of
    `doc_id:run`: misspellings at known places.
    """
    text_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(_counts(drop_every, least_points), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= least_points) & (F.col("n") >= least_count))


class Acceptors:
    """Minimal acyclic acceptors that share their states: one state for each right language.

    A state is a dict from a symbol to (next state, number of words by smaller symbols); the
    numbers add up to a word's place in sorted order. State 0 accepts, and has no way on.
    """

    def __init__(self):
        self.ways: list[dict[str, tuple[int, int]]] = [{}]
        self.counts = [1]
        self.known: dict[tuple, int] = {}

    def _settle(self, ways: list[tuple[str, int]]) -> int:
        key = tuple(ways)
        if key not in self.known:
            self.known[key] = len(self.ways)
            own, below = {}, 0
            for symbol, state in ways:
                own[symbol] = (state, below)
                below += self.counts[state]
            self.ways.append(own)
            self.counts.append(below)
        return self.known[key]

    def build(self, words: list[str]) -> int | None:
        """The initial state of the acceptor of sorted different words of one length; None if there are none."""
        if not words:
            return None
        open_ways: list[list[tuple[str, int]]] = [[] for _ in words[0]]
        last = words[0]
        for word in [*words[1:], None]:
            same = 0
            if word is not None:
                while word[same] == last[same]:
                    same += 1
            state = 0
            for depth in range(len(last) - 1, same, -1):
                open_ways[depth].append((last[depth], state))
                state = self._settle(open_ways[depth])
                open_ways[depth] = []
            if last:
                open_ways[same].append((last[same], state))
            last = word
        return self._settle(open_ways[0]) if open_ways else 0

    def _both(self, r: int, t: int, i: int, j: int) -> Iterator[tuple[int, int]]:
        """Places of the words that go on alike from both states."""
        stack = [(r, t, i, j)]
        while stack:
            r, t, i, j = stack.pop()
            if r == t:
                yield from ((i + k, j + k) for k in range(self.counts[r]))
                continue
            ways, others = self.ways[r], self.ways[t]
            for symbol in ways if len(ways) <= len(others) else others:
                if symbol in ways and symbol in others:
                    (r2, a), (t2, b) = ways[symbol], others[symbol]
                    stack.append((r2, t2, i + a, j + b))

    def replaced(self, short: int | None) -> Iterator[tuple[int, int]]:
        """Places of the pairs of the acceptor's words that differ by one replacement, each once."""
        stack = [(short, 0)] if short is not None else []
        while stack:
            state, at = stack.pop()
            ways = list(self.ways[state].values())
            for k, (r, a) in enumerate(ways):
                stack.append((r, at + a))
                for t, b in ways[k + 1 :]:
                    yield from self._both(r, t, at + a, at + b)

    def inserted(self, short: int | None, long: int | None, at_end: bool) -> Iterator[tuple[int, int]]:
        """Places (in the short words, in the long ones) of pairs of which the long one has one more symbol, told by its first place.

        at_end says whether that may be behind the last symbol.
        """
        stack = [(short, long, 0, 0)] if short is not None and long is not None else []
        while stack:
            p, q, i, j = stack.pop()
            own, others = self.ways[p], self.ways[q]
            for symbol, (r, b) in others.items():
                if symbol in own:
                    stack.append((own[symbol][0], r, i + own[symbol][1], j + b))
                if p == 0:
                    if at_end:
                        yield i, j + b
                    continue
                ahead = self.ways[r]
                for s, (p2, a) in own.items():
                    if s != symbol and s in ahead:
                        yield from self._both(p2, ahead[s][0], i + a, j + b + ahead[s][1])


def _compose(rows: list[tuple[str, int]], size: int, a: int, b: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words in this segment, the largest n among them, its word) for the words that have any."""
    fsa = Acceptors()
    sides = []
    for length in (size, size + 1):
        own = sorted((w[a : length - (size - b)], w, n) for w, n in rows if len(w) == length)
        sides.append((fsa.build([m for m, _, _ in own]), [(w, n) for _, w, n in own]))
    (short, words), (long, longer) = sides
    near: dict[str, list] = {}

    def note(one: tuple[str, int], other: tuple[str, int]) -> None:
        best = near.setdefault(one[0], [0, (0, "")])
        best[0] += 1
        best[1] = min(best[1], (-other[1], other[0]))

    for i, j in fsa.replaced(short):
        note(words[i], words[j])
        note(words[j], words[i])
    for i, j in fsa.inserted(short, long, b == size):
        note(words[i], longer[j])
        note(longer[j], words[i])
    for word, (count, (n, form)) in near.items():
        yield word, count, -n, form


@tidy
def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes each segment of rows that are sorted by it."""
    names = ("size", "a", "b", "head", "tail")
    key, rows, out = None, [], []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "near", "n", "form"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*names, "word", "count")]
        for *own, word, n in zip(*columns, strict=True):
            if own != key:
                if len(rows) > 1:
                    out += _compose(rows, *key[:3])
                key, rows = own, []
            rows.append((word, n))
        if len(out) > 10_000:
            yield packed()
            out = []
    if len(rows) > 1:
        out += _compose(rows, *key[:3])
    yield packed()


def _halves(df: DataFrame) -> DataFrame:
    """Rows (word, count, size, a, b) in both halves of their segment, with the ends that its words share."""
    middle = F.expr("(a + b) div 2")
    both = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    out = df.select("word", "count", "size", F.explode(both).alias("h")).select("word", "count", "size", F.col("h.a").cast("int").alias("a"), F.col("h.b").cast("int").alias("b")).filter("a < b")
    rest = F.col("size") - F.col("b")
    tail: Column = F.when(rest == 0, F.lit("")).otherwise(F.substring("word", F.length("word") - rest + 1, rest))
    return out.withColumn("head", F.substring("word", F.lit(1), F.col("a"))).withColumn("tail", tail)


SEGMENT = ["size", "a", "b", "head", "tail"]


def near_words(words: DataFrame, scratch: list[str], least_points: int = LEAST_POINTS, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(word, n_near, form_n, nearest) for those of words(word, n) that have near words: how many, and the most frequent of them (of equals, the smallest)."""
    sizes = F.array(F.length("word"), F.length("word") - 1)
    whole = words.select("word", F.col("n").alias("count"), F.explode(sizes).alias("size")).filter(F.col("size") >= least_points)
    todo, parts = _halves(whole.withColumn("a", F.lit(0)).withColumn("b", F.col("size"))), []
    while True:
        big = cut(todo.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("words")).filter((F.col("words") > segment_words) & (F.col("b") - F.col("a") > 1)).select(*SEGMENT), scratch)
        if big.isEmpty():
            parts.append(todo)
            break
        # Written once, as it is read for both sides.
        todo = cut(join_hot(todo, big.withColumn("big", F.lit(True)), SEGMENT, "word", "left", 8), scratch)
        parts.append(todo.filter("big is null").drop("big"))
        todo = _halves(todo.filter("big").select("word", "count", "size", "a", "b"))
    segments = parts[0]
    for p in parts[1:]:
        segments = segments.unionByName(p)
    dealt = segments.repartition(*SEGMENT).sortWithinPartitions(*SEGMENT)
    found = dealt.mapInArrow(_near, "word string, near long, n long, form string")
    best = F.min(F.struct(F.negative("n").alias("less"), "form")).alias("m")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.negative("m.less").alias("form_n"), F.col("m.form").alias("nearest"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last of the forms that follow each other from a word.

    Each pass doubles how far a word sees; a form is several times as common as its word, so ways are short.
    """
    spark = forms.sparkSession
    seen = forms.select("word", F.col("form").alias("root"))
    before: list[str] = []
    while True:
        now: list[str] = []
        ahead = seen.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(join_hot(seen, ahead, ["root"], "word", "left", 8), now)
        done = step.filter("next is not null").isEmpty()
        seen = step.select("word", F.coalesce("next", "root").alias("root"))
        remove(spark, before)
        before = now
        if done:
            return seen


def spelling_variants(docs: DataFrame, drop_every: int = 0, times: int = TIMES, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per word of the vocabulary of docs(doc_id, text): word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest), if it is at least times as common, else null; root is
    where the forms lead to.
    """
    spark = docs.sparkSession
    scratch: list[str] = []
    words = cut(vocabulary(docs, drop_every))
    near = cut(near_words(words, scratch, segment_words=segment_words))
    remove(spark, scratch)
    own = words.join(near, "word", "left")
    formed = F.col("form_n") >= times * F.col("n")
    own = own.select("word", F.when(formed, F.col("nearest")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("form_n")).alias("form_n"))
    own = cut(own)
    led = roots(own.filter("form is not null"))
    return own.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
