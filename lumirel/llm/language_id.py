"""Language identification of words and documents with a linear-chain conditional random field.

Every word has emission scores per language, from hashed affixes, n-grams and the word itself (the
lexicon), and learned transitions join the labels of neighbouring words. Forward-backward
gives each word's marginal distribution, so a text may switch languages; a document's language is
that of the largest share of its letters, weighed by marginals.

Training draws whole documents, a bounded number for each language, cuts them into stretches and
strings stretches of different languages together, so that switches occur. Emissions and
transitions are fitted together by gradient steps on the conditional likelihood.

Prediction covers whole texts. Distinct words are scored once per batch; forward-backward is exact
and runs over all chunks of all texts at once: the chunks' products of transition matrices, a pass
over each text's chunks, then a pass within chunks.

Defined cases: `und` with score 0 for a null text or one without letters, and for every text if no
language was learned; a single learned language is predicted with score 1; languages are ordered by
name and ties go to the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kind, span_hashes, text_batches

#: Documents that each language trains on at most, and the characters that are read of one.
TRAIN_DOCS = 160
TRAIN_CHARS = 20_000
#: Languages that may have so many documents; if there are more, each has fewer, and one at least.
LANGUAGES = 200
FEATURES = 1 << 16
NGRAM = (2, 3, 4, 5)
STRETCH = 12
EPOCHS = 4
CHUNK = 64
WORDS_AT_ONCE = 1 << 18
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, one after the other, and how many each has.

    They are the word itself (the lexicon) and its runs of NGRAM bytes with both ends marked, of
    which those with a mark are its affixes.
    """
    parts = [("^" + w.casefold() + "$").encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    keys, owners = [span_hashes(data, starts, ends)], [np.arange(len(words))]
    for n in NGRAM:
        left = np.repeat(ends, sizes) - np.arange(ends[-1])
        at = np.flatnonzero(left >= n)
        keys.append(span_hashes(data, at, at + n))
        owners.append(np.repeat(np.arange(len(words)), sizes)[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(keys)[order] % np.uint64(FEATURES)).astype(np.int64), np.bincount(owner, minlength=len(words))


@dataclass
class Crf:
    languages: list[str]
    emissions: np.ndarray
    transitions: np.ndarray
    start: np.ndarray


def _words(text: str | None) -> list[str]:
    return (text or "").split()


def _forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and expected transitions, of sequences of equal length: emit[sequence, place, label] in logarithms."""
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(trans)
    n, length, k = e.shape
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    a = e[:, 0] * np.exp(start)
    fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = (fwd[:, i - 1] @ t) * e[:, i]
        fwd[:, i] = a / a.sum(axis=1, keepdims=True)
    b = np.ones((n, k))
    bwd[:, -1] = b
    for i in range(length - 2, -1, -1):
        b = (bwd[:, i + 1] * e[:, i + 1]) @ t.T
        bwd[:, i] = b / b.sum(axis=1, keepdims=True)
    post = fwd * bwd
    post /= post.sum(axis=2, keepdims=True)
    pair = fwd[:, :-1, :, None] * t * (bwd[:, 1:] * e[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return post, pair.sum(axis=(0, 1))


def fit(samples: list[tuple[str, str]], seed: int = 1) -> Crf:
    """A field from (language, text) samples."""
    languages = sorted({lang for lang, text in samples if _words(text)})
    k = len(languages)
    crf = Crf(languages, np.zeros((FEATURES, k), np.float32), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return crf
    rng = np.random.default_rng(seed)
    stretches, labels = [], []
    for lang, text in samples:
        words = _words(text)
        for i in range(0, len(words), STRETCH):
            part = words[i : i + STRETCH]
            stretches.append(part)
            labels.append(languages.index(lang))
    # All stretches in random order, end to end: most neighbours are of different languages or documents.
    seen: dict[str, int] = {}
    per_epoch = 64 * 48
    for epoch in range(EPOCHS):
        order = rng.permutation(len(stretches))
        flat, gold = [], []
        for s in order:
            for w in stretches[s]:
                flat.append(seen.setdefault(w, len(seen)))
                gold.append(labels[s])
        if epoch == 0:
            features, sizes = word_features(list(seen))
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            g2 = np.full((FEATURES, k), 1e-6, np.float32)
        flat, gold = np.array(flat), np.array(gold)
        length = 48
        for i in range(0, len(flat) - length + 1, per_epoch):
            ids, y = flat[i : i + per_epoch], gold[i : i + per_epoch]
            m = len(ids) // length
            if not m:
                break
            ids, y = ids[: m * length], y[: m * length]
            own, back = np.unique(ids, return_inverse=True)
            rows = np.concatenate([np.arange(first[w], first[w] + sizes[w]) for w in own])
            local = np.searchsorted(own, owner[rows])
            score = np.zeros((len(own), k))
            for c in range(k):
                score[:, c] = np.bincount(local, crf.emissions[features[rows], c], len(own))
            score /= np.sqrt(sizes[own])[:, None]
            post, pairs = _forward_backward(score[back].reshape(m, length, k), crf.transitions, crf.start)
            truth = np.eye(k)[y].reshape(m, length, k)
            grad = np.zeros((len(own), k))
            np.add.at(grad, back, (truth - post).reshape(-1, k))
            grad /= np.sqrt(sizes[own])[:, None]
            for c in range(k):
                g = np.bincount(features[rows], grad[local, c], FEATURES)
                g2[:, c] += g * g
                crf.emissions[:, c] += 0.3 * g / np.sqrt(g2[:, c])
            joint = np.zeros((k, k))
            np.add.at(joint, (y.reshape(m, length)[:, :-1].ravel(), y.reshape(m, length)[:, 1:].ravel()), 1)
            crf.transitions += 0.5 * (joint - pairs) / (m * length)
            crf.start += 0.5 * (truth[:, 0] - post[:, 0]).sum(axis=0) / m
    return crf


class Tagger:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.known: dict[str, int] = {}
        self.scores: list[np.ndarray] = []
        self.letters: list[int] = []

    def _ids(self, words: list[str]) -> np.ndarray:
        """Places of words in the table of scored words; new words are added to it."""
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
            self.scores, self.letters = [], []
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            feats, sizes = word_features(new)
            flat = self.crf.emissions[feats]
            first = np.cumsum(sizes) - sizes
            self.scores.append((np.add.reduceat(flat, first, axis=0) / np.sqrt(sizes)[:, None]).astype(np.float32))
            self.letters += [sum(map(str.isalpha, w)) for w in new]
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all words of all texts in order: marginals and letters; and the number of words of each text."""
        crf, words, counts = self.crf, [], []
        for t in texts:
            own = _words(t)
            counts.append(len(own))
            words += own
        counts = np.array(counts, np.int64)
        k = len(crf.languages)
        if not words:
            return np.zeros((0, k)), np.zeros(0, np.int64), counts
        ids = self._ids(words)
        if len(self.scores) > 1:
            self.scores = [np.concatenate(self.scores)]
        emit = np.exp(np.clip((x := self.scores[0][ids]) - x.max(axis=1, keepdims=True), -60, 0)).astype(np.float64)
        return self._exact(emit, counts), np.array(self.letters)[ids], counts

    def _exact(self, emit: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Marginals by forward-backward, over chunks of CHUNK words of all texts at once."""
        trans = np.exp(self.crf.transitions)
        k = emit.shape[1]
        chunks = -(-counts // CHUNK)
        n_chunks = int(chunks.sum())
        text_of = np.repeat(np.arange(len(counts)), chunks)
        nth = np.arange(n_chunks) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begin = np.repeat(np.cumsum(counts) - counts, chunks) + nth * CHUNK
        size = np.minimum(CHUNK, counts[text_of] - nth * CHUNK)
        # Chunks in a grid; places after a chunk's end act as the identity.
        at = begin[:, None] + np.arange(CHUNK)
        live = np.arange(CHUNK) < size[:, None]
        e = emit[np.minimum(at, len(emit) - 1)]
        first = nth == 0
        # Products of the steps of each chunk: from the label before it to the label at its end.
        whole = np.broadcast_to(np.eye(k), (n_chunks, k, k)).copy()
        for i in range(CHUNK):
            step = (whole @ trans) if i else np.where(first[:, None, None], whole, whole @ trans)
            step = step * e[:, i][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            whole = np.where(live[:, i][:, None, None], step, whole)
        before, after = np.empty((n_chunks, k)), np.ones((n_chunks, k))
        starts = np.flatnonzero(first)
        before[starts] = np.exp(self.crf.start)
        for j in range(1, int(nth.max()) + 1):
            now = np.flatnonzero(nth == j)
            b = np.einsum("ni,nij->nj", before[now - 1], whole[now - 1])
            before[now] = b / b.sum(axis=1, keepdims=True)
        last = chunks[text_of] - 1 - nth
        for j in range(1, int(last.max()) + 1):
            now = np.flatnonzero(last == j)
            b = np.einsum("nij,nj->ni", whole[now + 1], after[now + 1])
            after[now] = b / b.sum(axis=1, keepdims=True)
        fwd = np.empty((n_chunks, CHUNK, k))
        a = before
        for i in range(CHUNK):
            step = a @ trans if i else np.where(first[:, None], a, a @ trans)
            a = step * e[:, i]
            a = a / a.sum(axis=1, keepdims=True)
            fwd[:, i] = a
        b = after
        out = np.empty((n_chunks, CHUNK, k))
        for i in range(CHUNK - 1, -1, -1):
            out[:, i] = fwd[:, i] * b
            step = (b * e[:, i]) @ trans.T
            step /= step.sum(axis=1, keepdims=True)
            b = np.where(live[:, i][:, None], step, b)
        out = out[live]
        return out / out.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.crf.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        start, held = 0, 0
        sizes = [len(t or "") // 4 + 1 for t in texts]
        ranges = []
        for i, s in enumerate(sizes):
            if i > start and held + s > WORDS_AT_ONCE:
                ranges.append((start, i))
                start, held = i, 0
            held += s
        ranges.append((start, len(texts)))
        for lo, hi in ranges:
            post, letters, counts = self.marginals(texts[lo:hi])
            share = np.vstack([np.zeros((1, post.shape[1])), np.cumsum(post * letters[:, None], axis=0)])
            total = np.r_[0, np.cumsum(letters)]
            at = np.r_[0, np.cumsum(counts)]
            weight = share[at[1:]] - share[at[:-1]]
            n = total[at[1:]] - total[at[:-1]]
            for w, m in zip(weight, n, strict=True):
                if not m:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(np.argmax(w))
                    langs.append(self.crf.languages[best])
                    scores.append(float(min(1.0, w[best] / m)))
        return langs, scores


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo FOLDS; of a null doc_id, that of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


def train(docs: DataFrame) -> Crf:
    """A field from docs(doc_id, text, lang), of rows with text, lang and doc_id: of all languages that these have.

    A language's documents are its first by a hash of the id. Those of more than TRAIN_CHARS
    characters come last, and teach with their first stretch of that length.
    """
    rows = docs.select("doc_id", "text", "lang").filter(f"doc_id is not null and text is not null and lang is not null and lang <> '{UNKNOWN}'")
    each = max(1, min(TRAIN_DOCS, LANGUAGES * TRAIN_DOCS // max(1, rows.select(F.countDistinct("lang")).first()[0])))
    keyed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_long", F.length("text") > TRAIN_CHARS)
    # A bounded top of each language, which Spark keeps per task before it merges.
    own = Window.partitionBy("lang").orderBy("_long", F.xxhash64("doc_id"), "doc_id", "_h")
    picked = keyed.select("doc_id", "lang", "_h", "_long").withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= each).select("doc_id", "lang", "_h").distinct()
    drawn = keyed.join(F.broadcast(picked), ["doc_id", "lang", "_h"]).select("doc_id", "lang", "_h", F.substring("text", 1, TRAIN_CHARS).alias("text"))
    found = drawn.dropDuplicates(["doc_id", "lang", "_h"]).orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()
    return fit([(r.lang, r.text) for r in found])


def identify(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text)."""
    text_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            langs, scores = tagger.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows held out (crc32 modulo FOLDS is HELD_OUT) teach nothing."""
    crf = train(docs.filter(remainder(F.col("doc_id")) != HELD_OUT))
    return identify(docs, crf).select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "lang_pred", "score")
