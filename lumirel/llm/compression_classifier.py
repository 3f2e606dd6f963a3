"""Quality classifier by compression.

Two zstandard dictionaries are built, one from text labelled good and one from text labelled
bad. A text is compressed with each, in segments, so that what repeats within a text counts as
often as it comes; the difference of the two sizes over the text's length is
positive where the good dictionary serves it better, and near zero where neither says much.
Labelled rows that built no dictionary calibrate that difference to a score: by isotonic
regression, apart for texts shorter than SHORT_BYTES, whose differences are few bytes. A share of TREND
of the score is that of a logistic fit, which keeps the order within a step.

Model fitting uses a bounded sample of labelled rows (SAMPLE_ROWS per dictionary and
CALIBRATION_ROWS, of at most SAMPLE_CHARS characters each); scoring covers whole texts of all rows.

Defined cases: null and empty texts get the score of an empty text; without labels of both
kinds every score is the share of good labels, or 0.5; so is that of a length class without any label; labels that are null, or of unknown
documents, teach nothing; where a document's labels differ, each counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import text_batches, tidy

SAMPLE_ROWS = 1200
CALIBRATION_ROWS = 2400
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
SEGMENT_BYTES = 1024
SHORT_BYTES = 48
TREND = 0.02
LEVEL = 3
CUT = 0.3
FOLDS = 5


@dataclass
class Calibration:
    """From differences to scores: steps of isotonic regression at knots, and a logistic fit."""

    knots: list[float]
    steps: list[float]
    slope: float
    offset: float

    def score(self, x: np.ndarray) -> np.ndarray:
        steps = np.interp(x, self.knots, self.steps) if self.knots else _logistic(np.full(len(x), self.offset))
        return (1 - TREND) * steps + TREND * _logistic(self.slope * x + self.offset)


@dataclass
class Model:
    good: bytes
    bad: bytes
    short: Calibration
    long: Calibration

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.model = model
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=_loaded(d), **plain) if d else zstandard.ZstdCompressor(**plain) for d in (model.good, model.bad))

    def differences(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Differences of compressed sizes over lengths, and lengths in bytes."""
        x, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            sizes[k] = len(data)
            parts = [data[i : i + SEGMENT_BYTES] for i in range(0, len(data), SEGMENT_BYTES)]
            x[k] = sum(len(self.bad.compress(p)) - len(self.good.compress(p)) for p in parts) / (len(data) + 1)
        return x, sizes

    def score(self, texts: list[str | None]) -> np.ndarray:
        x, sizes = self.differences(texts)
        return np.where(sizes < SHORT_BYTES, self.model.short.score(x), self.model.long.score(x))


def _loaded(data: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return d


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps that are halved until they improve the fit."""
    x = np.c_[x, np.ones(len(x))]
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + penalty @ (w * w) / 2)

    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


def _calibrated(x: np.ndarray, y: np.ndarray, share: float) -> Calibration:
    """Neighbours that break the order are pooled; a step counts half a good label of one more row."""
    if not len(y):
        return Calibration([], [], 0.0, float(np.log(share / (1 - share))))
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, n, _, end = pools.pop()
            pools[-1] = [pools[-1][0] + good, pools[-1][1] + n, pools[-1][2], end]
    knots = [k for _, _, first, last in pools for k in (first, last)]
    steps = np.maximum.accumulate([(good + 0.5) / (n + 1) for good, n, _, _ in pools for _ in range(2)]).tolist()
    mean, spread = float(x.mean()), float(x.std()) + 1e-9
    slope, offset = _regression(((x - mean) / spread)[:, None], y)
    return Calibration(knots, steps, float(slope / spread), float(offset - slope * mean / spread))


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    total = sum(map(len, samples))
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        # Too few samples to choose from: their text itself serves.
        return b"".join(samples)[-DICTIONARY_BYTES:]


def remainder(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of doc_id as text, modulo folds; of a null doc_id, that of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def train(docs: DataFrame, labels: DataFrame, teaches: Column | None = None) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, quality); teaches, over doc_id, says which rows it may learn from."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").distinct()
    if teaches is not None:
        own = own.filter(teaches)
    own = own.withColumn("order", F.xxhash64("doc_id")).withColumn("builds", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0)
    parts = [own.filter(f"builds and quality = {q}").orderBy("order", "doc_id").limit(SAMPLE_ROWS) for q in (0, 1)]
    parts.append(own.filter("not builds").orderBy("order", "doc_id").limit(CALIBRATION_ROWS))
    chosen = parts[0].union(parts[1]).union(parts[2])
    # At most 2 * SAMPLE_ROWS + CALIBRATION_ROWS ids, so they may be broadcast, and their texts collected; of a long text its start.
    texts = docs.select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.orderBy("order", "doc_id", "quality").limit(2 * (2 * SAMPLE_ROWS + CALIBRATION_ROWS)).collect()
    good, bad = (_dictionary([r.text for r in rows if r.builds and r.quality == q]) for q in (1, 0))
    held = [r for r in rows if not r.builds]
    y = np.array([r.quality for r in held], float)
    every = [r.quality for r in rows]
    share = min(1 - 1e-9, max(1e-9, sum(every) / len(every))) if every else 0.5
    none = np.zeros(0)
    if not len(y) or y.min() == y.max() or not good or not bad:
        return Model(b"", b"", _calibrated(none, none, share), _calibrated(none, none, share))
    x, sizes = Scorer(Model(good, bad, None, None)).differences([r.text for r in held])
    short = sizes < SHORT_BYTES
    return Model(good, bad, _calibrated(x[short], y[short], share), _calibrated(x[~short], y[~short], share))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1, higher: likelier good) and predicted (1 from CUT on) after its own columns, which can't have these names."""
    names = docs.columns
    taken = {"score", "predicted"} & set(names)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are the classifier's own")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            score = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    text_batches(docs.sparkSession)
    own = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *own]))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs(text) that the model predicts to be good, with all their columns, whatever their names."""
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return classify(packed, model).filter("predicted = 1").select("row.*")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of docs(doc_id, text); rows held out (crc32 modulo FOLDS is 0) teach nothing."""
    model = train(docs, labels, remainder(F.col("doc_id")) != 0)
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
