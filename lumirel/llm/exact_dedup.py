"""Exact deduplication with counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints, split
into blocks by the leading bits of the quotient. Filters of the same block merge losslessly:
their runs are already sorted by (quotient, remainder), so merging is a merge of sorted
remainders that adds the counts. Fingerprints whose merged count is above one route their
rows to byte verification, where texts group by their full bytes.

Defined cases: a null text counts as empty; empty texts are equal to each other; rows with a
null doc_id take part in groups but never name one unless all ids are null (keep_id is then
null, and such rows are kept); repeated rows count separately and share a keep_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, route_filter, route_mark, text_batches

#: Fingerprints that a block of a merged filter is planned to hold.
BLOCK_FINGERPRINTS = 1 << 15
REMAINDER_BITS = 40


class QuotientFilter:
    """Counting quotient filter of 64-bit fingerprints that share their leading block bits.

    A fingerprint's leading 64 - REMAINDER_BITS bits are its quotient. Occupied quotients are
    stored once, each with the length of its run; a run holds sorted remainders with counts.
    """

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    @classmethod
    def of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        q, runs = np.unique(fingerprints >> np.uint64(REMAINDER_BITS), return_counts=True)
        return cls(q.astype(np.uint32), runs.astype(np.uint32), fingerprints & np.uint64((1 << REMAINDER_BITS) - 1), counts)

    @classmethod
    def build(cls, fingerprints: np.ndarray) -> QuotientFilter:
        return cls.of_sorted(*[x.astype(np.uint64) for x in np.unique(fingerprints, return_counts=True)])

    def fingerprints(self) -> np.ndarray:
        return np.repeat(self.quotients.astype(np.uint64) << np.uint64(REMAINDER_BITS), self.runs) | self.remainders

    def to_bytes(self) -> bytes:
        """Quotients, run lengths, remainders of 5 bytes; counts of one byte, those of 255 and more in a tail."""
        small = np.minimum(self.counts, 255).astype(np.uint8)
        big = self.counts[small == 255]
        rem = self.remainders.view(np.uint8).reshape(-1, 8)[:, : REMAINDER_BITS // 8]
        head = np.array([len(self.quotients), len(self.remainders)], np.uint32)
        return b"".join(x.tobytes() for x in (head, self.quotients, self.runs, rem, small, big))

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        nq, n = (int(x) for x in np.frombuffer(data, np.uint32, 2))
        at = 8
        q = np.frombuffer(data, np.uint32, nq, at)
        runs = np.frombuffer(data, np.uint32, nq, at + 4 * nq)
        at += 8 * nq
        width = REMAINDER_BITS // 8
        rem = np.zeros((n, 8), np.uint8)
        rem[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.uint64)
        counts[counts == 255] = np.frombuffer(data, np.uint64, -1, at + n)
        return cls(q, runs, rem.view(np.uint64).reshape(-1), counts)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """Lossless: both are sorted, so a stable merge puts equal fingerprints side by side and their counts add up."""
        both = np.concatenate([self.fingerprints(), other.fingerprints()])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.counts, other.counts])[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
        return QuotientFilter.of_sorted(both[first], np.add.reduceat(counts, first) if len(first) else counts)


def _filters(block_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        fp = np.unique(np.concatenate(held).view(np.uint64), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
        block = (fp[0] >> np.uint64(64 - block_bits)).astype(np.int64)
        ids, first = np.unique(block, return_index=True)
        ends = np.r_[first[1:], len(block)].astype(int)[: len(ids)]
        out = [QuotientFilter.of_sorted(fp[0][a:b], fp[1][a:b].astype(np.uint64)).to_bytes() for a, b in zip(first, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["block", "cqf"])

    return build


def _merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a block's filters two by two, as a counter in base two does, and emits what occurs more than once."""
    levels: list[QuotientFilter | None] = []
    for batch in batches:
        for data in batch.column("cqf"):
            one = QuotientFilter.from_bytes(data.as_py())
            for i in range(len(levels) + 1):
                if i == len(levels):
                    levels.append(None)
                if levels[i] is None:
                    levels[i] = one
                    break
                one, levels[i] = levels[i].merge(one), None
    whole = None
    for level in levels:
        whole = level if whole is None else whole if level is None else whole.merge(level)
    fp, n = (whole.fingerprints(), whole.counts) if whole else (np.zeros(0, np.uint64),) * 2
    many = n > 1
    yield pa.RecordBatch.from_arrays([pa.array(fp[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["fp", "n"])


def repeated_fingerprints(fps: DataFrame, rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once in fps(fp)."""
    blocks = max(1, rows // BLOCK_FINGERPRINTS)
    block_bits = max(4, min(20, (blocks - 1).bit_length()))
    filters = fps.select("fp").mapInArrow(_filters(block_bits), "block long, cqf binary")
    return filters.groupBy("block").applyInArrow(_merged, "fp long, n long")


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    text_batches(docs.sparkSession)
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    prints = cut(norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    many = repeated_fingerprints(prints, prints.count())
    routed = route_filter(norm.withColumn("fp", F.xxhash64("norm")), F.col("fp"), many, F.col("fp"))
    verified = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = verified.filter("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return prints.join(groups, "sha", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact deduplication keeps, with all their columns, whatever their names; of repeated rows one.

    Only rows that may go are shuffled with their texts; all others pass by.
    """
    verdict = cut(exact_dedup(docs.select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "kept"))
    dropped = verdict.filter("not kept").select("id", "sha").distinct()
    again = verdict.filter("kept").groupBy("id", "sha").count().filter("count > 1").select("id", "sha")
    marked = route_mark(docs, F.col("doc_id"), dropped.union(again), F.col("id"))
    routed = marked.filter("routed").select("row", F.col("row.doc_id").alias("own"), F.sha2(normalised(F.col("row.text")), 256).alias("own_sha")).dropDuplicates(["own", "own_sha"])
    stay = routed.join(dropped, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_sha") == F.col("sha")), "left_anti")
    return marked.filter("not routed").select("row.*").unionByName(stay.select("row.*"))
