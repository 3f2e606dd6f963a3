"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

Two suffixes tie, for this purpose, when their first WINDOW symbols agree. Sorting all suffixes
to that depth is what the difference cover avoids: a cover D of the residues modulo V has, for
any two positions i and j, a shift below V that moves both onto sampled positions. So

1. the cover sample (about 9 % of the suffixes) is sorted to depth WINDOW - V + 1, one bucket
   at a time, and gets ranks: a suffix is alone, or tied with others;
2. a suffix can be in a tie of WINDOW symbols only if, within its first V positions, there is a
   sampled one of a tied rank; all others are settled without being sorted;
3. the suffixes left come in runs, which are cut where their content says so. Equal pieces of
   runs are settled together: all their suffixes repeat;
4. the suffixes of the other pieces, and of one copy of each equal piece, are sorted one bucket
   at a time, and ties repeat;
5. the keys of pieces and suffixes are of 96 bits, from two points: ties are of both.

Sorting is by fingerprints of the symbols to the depth in question, so a bucket is a range of
fingerprints and not of the alphabet: the order among different strings plays no part in the
result, and buckets are even for any text. Fingerprints are polynomials modulo the prime
2**61 - 1 at points drawn for each run, so no text can be made to collide. Of n suffixes about n**2 / 2**94 are in a false tie,
which is 5e-11 of 1e9 and 5e-3 of 1e13. No bytes are compared, as strings of 400 bytes for each
tied suffix would be many times the input; sampled suffixes, which only say where to look, have keys of 64 bits.

The same steps, on words instead of bytes, find passages of PASSAGE_WORDS words that another
document has too; these are counted, and no byte is removed for them.

Texts are packed into units which stay where they are (a table bucketed by slot in the
shared folder, of one slot for each partition up to Spark's limit of buckets); only keys move, in sorted arrays per bucket.

Defined cases: a null text is empty; texts shorter than WINDOW bytes lose nothing; each row is
a document of its own, repeated rows and null doc_ids included; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import re
import secrets
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, kind, mix64, remove, span_hashes, text_batches, word_spans

WINDOW = 400
#: Words of a passage that counts as repeated, from one document to another.
PASSAGE_WORDS = 51
#: Bytes of text that are handled at once, few enough for a processor's cache; a longer text alone.
CHUNK_BYTES = 1 << 17
#: Runs of candidates are cut after one position in so many, chosen by content.
PIECE = 64
#: Keys that a bucket is planned to hold.
BUCKET_KEYS = 1 << 19
#: Bytes of a file that one unit holds at most, as far as the files can be split.
UNIT_BYTES = 32 << 20
#: Bytes of text after which a partition starts another unit, as a row group that isn't split may hold many.
UNIT_TEXT = 128 << 20
#: Units of one slot are numbered by so many bits.
SLOT_BITS = 32
#: What a unit is told about its keys; for words, WORDS more.
TIED_SAMPLE, EQUAL_PIECE, OWN_PIECE, TIED_WINDOW = range(4)
WORDS = 4
KEYS = "bucket int, kind int, unit long, keys binary"
REPLY = "unit long, kind int, keys binary"
KEYS_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("unit", pa.int64()), ("keys", pa.binary())])
P = (1 << 61) - 1


def difference_cover(q: int) -> np.ndarray:
    """Singer's perfect difference set modulo q*q+q+1, for a prime q: each difference occurs once."""
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                # Powers of x modulo x**3 = a x**2 + b x + c; those without an x**2 term form the set.
                x, found = (1, 0, 0), []
                for i in range(v):
                    if x[2] == 0:
                        found.append(i)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                if len(found) == q + 1 and len({(i - j) % v for i in found for j in found}) == v:
                    return np.array(found)
    raise ValueError(f"no difference set for {q}")


@dataclass(frozen=True)
class Level:
    """What repeats: runs of window symbols; across: only from one document to another; kinds: the first kind of its replies."""

    window: int
    order: int
    across: bool
    kinds: int

    @property
    def v(self) -> int:
        return self.order * self.order + self.order + 1

    @property
    def depth(self) -> int:
        return self.window - self.v + 1


#: A shorter period samples more, and leaves fewer suffixes to be sorted that share a sample by chance or at the edge of a repeat.
BYTE_LEVEL = Level(WINDOW, 11, False, 0)
WORD_LEVEL = Level(PASSAGE_WORDS, 5, True, WORDS)
LEVELS = (BYTE_LEVEL, WORD_LEVEL)
COVERS = {}
for _level in LEVELS:
    COVERS[_level] = np.zeros(_level.v, bool)
    COVERS[_level][difference_cover(_level.order)] = True


# Arithmetic modulo P on arrays.


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo P, up to a few more than P."""
    return (x & np.uint64(P)) + (x >> np.uint64(61))


def _shifted(x: np.ndarray) -> np.ndarray:
    """x * 2**32 modulo P, of folded x: what is above bit 29 moves to the front."""
    return (x >> np.uint64(29)) + ((x & np.uint64((1 << 29) - 1)) << np.uint64(32))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P of folded values, folded, by halves of 32 and 29 bits."""
    low = np.uint64(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> np.uint64(32), b & low, b >> np.uint64(32)
    # 2**64 is 8 modulo P.
    return _folded(_folded(a0 * b0) + _folded(a1 * b1 << np.uint64(3)) + _shifted(_folded(a0 * b1 + a1 * b0)))


_POWERS: dict[int, np.ndarray] = {}


def powers(point: int, n: int) -> np.ndarray:
    """point**0 .. point**(n - 1) modulo P; a worker holds those of few points, as long as chunks are."""
    have = _POWERS.get(point)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        filled, step = 1, point
        while filled < size:
            have[filled : 2 * filled] = times(have[:filled], np.uint64(step))
            step = step * step % P
            filled *= 2
        if len(_POWERS) > 8:
            _POWERS.clear()
        _POWERS[point] = have
    return have[:n]


class Fingerprints:
    """Fingerprints of any span of a sequence of symbols, at one point."""

    def __init__(self, symbols: np.ndarray, point: int):
        n = len(symbols)
        self.back = powers(pow(point, -1, P), n + 1)
        ahead = powers(point, n + 1)[:n]
        mask = np.uint64(0xFFFFFFFF)
        if symbols.dtype == np.uint8:
            # A byte times a power in halves, each of which adds up exactly.
            b = symbols.astype(np.uint64)
            b += np.uint64(1)
            low, high = b * (ahead & mask), b * (ahead >> np.uint64(32))
        else:
            term = times(_folded(symbols), ahead)
            low, high = term & mask, term >> np.uint64(32)
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Well mixed fingerprints of spans; the same symbols give the same one wherever they are."""
        whole = _folded(_folded(self.low[ends] - self.low[starts]) + _shifted(_folded(self.high[ends] - self.high[starts])))
        # All spans are moved to the front of the sequence, so that their powers are the same.
        print_ = times(whole, self.back[starts])
        print_ = np.where(print_ >= np.uint64(P), print_ - np.uint64(P), print_)
        return mix64(print_ + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _pack(slots) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of about CHUNK_BYTES of text: slot, unit, doc_ids, lengths and the bytes end to end."""
        turn, at = divmod(TaskContext.get().partitionId(), len(slots.value))
        slot, own_units = int(slots.value[at]), 0
        ids, sizes, parts, held, packed = [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal own_units, packed
            own_units, packed = (own_units + 1, held) if packed and packed + held > UNIT_TEXT else (own_units, packed + held)
            own = pa.concat_arrays(ids)
            unit = (slot << SLOT_BITS) + (turn << SLOT_BITS // 2) + own_units
            return pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int64()), pa.array([unit], pa.int64()), pa.ListArray.from_arrays([0, len(own)], own), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["slot", "unit", "doc_ids", "sizes", "data"],
            )

        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                one = text.as_buffer().to_pybytes() if text.is_valid else b""
                if ids and held + len(one) > CHUNK_BYTES:
                    yield row()
                    ids, sizes, parts, held = [], [], [], 0
                ids.append(batch.column("doc_id").slice(i, 1))
                sizes.append(len(one))
                parts.append(one)
                held += len(one)
        if ids:
            yield row()

    return pack


_PLACES: dict[Level, np.ndarray] = {}


def sampled(level: Level, n: int) -> np.ndarray:
    """The places of the cover's residues below n, or some more of them."""
    have = _PLACES.get(level)
    if have is None or have[-1] < n:
        size = 1 << max(17, n.bit_length())
        have = np.flatnonzero(np.resize(COVERS[level], size + level.v))
        _PLACES[level] = have
    return have


class Chunk:
    """Texts end to end, as symbols of a level, with the fingerprints of their spans."""

    def __init__(self, sizes: np.ndarray, symbols: np.ndarray, level: Level, points: tuple[int, int]):
        self.level, self.points, self.sizes, self.symbols = level, points, sizes, symbols
        self.doc_ends = np.cumsum(sizes)
        self.n = len(symbols)
        self.prints = Fingerprints(symbols, points[0])

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sampled positions with depth symbols left in their document, their keys, and their documents."""
        level = self.level
        places = sampled(level, int(self.sizes.max(initial=0)))
        long = np.flatnonzero(self.sizes >= level.window)
        counts = np.searchsorted(places, self.sizes[long] - level.depth, side="right")
        starts = (self.doc_ends - self.sizes)[long]
        at = np.concatenate([start + places[:n] for start, n in zip(starts.tolist(), counts.tolist(), strict=True)] or [np.zeros(0, np.int64)])
        return at, self.prints.of(at, at + level.depth), np.repeat(long, counts)


def symbols_of(level: Level, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of texts in symbols of a level, and the symbols: bytes, or hashes of words."""
    if not level.across:
        return sizes, data
    starts, ends = word_spans_within(data, sizes)
    return np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(sizes)])), span_hashes(data, starts, ends)


def word_spans_within(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie end to end; a text's end ends a word."""
    starts, ends = word_spans(data)
    edges = np.cumsum(sizes)[:-1]
    inner = edges[np.searchsorted(starts, edges, side="left") > np.searchsorted(ends, edges, side="right")]
    if len(inner):
        inner = inner[np.r_[True, np.diff(inner) > 0]]
        starts, ends = (np.insert(x, np.searchsorted(x, inner), inner) for x in (starts, ends))
    return starts, ends


class Runs:
    """The candidate suffixes of a chunk's documents, their keys, and the pieces of their runs.

    Only documents with a tied sample are looked at; at and docs are places in the whole chunk.
    """

    def __init__(self, sizes: np.ndarray, data: np.ndarray, level: Level, points: tuple[int, int], tied: np.ndarray):
        self.level = level
        whole = Chunk(*symbols_of(level, sizes, data), level, points)
        self.n, self.sizes, self.doc_ends = whole.n, whole.sizes, whole.doc_ends
        at, keys, doc = whole.sample()
        hit = _among(keys.astype(np.uint32), tied)
        at, doc = at[hit], doc[hit]
        first, last = (whole.doc_ends - whole.sizes)[doc], whole.doc_ends[doc] - level.window
        low, high = np.maximum(at - level.v + 1, first), np.minimum(at, last)
        ok = low <= high
        doc, low, high = doc[ok], low[ok], high[ok]
        self.at = self.docs = np.zeros(0, np.int64)
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.piece_keys, self.piece_checks, self.piece_sizes, self.piece_docs = self.keys, self.checks, self.at, self.docs
        if not len(low):
            return
        # The documents that matter, end to end, and how far each is moved for that.
        active = np.unique(doc)
        starts, own = (whole.doc_ends - whole.sizes)[active], whole.sizes[active]
        part = Chunk(own, np.concatenate([whole.symbols[a : a + n] for a, n in zip(starts.tolist(), own.tolist(), strict=True)]), level, points)
        moved = np.zeros(len(whole.sizes), np.int64)
        moved[active] = starts - (part.doc_ends - own)
        low, high = low - moved[doc], high - moved[doc]
        edge = np.bincount(low, minlength=part.n + 2) - np.bincount(high + 1, minlength=part.n + 2)
        at = np.flatnonzero(np.cumsum(edge) > 0)
        second = Fingerprints(part.symbols, points[1])
        self.docs = active[np.searchsorted(part.doc_ends, at, side="right")]
        self.at = at + moved[self.docs]
        self.keys = part.prints.of(at, at + level.window)
        self.checks = second.of(at, at + level.window).astype(np.uint32)
        cuts = (self.keys & np.uint64(PIECE - 1)) == 0
        cuts[-1] = True
        cuts[:-1] |= (np.diff(at) > 1) | (np.diff(self.docs) > 0)
        ends = np.flatnonzero(cuts) + 1
        starts = np.r_[0, ends[:-1]]
        self.piece_sizes, self.piece_docs = ends - starts, self.docs[starts]
        # A piece stands for its symbols up to the end of its last suffix.
        span = at[starts], at[ends - 1] + level.window
        self.piece_keys, self.piece_checks = part.prints.of(*span), second.of(*span).astype(np.uint32)

    def of_pieces(self, pieces: np.ndarray) -> np.ndarray:
        """Which suffixes belong to pieces of a mask."""
        return np.repeat(pieces, self.piece_sizes)

    def once(self, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which keys are to be sorted: where documents are to differ, each key once a document."""
        return _once(keys, docs) if self.level.across else np.ones(len(keys), bool)


def _once(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, docs))
    one, of = keys[order], docs[order]
    first = np.zeros(len(keys), bool)
    first[order] = np.r_[True, (one[1:] != one[:-1]) | (of[1:] != of[:-1])] if len(keys) else first
    return first


def _joint(keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    return mix64(keys ^ (checks.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def _among(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    if not len(told):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(told, keys), len(told) - 1)
    return told[at] == keys


def _by_bucket(unit: int, kind: int, keys: np.ndarray, checks: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """Sorted keys, with their checks if they have any, in rows by bucket, their leading bits; what came more than once comes twice."""
    order = np.argsort(keys) if checks is None else np.lexsort((checks, keys))
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    if checks is not None:
        checks = checks[order]
        new[1:] |= checks[1:] != checks[:-1]
    keep = new.copy()
    keep[1:] |= new[:-1]
    keys = keys[keep]
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[first[1:], len(keys)].astype(int)[: len(first)]
    blobs = [keys[a:b].tobytes() for a, b in zip(first, ends, strict=True)]
    if checks is not None:
        checks = checks[keep]
        blobs = [x + checks[a:b].tobytes() for x, a, b in zip(blobs, first, ends, strict=True)]
    rows = len(first)
    return pa.RecordBatch.from_arrays([pa.array(bucket[first], pa.int32()), pa.array([kind] * rows, pa.int32()), pa.array([unit] * rows, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "kind", "unit", "keys"])


def _apart(blob: pa.Buffer, checked: bool) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a row, and their checks or zeros."""
    n = blob.size // (12 if checked else 8)
    checks = np.frombuffer(blob, np.uint32, n, 8 * n) if checked else np.zeros(n, np.uint32)
    return np.frombuffer(blob, np.uint64, n), checks


def _cover_keys(bits: int, points: tuple[int, int]) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, n = None, {k: [] for k in LEVELS}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for level, own in held.items():
                if own:
                    yield _by_bucket(unit, level.kinds + TIED_SAMPLE, np.concatenate(own), None, bits)
                    own.clear()

        for batch in batches:
            for row_unit, sizes, data in zip(batch.column("unit").to_pylist(), batch.column("sizes"), batch.column("data"), strict=True):
                if row_unit != unit or n > 1 << 20:
                    yield from out()
                    n = 0
                unit = row_unit
                for level in LEVELS:
                    chunk = Chunk(*symbols_of(level, sizes.values.to_numpy(), np.frombuffer(data.as_buffer(), np.uint8)), level, points)
                    _, own, docs = chunk.sample()
                    held[level].append(own[_once(own, docs)] if level.across else own)
                    n += len(own)
        yield from out()

    return keys


def _ties(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts one bucket of keys of one kind and tells each unit which of its keys are tied; of equal pieces, also one unit that it stands for them."""
    units, own, what = [], [], key[1].as_py()
    checked = what % WORDS != TIED_SAMPLE
    for batch in batches:
        units += batch.column("unit").to_pylist()
        own += [_apart(k.as_buffer(), checked) for k in batch.column("keys")]
    keys, checks = (np.concatenate([x[i] for x in own]) for i in (0, 1))
    if checked:
        order = np.argsort(keys, kind="stable")
        keys, checks = keys[order], checks[order]
        same = keys[1:] == keys[:-1]
        if (same & (checks[1:] != checks[:-1])).any():
            # Different strings of one key: their checks are sorted too.
            order = np.lexsort((checks, keys))
            keys, checks = keys[order], checks[order]
            same = keys[1:] == keys[:-1]
        same &= checks[1:] == checks[:-1]
    else:
        keys.sort(kind="stable")
        same = keys[1:] == keys[:-1]
    tied = np.unique(_joint(keys[1:][same], checks[1:][same]) if checked else keys[1:][same])
    free = np.ones(len(tied), bool)
    out = []
    for i in np.argsort(units, kind="stable"):
        mine, its = own[i]
        joint = _joint(mine, its) if checked else mine
        hit = _among(joint, tied)
        hit[1:] &= joint[1:] != joint[:-1]
        if hit.any():
            # Of a sampled key the lower half is enough to find it again among a unit's own.
            out.append((units[i], what, (joint[hit] if checked else mine[hit].astype(np.uint32)).tobytes()))
            if what % WORDS == EQUAL_PIECE:
                at = np.searchsorted(tied, joint[hit])
                first = free[at]
                if first.any():
                    out.append((units[i], what - EQUAL_PIECE + OWN_PIECE, joint[hit][first].tobytes()))
                    free[at[first]] = False
    cols = list(zip(*out, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], ["unit", "kind", "keys"])


class Visit:
    """What a unit does with what it has been told so far: piece keys (1), suffix keys (2), results (3)."""

    def __init__(self, stage: int, bits: int, points: tuple[int, int]):
        self.stage, self.bits, self.points = stage, bits, points

    def function(self) -> Callable:
        def run(key: tuple[pa.Scalar, ...], chunks: pa.Table, told: pa.Table) -> pa.Table:
            return self.run(chunks, told)

        return run

    def run(self, chunks: pa.Table, told: pa.Table) -> pa.Table:
        types = {k: np.uint32 if k % WORDS == TIED_SAMPLE else np.uint64 for k in range(2 * WORDS)}
        known: dict[int, list[np.ndarray]] = {k: [np.zeros(0, t)] for k, t in types.items()}
        for what, blob in zip(told.column("kind").to_pylist(), told.column("keys"), strict=True):
            known[what].append(np.frombuffer(blob.as_buffer(), types[what]))
        known = {k: np.sort(np.concatenate(v)) for k, v in known.items()}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        taken = {level: np.zeros(0, np.uint64) for level in LEVELS}
        rows, ids = [], []
        for doc_ids, sizes, data in zip(chunks.column("doc_ids"), chunks.column("sizes"), chunks.column("data"), strict=True):
            sizes, text = sizes.values.to_numpy(), np.frombuffer(data.as_buffer(), np.uint8)
            found = {}
            for level in LEVELS:
                told_of = {k - level.kinds: v for k, v in known.items() if level.kinds <= k < level.kinds + WORDS}
                runs = Runs(sizes, text, level, self.points, told_of[TIED_SAMPLE])
                if self.stage == 1:
                    sent = runs.once(runs.piece_keys, runs.piece_docs)
                    held.setdefault(level.kinds + EQUAL_PIECE, []).append((runs.piece_keys[sent], runs.piece_checks[sent]))
                elif self.stage == 2:
                    sent = np.flatnonzero(self.sent(runs, told_of, taken))
                    sent = sent[runs.once(runs.keys[sent], runs.docs[sent])]
                    held.setdefault(level.kinds + TIED_WINDOW, []).append((runs.keys[sent], runs.checks[sent]))
                else:
                    found[level] = runs, self.repeats(runs, told_of)
            if self.stage == 3:
                ids.append(doc_ids.values)
                rows += self.results(sizes, text, found)
        if self.stage < 3:
            unit = chunks.column("unit")[0].as_py()
            parts = [_by_bucket(unit, what, *(np.concatenate([x[i] for x in own]) for i in (0, 1)), self.bits) for what, own in held.items()]
            return pa.Table.from_batches(parts, schema=KEYS_SCHEMA)
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    @staticmethod
    def equal(runs: Runs, told: dict[int, np.ndarray]) -> np.ndarray:
        return _among(_joint(runs.piece_keys, runs.piece_checks), told[EQUAL_PIECE])

    def sent(self, runs: Runs, told: dict[int, np.ndarray], taken: dict[Level, np.ndarray]) -> np.ndarray:
        """The suffixes of one copy of each equal piece that this unit stands for, and of all other pieces."""
        equal = self.equal(runs, told)
        joint = _joint(runs.piece_keys, runs.piece_checks)
        own = equal & _among(joint, told[OWN_PIECE]) & ~np.isin(joint, taken[runs.level])
        first = np.zeros(len(own), bool)
        first[np.unique(joint, return_index=True)[1]] = True
        own &= first
        taken[runs.level] = np.concatenate([taken[runs.level], joint[own]])
        return runs.of_pieces(~equal | own)

    def repeats(self, runs: Runs, told: dict[int, np.ndarray]) -> np.ndarray:
        """Positions of suffixes whose strings repeat."""
        return runs.at[runs.of_pieces(self.equal(runs, told)) | _among(_joint(runs.keys, runs.checks), told[TIED_WINDOW])]

    @staticmethod
    def results(sizes: np.ndarray, text: np.ndarray, found: dict[Level, tuple[Runs, np.ndarray]]) -> Iterator[tuple]:
        covered = {}
        for level, (runs, at) in found.items():
            edge = np.bincount(at, minlength=runs.n + level.window + 1) - np.bincount(at + level.window, minlength=runs.n + level.window + 1)
            covered[level] = np.cumsum(edge[: runs.n]) > 0
        gone = covered[BYTE_LEVEL]
        count = np.r_[0, np.cumsum(gone)]
        runs = found[WORD_LEVEL][0]
        words = np.r_[0, np.cumsum(covered[WORD_LEVEL])]
        ends = runs.doc_ends.tolist()
        start = 0
        for i, n in enumerate(sizes.tolist()):
            own, n_gone = gone[start : start + n], int(count[start + n] - count[start])
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n_gone else 0
            kept = text[start : start + n][~own] if n_gone else text[start : start + n]
            yield n, n_gone, spans, hashlib.sha256(kept.tobytes()).hexdigest(), int(words[ends[i]] - words[ends[i] - int(runs.sizes[i])])
            start += n


def _units(docs: DataFrame, scratch: list[str], name: str) -> tuple[DataFrame, int]:
    """The texts in chunks, as a table of this name that is bucketed by slot, one or a few units for each partition of docs; and the bytes of text.

    There are as many slots as partitions, or as buckets may be if these are fewer, and a slot's number is chosen so that
    its bucket is that of its place among them: each task writes one file, and no text is shuffled here or when
    units are joined with replies. What the driver collects is a number for each slot.
    """
    spark = docs.sparkSession
    n = min(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    spread = spark.range(max(64, 40 * n)).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("b")).agg(F.min("id").alias("id"))
    found = {r.b: r.id for r in spread.collect()}
    slots = spark.sparkContext.broadcast(np.array([found[b] for b in sorted(found)]))
    scratch.append(fresh_path(spark, "units"))
    packed = docs.mapInArrow(_pack(slots), f"slot long, unit long, doc_ids array<{kind(docs, 'doc_id')}>, sizes array<long>, data binary")
    packed.write.bucketBy(n, "slot").option("compression", "zstd").option("path", scratch[-1]).saveAsTable(name)
    table = spark.table(name)
    total = table.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first().n or 0
    return table, total


def _bytes(size: str) -> int:
    """A size such as 16m, 128MB or 4096, in bytes."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * ("kmgt".index(unit) + 1 if unit else 0)


def _free(spark: SparkSession) -> None:
    """Has Spark drop the shuffle files of finished steps now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words.

    n_passage_words counts the words in runs of PASSAGE_WORDS words that another document has too.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select("doc_id", "text")
    scratch: list[str] = []
    # Files are read in parts that a task can hold; units of a slot stay in its bucket when they meet their replies.
    settings = {"spark.sql.files.maxPartitionBytes": str(min(UNIT_BYTES, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))), "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    name = f"units_{uuid.uuid4().hex}"
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        return _spans(docs, scratch, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, scratch)
        _free(spark)


def _spans(docs: DataFrame, scratch: list[str], name: str) -> DataFrame:
    spark = docs.sparkSession
    table, total = _units(docs, scratch, name)
    points = tuple(2 + secrets.randbelow(P - 3) for _ in range(2))
    bits = max(4, min(24, (total * (BYTE_LEVEL.order + 1) // BYTE_LEVEL.v // BUCKET_KEYS).bit_length()))

    def ties(keys: DataFrame) -> DataFrame:
        done = cut(keys.groupBy("bucket", "kind").applyInArrow(_ties, REPLY), scratch)
        del keys
        _free(spark)
        return done

    def visit(stage: int, known: DataFrame, schema: str) -> DataFrame:
        told_slots = known.withColumn("slot", F.shiftright("unit", SLOT_BITS))
        return table.groupBy("slot", "unit").cogroup(told_slots.groupBy("slot", "unit")).applyInArrow(Visit(stage, bits, points).function(), schema)

    told = ties(table.select("unit", "sizes", "data").mapInArrow(_cover_keys(bits, points), KEYS))
    for stage in (1, 2):
        told = told.union(ties(visit(stage, told, KEYS)))
    return cut(visit(3, told, f"doc_id {kind(docs, 'doc_id')}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"))
