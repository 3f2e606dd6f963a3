"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text's code points become an array of symbols (letter, number, other, apostrophe that begins
a contraction, white space by what follows). The split pattern of the rank files is then a
finite automaton over symbols, and each symbol is a transition function on its states. These
compose associatively, so states at all positions come from a blocked scan: every block's
composed function, a scan over blocks, and a replay within blocks. Where a transition starts a
new piece there is a boundary. Pieces, as slices of the UTF-8 bytes, go through a cache to pair
merging by rank. Byte offsets of the tokens are kept for decoding and for spans of the text.

Defined cases: a null text is empty; an empty text has no tokens; ids outside the vocabulary
fail; pieces of any length are merged in n log n steps.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, kind, text_batches, tidy

# Symbols: letter, number, other, apostrophe of a contraction with 1 or 2 letters, space and
# other white space before a visible character (N) or before white space or the end (W), and the
# gap between two documents.
LETTER, NUMBER, OTHER, APOSTROPHE_1, APOSTROPHE_2, SPACE_N, SPACE_W, BLANK_N, BLANK_W, GAP = range(10)
# States: a new piece must start; within a run of letters, numbers, others; after a space that the
# next run takes in; within white space; one or two letters of a contraction still to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, TAKEN_SPACE, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8
#: Code points of the White_Space property, a fixed list.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that the cache of a worker may hold before it starts afresh.
CACHE_PIECES = 1 << 17
#: Pieces of more bytes are merged one by one, with a heap.
LONG_PIECE = 128
NO_RANK = 1 << 30
_BLOCK = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """By symbol and state: the next state, and whether a piece starts at the symbol."""
    step = np.zeros((10, STATES), np.uint8)
    new = np.ones((10, STATES), bool)
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[symbol] = run
        new[symbol, [run, TAKEN_SPACE]] = False
    step[LETTER, [ONE_MORE, TWO_MORE]] = FRESH, ONE_MORE
    new[LETTER, [ONE_MORE, TWO_MORE]] = False
    for symbol, left in ((APOSTROPHE_1, ONE_MORE), (APOSTROPHE_2, TWO_MORE)):
        step[symbol] = left
        step[symbol, [IN_OTHERS, TAKEN_SPACE]] = IN_OTHERS
        new[symbol, [IN_OTHERS, TAKEN_SPACE]] = False
    step[SPACE_N], step[BLANK_N], step[GAP] = TAKEN_SPACE, FRESH, FRESH
    for symbol in (SPACE_W, BLANK_W):
        step[symbol] = IN_BLANKS
        new[symbol, IN_BLANKS] = False
    return step, new


STEP, NEW = _automaton()
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Symbol of each code point, without regard to its neighbours."""
    if not _KIND:
        kind = np.full(0x110001, OTHER, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                kind[cp] = LETTER
            elif c == "N":
                kind[cp] = NUMBER
        kind[WHITE_SPACE] = BLANK_W
        kind[0x20] = SPACE_W
        kind[0x110000] = GAP
        _KIND.append(kind)
    return _KIND[0]


def symbols(cps: np.ndarray) -> np.ndarray:
    """Symbols of code points, with 0x110000 between documents."""
    s = _kinds()[cps]
    after = np.r_[s[1:], np.uint8(GAP)]
    blank = (s == SPACE_W) | (s == BLANK_W)
    visible = blank & (after <= OTHER)
    s[visible & (s == SPACE_W)] = SPACE_N
    s[visible & (s == BLANK_W)] = BLANK_N
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        pad = np.r_[cps, np.uint32(0x110000), np.uint32(0x110000)]
        a, b = pad[quote + 1], pad[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        s[quote[one]] = APOSTROPHE_1
        s[quote[two]] = APOSTROPHE_2
    return s


def piece_starts(cps: np.ndarray) -> np.ndarray:
    """Where pieces start, by a blocked scan of the symbols' transition functions."""
    s = symbols(cps)
    n = len(s)
    blocks = -(-n // _BLOCK)
    grid = np.full(blocks * _BLOCK, GAP, np.uint8)
    grid[:n] = s
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    # Each block's composed function, as the state that it makes of each state.
    flat = STEP.reshape(-1)
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for row in grid:
        whole = flat[row[:, None] * np.uint8(STATES) + whole]
    # Functions of all blocks up to each one, in as many rounds as the count of blocks has bits.
    shift = 1
    while shift < blocks:
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift], axis=1)
        shift *= 2
    state = np.r_[np.uint8(FRESH), whole[:-1, FRESH]]
    new = NEW.reshape(-1)
    starts = np.zeros(grid.shape, bool)
    for i, row in enumerate(grid):
        at = row * np.uint8(STATES) + state
        starts[i] = new[at]
        state = flat[at]
    return np.flatnonzero(starts.T.reshape(-1)[:n])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece of any length: adjacent parts are joined, lowest rank and leftmost first, until none can be."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, j = heapq.heappop(heap)
        k = end[i]
        if gone[i] or k >= n or end[k] != j:
            continue
        gone[k] = 1
        end[i] = j
        if j < n:
            before[j] = i
            if (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:j])) is not None:
            heapq.heappush(heap, (r, p, j))
    return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]


class PairTable:
    """Which token two tokens make, for arrays of pairs: a hash table with open addressing."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        size = 1 << max(self.BITS, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(65 - size.bit_length())
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int64)
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at = self._slot(keys)
        self.probes = 0
        while len(keys):
            # Of the keys that meet in a free slot the last one written stays; the others go one slot on.
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            here = self.keys[at] == keys
            self.ranks[at[here]] = values[here]
            keys, values, at = keys[~here], values[~here], (at[~here] + 1) % size
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self.keys)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Pieces to ids, through a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = PairTable(ranks)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of pieces, and all ids: in each round, every piece that can joins its best pair."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        done_piece, done_sym = [], []
        rank = np.full(len(sym), NO_RANK, np.int64)
        inside = np.flatnonzero(piece[:-1] == piece[1:])
        rank[inside] = self.pairs.rank(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            open_ = best >> 32 < NO_RANK
            runs = np.diff(np.r_[first, len(sym)])
            if not open_.all():
                # Pieces that can't be joined any more leave.
                stays = np.repeat(open_, runs)
                done_piece.append(piece[~stays])
                done_sym.append(sym[~stays])
                moved = np.cumsum(stays) - 1
                sym, piece, rank = sym[stays], piece[stays], rank[stays]
                best = best[open_]
                best = (best >> 32) << 32 | moved[best & 0xFFFFFFFF]
                if not len(sym):
                    break
            at = best & 0xFFFFFFFF
            sym[at] = best >> 32
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, piece, rank = sym[keep], piece[keep], rank[keep]
            # Only pairs with the new token have another rank: it with the next one, and the one before with it.
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(sym) - 1)
                same = (right > left) & (piece[left] == piece[right])
                rank[left[~same]] = NO_RANK
                rank[left[same]] = self.pairs.rank(sym[left[same]], sym[right[same]])
        piece, sym = np.concatenate([*done_piece, piece]), np.concatenate([*done_sym, sym])
        order = np.argsort(piece, kind="stable")
        return np.bincount(piece, minlength=len(pieces)), sym[order].astype(np.int32)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of pieces, and all ids."""
        if len(self.cache) > CACHE_PIECES:
            self._clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        if new:
            short = [p for p in new if len(p) <= LONG_PIECE]
            counts, flat = self.merge_all(short) if short else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            long = [p for p in new if len(p) > LONG_PIECE]
            merged = [merge(p, self.ranks) for p in long]
            self.cache.update(zip(short + long, range(len(self.cache), len(self.cache) + len(new)), strict=True))
            self.count = np.concatenate([self.count, counts, np.array([len(m) for m in merged], np.int64)])
            self.flat = np.concatenate([self.flat, flat, np.array([x for m in merged for x in m], np.int32)])
            self.first = np.cumsum(self.count) - self.count
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        n = self.count[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, self.flat[np.repeat(self.first[at] - (ends - n), n) + np.arange(total)] if total else self.flat[:0]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        for a, b in chunks(texts, 1 << 19):
            own = [t or "" for t in texts[a:b]]
            cps = np.full(sum(map(len, own)) + len(own), 0x110000, np.uint32)
            ends, at = [], 0
            for t in own:
                cps[at : at + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                at += len(t) + 1
                ends.append(at)
            starts = piece_starts(cps)
            gaps = cps == 0x110000
            size = np.where(gaps, 0, 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF))
            offset = np.r_[0, np.cumsum(size)]
            data = "".join(own).encode("utf-8", "surrogatepass")
            starts = starts[~gaps[starts]]
            cuts = np.r_[offset[starts], offset[-1]].tolist()
            n, ids = self.ids([data[i:j] for i, j in pairwise(cuts)])
            before = np.r_[0, np.cumsum(n)]
            first = before[np.searchsorted(starts, [0, *ends])].tolist()
            for i, j in pairwise(first):
                yield ids[i:j]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _ranks_of(spark: SparkSession, path: str | None):
    """The rank file's bytes on every executor: a vocabulary, whose size doesn't grow with the data."""
    text_batches(spark)
    with open(path or default_ranks(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks.value)
    for big in batches:
        column = big.column("text")
        start = 0
        while start < len(column):
            # Texts leave Arrow in runs of a few megabytes.
            stop, held = start, 0
            while stop < len(column) and (stop == start or held < 1 << 22):
                held += len(column[stop].as_buffer()) if column[stop].is_valid else 0
                stop += 1
            ids = list(encoder.encode(column.slice(start, stop - start).to_pylist()))
            offsets = [np.cumsum(w) - w for w in (encoder.width[i] for i in ids)]
            yield pa.RecordBatch.from_arrays([big.column("doc_id").slice(start, stop - start), _lists(ids, pa.int32()), _lists(offsets, pa.int64())], ["doc_id", "ids", "offsets"])
            start = stop


def _decoded(ranks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(ranks.value)
    tokens = [b""] * len(encoder.width)
    for token, i in encoder.ranks.items():
        tokens[i] = token
    text = np.frombuffer(b"".join(tokens), np.uint8)
    first = np.cumsum(encoder.width) - encoder.width
    for batch in batches:
        out = []
        for ids, offsets in zip(batch.column("ids"), batch.column("offsets"), strict=True):
            i, at = ids.values.to_numpy(), offsets.values.to_numpy()
            # Each byte comes from its token's place in the vocabulary, moved by the token's offset.
            width = encoder.width[i]
            size = int(width.sum())
            out.append(text[np.repeat(first[i] - at, width) + np.arange(size)].tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "data"])


def _encoded_schema(docs: DataFrame) -> str:
    return f"doc_id {kind(docs, 'doc_id')}, ids array<int>, offsets array<long>"


def encode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids, offsets) for docs(doc_id, text): token ids, and the byte where each token starts."""
    ranks = _ranks_of(docs.sparkSession, ranks_path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _encoded(ranks, batches), _encoded_schema(docs))


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """encoded(ids, offsets, ...) with the bytes that the ids stand for as another column, data."""
    ranks = _ranks_of(encoded.sparkSession, ranks_path)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields] + ["data binary"])
    return encoded.mapInArrow(lambda batches: _decoded(ranks, batches), schema)


def encode_and_decode(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass: the ids are decoded in the worker that made them."""
    ranks = _ranks_of(docs.sparkSession, ranks_path)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from _decoded(ranks, _encoded(ranks, batches))
        finally:
            _ENCODERS.clear()

    return docs.select("doc_id", "text").mapInArrow(run, _encoded_schema(docs) + ", data binary")


def token_digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes docs(doc_id, text), then decodes the ids."""
    return encode_and_decode(docs, ranks_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )
