"""Mixing sources to target weights.

The words of each source, dealt into groups by doc_id and text and in order within, are packed into blocks of BLOCK_WORDS, which
are numbered within their source. The mix has as many slots as blocks in its size, in output
shards of SHARD_SLOTS. Each shard draws a multinomial count of slots per source from the target
shares; running totals over shards number a source's slots. Slots that a source draws beyond its
target pass to sources that drew fewer, so the mix has each target to within one block. Slot k of
a source is mapped through a pseudorandom permutation of the source's blocks, another one for
each time around, and blocks are joined by source and index. As targets end at twice a source's
size, no block is taken more than twice.

Defined cases: a null text has no words; documents without words take part with size 0 and
nothing taken; a null source is a source, after all others; rows that share source and doc_id
are packed one after the other in the order of their texts; an empty table gives an empty mix.
All draws are from a fixed seed, so reruns agree.

Sources are few, as the driver plans them: it holds one row a source, and a shard draws one count a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, route_mark, text_batches, tidy, word_spans

BLOCK_WORDS = 32
SHARD_SLOTS = 4096
#: Weights by a source's rank, repeating; the mix's size in percent of all words; times that a source may be used.
WEIGHTS = (5, 2, 1)
MIX_PERCENT = 150
MAX_TIMES = 2
SEED = 20240501
#: Rows of a source that are numbered together.
GROUP_ROWS = 1 << 10
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """(source_no, source_key, source_size, target) from (source, source_size), one row per source.

    A source's target is the smaller of MAX_TIMES its size and a level times its weight; the
    level is the one at which targets add up to the mix. With sources in the order of the level
    that fills them, the filled ones come first. One row per source is few, and goes to one task.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("source_no", F.row_number().over(by_code_point) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS)).cast("int") + 1)
    full = MAX_TIMES * F.col("source_size")
    fills = ranked.withColumn("weight", weight).withColumn("fill", full / weight)
    before = Window.orderBy("fill", "source_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("fill", "source_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = fills.select(
        "*",
        (F.sum("source_size").over(every) * (MIX_PERCENT / 100)).alias("mix"),
        (F.sum(full).over(before) - full).alias("filled"),
        F.sum("weight").over(after).alias("open"),
    ).withColumn("level", (F.col("mix") - F.col("filled")) / F.col("open"))
    # The first source that its level leaves unfilled sets the level of all after it.
    first = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "source_no", "level"))).over(every)
    return level.withColumn("at", first["level"]).select(
        "source", "source_no", "source_size", "weight", F.when(F.col("at").isNull(), full.cast("double")).otherwise(F.least(full.cast("double"), F.col("at") * F.col("weight"))).alias("target")
    )


def _offsets(rows: DataFrame) -> DataFrame:
    """rows(source_no, doc_id, size, text_key, ...) with the words of the source before each row.

    A hot source is numbered in groups of about GROUP_ROWS rows, dealt by a hash of the row:
    sums per group, running sums over groups, then running sums within a group.
    """
    groups = Window.partitionBy("source_no").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source_no", "grp").orderBy("doc_id", "text_key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "grp").agg(F.sum("size").alias("words"))
    starts = sums.select("source_no", "grp", F.coalesce(F.sum("words").over(groups), F.lit(0)).alias("start"))
    return rows.join(starts, ["source_no", "grp"]).withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))


def _draws(shares: list[float], counts: list[int]):
    """Per shard, what it draws from each source; the last shard is smaller."""
    total = sum(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column("id").to_numpy()
            n = [np.random.default_rng([SEED, int(k)]).multinomial(min(SHARD_SLOTS, total - int(k) * SHARD_SLOTS), shares) for k in shards]
            n = np.array(n, np.int64).reshape(len(shards), len(shares))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(shards, len(shares))), pa.array(np.tile(np.arange(len(shares), dtype=np.int32), len(shards))), pa.array(n.reshape(-1))], ["shard", "source_no", "drawn"]
            )

    return run


#: Primes of the two rounds of a permutation, fixed values; a number of blocks can't have all three of a round.
ROUND_PRIMES = ((1000003, 1000033, 1000037), (999983, 999979, 999961))


def permuted(i: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for each key: two rounds of i * prime + shift modulo n.

    A round's prime is one that doesn't divide n, so every round is one to one. Between the
    rounds the two halves of the range are interleaved, which products alone would keep in step.
    """
    for r, primes in enumerate(ROUND_PRIMES):
        mult = F.when(n % primes[0] != 0, F.lit(primes[0])).when(n % primes[1] != 0, F.lit(primes[1])).otherwise(F.lit(primes[2]))
        i = F.pmod(i * F.pmod(mult.cast("long"), n) + F.pmod(F.xxhash64(key, F.lit(SEED + r)), n), n)
        if r == 0:
            upper = n - F.floor(n / 2)
            i = F.when(i < upper, 2 * i).otherwise(2 * (i - upper) + 1)
    return i


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs(doc_id, text, source).

    Returns rows (row_key, doc_id, text_key, source_no, size, source_size, target, offset), one
    per row of docs; drawn (shard, source_no, drawn); and pieces (shard, source_no, k, row_key,
    times, start, words): which words of which row each slot of the mix holds.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))
    sized = cut(sized.withColumn("row_key", F.monotonically_increasing_id()))
    aims = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))))
    plan = [r for r in aims.orderBy("source_no").toLocalIterator()]
    n_rows = sized.count()
    groups = max(1, n_rows // GROUP_ROWS)
    rows = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select("row_key", "doc_id", "text_key", "size", "source_no", "source_size", "target")
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(groups)))
    placed = cut(_offsets(rows).select("row_key", "doc_id", "text_key", "source_no", "size", "source_size", "target", "offset"))

    blocks = [-(-r.source_size // BLOCK_WORDS) for r in plan]
    quota = [min(MAX_TIMES * b, round(r.target / BLOCK_WORDS)) for r, b in zip(plan, blocks, strict=True)]
    spark = docs.sparkSession
    total = sum(quota)
    shards = spark.range(0, -(-total // SHARD_SLOTS)) if total else spark.range(0)
    shares = [q / total for q in quota] if total else []
    drawn = cut(shards.mapInArrow(_draws(shares, quota), "shard long, source_no int, drawn long"))
    return placed, drawn, _assembled(placed, drawn, blocks, quota)


def _assembled(placed: DataFrame, drawn: DataFrame, blocks: list[int], quota: list[int]) -> DataFrame:
    spark = placed.sparkSession
    # Two-level running totals over shards, so that no source's shards all go to one task.
    lots = drawn.withColumn("lot", F.floor(F.col("shard") / 1024))
    lot = Window.partitionBy("source_no").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("source_no", "lot").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = lots.groupBy("source_no", "lot").agg(F.sum("drawn").alias("n"))
    starts = sums.select("source_no", "lot", F.coalesce(F.sum("n").over(lot), F.lit(0)).alias("lot_start"))
    counted = lots.join(starts, ["source_no", "lot"]).withColumn("first", F.col("lot_start") + F.coalesce(F.sum("drawn").over(own), F.lit(0)))
    got = {r.source_no: r.n for r in drawn.groupBy("source_no").agg(F.sum("drawn").alias("n")).collect()}
    # What sources drew beyond their quota is numbered on and goes to those that drew less.
    table, spare, lack = [], 0, []
    for s, (b, q) in enumerate(zip(blocks, quota, strict=True)):
        n = got.get(s, 0)
        table.append((s, b, q, spare))
        spare += max(0, n - q)
        if n < q:
            lack.append((s, n, q - n))
    at, gaps = 0, []
    for s, n, k in lack:
        gaps.append((s, n, at, at + k))
        at += k
    limits = spark.createDataFrame(table, "source_no int, n_blocks long, quota long, spare long")
    shards = counted.join(limits, "source_no")
    slots = shards.filter("drawn > 0").select("shard", "source_no", "n_blocks", "quota", "spare", F.explode(F.sequence("first", F.col("first") + F.col("drawn") - 1)).alias("k"))
    fits = slots.filter("k < quota").select("shard", "source_no", "n_blocks", "k")
    if gaps:
        takers = spark.createDataFrame(gaps, "to_no int, have long, low long, high long")
        takers = takers.select("to_no", "have", "low", F.explode(F.sequence("low", F.col("high") - 1)).alias("x"))
        over = slots.filter("k >= quota").select("shard", (F.col("spare") + F.col("k") - F.col("quota")).alias("x"))
        moved = over.join(takers, "x").select("shard", F.col("to_no").alias("source_no"), (F.col("have") + F.col("x") - F.col("low")).alias("k"))
        fits = fits.unionByName(moved.join(limits.select("source_no", "n_blocks"), "source_no").select("shard", "source_no", "n_blocks", "k"))
    times = F.floor(F.col("k") / F.col("n_blocks"))
    index = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.concat_ws(":", "source_no", times))
    chosen = fits.select("shard", "source_no", "k", times.alias("times"), index.alias("block"))
    first, last = F.floor(F.col("offset") / BLOCK_WORDS), F.floor((F.col("offset") + F.col("size") - 1) / BLOCK_WORDS)
    held = placed.filter("size > 0").select("row_key", "doc_id", "source_no", "size", "offset", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("block") * BLOCK_WORDS, "offset")
    stop = F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("offset") + F.col("size"))
    held = held.select("row_key", "source_no", "block", (start - F.col("offset")).alias("start"), (stop - start).alias("words"))
    return chosen.join(held, ["source_no", "block"]).select("shard", "source_no", "k", "row_key", "times", "start", "words")


def taken(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, source): doc_id, size, source_size, target, taken (words, repeats counted)."""
    placed, _, pieces = mix(docs)
    sums = pieces.groupBy("row_key").agg(F.sum("words").alias("words"))
    return placed.join(sums, "row_key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).alias("taken"))


@tidy
def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each time that a row is taken, the words taken then with the white space between them; separate spans on lines of their own."""
    for batch in batches:
        rows, out = [], []
        for i, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            starts, ends = word_spans(np.frombuffer(data, np.uint8))
            runs: dict[int, list[list[int]]] = {}
            for s in sorted((s["times"], s["start"], s["words"]) for s in spans):
                own = runs.setdefault(s[0], [])
                if own and own[-1][1] == s[1]:
                    own[-1][1] += s[2]
                else:
                    own.append([s[1], s[1] + s[2]])
            for own in runs.values():
                rows.append(i)
                out.append(b"\n".join(data[starts[a] : ends[b - 1]] for a, b in own))
        text = pa.array(out, pa.binary()).cast(pa.string(), safe=False) if out else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), text], ["row", "text"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs, whatever their names: a row for each time that a document is taken, with the words taken then.

    n_chars, where there is such a column, is that of the new text. Rows that repeat doc_id and text
    may change places with each other. Each text is shuffled once, to meet the spans that are taken of it.
    """
    text_batches(docs.sparkSession)
    placed, _, pieces = mix(docs)
    spans = pieces.groupBy("row_key").agg(F.collect_list(F.struct("times", "start", "words")).alias("spans"))
    spans = spans.join(placed.select("row_key", "doc_id", "text_key"), "row_key")
    key = F.struct("doc_id", "text_key")
    again = cut(placed.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key.alias("again")))
    # Rows that repeat are numbered, on both sides; all others are the first of their kind without being looked at.
    by_key = Window.partitionBy("key").orderBy("row_key")
    marked = route_mark(spans.select(key.alias("key"), "row_key", "spans"), F.col("key"), again, F.col("again")).select("row.*", "routed")
    spans = marked.filter("not routed").withColumn("nth", F.lit(1)).unionByName(marked.filter("routed").withColumn("nth", F.row_number().over(by_key)))
    spans = spans.select(F.col("key.doc_id").alias("of"), F.col("key.text_key").alias("of_text"), F.col("nth").alias("of_nth"), "spans")
    marked = route_mark(docs, F.struct("doc_id", F.xxhash64("text").alias("text_key")), again, F.col("again"))
    texts = marked.select("row", "routed", F.col("row.doc_id").alias("doc"), F.xxhash64("row.text").alias("text_key"))
    nth = F.row_number().over(Window.partitionBy("doc", "text_key").orderBy(F.lit(0)))
    texts = texts.filter("not routed").withColumn("nth", F.lit(1)).unionByName(texts.filter("routed").withColumn("nth", nth))
    # The text travels once: apart from the row, from which it is taken out.
    rest = [c for c in docs.columns if c != "text"]
    texts = texts.select("doc", "text_key", "nth", F.col("row.text").alias("text"), F.struct(*(F.col("row")[c].alias(c) for c in rest)).alias("row"))
    joined = texts.join(spans, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_text")) & (F.col("nth") == F.col("of_nth")))
    joined = joined.select("row", "text", "spans")
    out = joined.mapInArrow(_cut_text, StructType([joined.schema["row"], joined.schema["text"]]))
    cols = {c: F.col("row")[c] for c in rest} | {"text": F.col("text")}
    if "n_chars" in rest:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(cols[c].alias(c) for c in docs.columns))
