"""Near-duplicate detection by a signature-coordinate inverted join.

Documents with the same words form a class; one representative per class goes on. Its MinHash
signature has COORDINATES values, and the representative is posted under each coordinate-value
pair. A pair of documents is retained when at least MATCHES of its coordinates collide, which
pairs of similarity 0.75 miss with a probability of about 2.5e-8, and is then confirmed on the
full shingle sets.

Counting collisions merges as few postings as it can:

* Values that only one representative has can't collide. One with fewer than MATCHES shared
  values has no partner.
* Prefix: shared values are ordered by how many representatives have them, rarest first. If
  two share MATCHES values, they share one among all but the last MATCHES - 1 of each. Only
  these prefixes are posted to the lists that are merged.
* Skip: what a list can't decide isn't merged. The remaining (long) lists are skipped and their
  collisions counted by probing the two signatures of a candidate pair.

Groups of thousands of near copies would make quadratically many pairs, all of one component.
So lists are merged in rounds. In a star round every list names its most central member (whose
values are the commonest) as its lead, and a document is paired with one lead only: of those
outside its component, the one that most of its lists name. So a round makes one pair a document
at most; components are formed, and lists within one component are done. The last round pairs members of
different components that are left, all of these that can be similar at all. No link between
components is lost. Groups of copies are joined by the stars, with one link a copy and round; the last
round has no bound but that its pairs lie in different components, share one of their rarest
shingles and have fitting sizes.

Nodes are classes of equal word sequences. They are numbered by rows and not by doc_id, so
rows that repeat a doc_id with other texts are documents of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, cut, join_hot, kind, remove, route_filter, route_mark, span_hashes, text_batches, tidy, window_hashes, word_spans

WORDS = 5
COORDINATES = 64
MATCHES = 28
#: A link: 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Rounds in which a document is paired with one lead of its lists; fewer if a round finds no link.
STAR_ROUNDS = 3
#: Links between components that are few enough for one task; more are dealt over tasks.
FEW_LINKS = 1 << 16
#: Star rounds go on while one document in so many finds a link.
STAR_YIELD = 20
_RANDOM = np.random.RandomState(20240501)
_SEEDS, _FACTORS, _FACTORS_2 = (_RANDOM.randint(0, 2**32, COORDINATES, np.uint32) | np.uint32(odd) for odd in (0, 1, 1))


def normal_words(text: str | None) -> bytes:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its words and the sorted distinct hashes of its shingles."""
    for a, b in chunks(texts):
        parts = [normal_words(t) for t in texts[a:b]]
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends = word_spans(data)
        words = span_hashes(data, starts, ends)
        shingles = window_hashes(words, WORDS)
        at = 0
        for p in parts:
            n = p.count(b" ") + 1 if p else 0
            own = shingles[at : at + n - WORDS + 1] if n >= WORDS else window_hashes(words[at : at + n], n) if n else shingles[:0]
            at += n
            yield p, np.unique(own)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a nonempty set, one per coordinate, as signed 32-bit values.

    Each coordinate is a one to one mixer of 32 bits with constants of its own, so that which
    shingle is the least of one says nothing of another.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = x[None, i : i + 1024] ^ _SEEDS[:, None]
        h *= _FACTORS[:, None]
        h ^= h >> np.uint32(15)
        h *= _FACTORS_2[:, None]
        low = np.minimum(low, h.min(axis=1))
    return low.view(np.int32)


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, sigs = [], [], []
        for words, own in shingle_sets(batch.column("text").to_pylist()):
            keys.append(hashlib.blake2b(words, digest_size=16).digest())
            sizes.append(len(own))
            sigs.append(signature(own).tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("print"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
            ["doc_id", "print", "key", "n_shingles", "sig"],
        )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, posting) for each coordinate of each signature; a posting has the coordinate above the value."""
    high = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        rep = np.repeat(batch.column("rep").to_numpy(), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array((sig.astype(np.int64) | high).reshape(-1))], ["rep", "posting"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures collide in MATCHES coordinates or more."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("sig_u", "sig_v"))
        hit = pa.array((a == b).sum(axis=1) >= MATCHES)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("u", "v")], ["u", "v"])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets = [], []
        for words, own in shingle_sets(batch.column("text").to_pylist()):
            keys.append(hashlib.blake2b(words, digest_size=16).digest())
            sets.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "shingles"])


@tidy
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
            x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (a, b))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            hits.append(100 * common >= THRESHOLD * (len(both) - common))
        hit = pa.array(hits, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("u", "v")], ["u", "v"])


@tidy
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of all links in the batches, which are few."""
    held = list(batches)
    u, v = (np.concatenate([b.column(c).to_numpy() for b in held] or [np.zeros(0, np.int64)]) for c in ("u", "v"))
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    comp = nodes[[root(i) for i in range(len(nodes))]] if len(nodes) else nodes
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(comp, pa.int64())], ["rep", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(rep, comp) for the nodes of links(u, v): comp is the smallest rep reachable.

    Up to FEW_LINKS links are united in one task. With more, each pass gives a node the smallest label among itself and its
    neighbours, then the label of that label; passes end when none changes. Every pass is written to the shared folder.
    A label that a large component shares is looked up from many tasks.
    """
    spark = links.sparkSession
    kept: list[str] = []
    links = cut(links.select("u", "v").distinct(), kept)
    if links.count() <= FEW_LINKS:
        done = cut(links.coalesce(1).mapInArrow(_forest, "rep long, comp long"))
        remove(spark, kept)
        return done
    both = links.union(links.select("v", "u"))
    touched, changed, before = both.select(F.col("u").alias("rep")).distinct().withColumn("comp", F.col("rep")), 1, None
    while changed:
        low = both.join(touched, F.col("v") == F.col("rep")).groupBy("u").agg(F.min("comp").alias("low"))
        near = touched.join(low, F.col("rep") == F.col("u"), "left").select("rep", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        # Only labels that are nodes with another label by now say anything.
        far = touched.filter("rep <> comp").select(F.col("rep").alias("comp"), F.col("comp").alias("next"))
        now: list[str] = []
        step = cut(join_hot(near, far, ["comp"], "rep", "left", 8).select("rep", "was", F.least("comp", "next").alias("comp")), now)
        changed = step.filter("comp <> was").count()
        touched = step.select("rep", "comp")
        remove(spark, before or [])
        before = now
    remove(spark, kept)
    return touched


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        sizes = [len(x) for x in sets]
        own = [pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("rep", "comp", "n_shingles")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["rep", "comp", "n_shingles", "key"])


def _spread(lists: DataFrame, scratch: list[str]) -> DataFrame:
    """The rows of lists (by key) whose members are of several components."""
    mixed = lists.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("top")).filter("low <> top").select("key")
    # Written, so that the join is one of two shuffles, whose hot keys Spark splits.
    return lists.join(cut(mixed, scratch), "key", "left_semi")


def _star_pairs(lists: DataFrame, tried: DataFrame | None, scratch: list[str]) -> DataFrame:
    """(u, v): each document with one lead that it wasn't paired with before, of another component: that which most of its lists name.

    A list's lead is its most central member; a tie of leads goes to the more central one, then to the smaller one.
    """
    lead = F.max(F.struct("weight", F.negative("rep").alias("neg"), "comp")).alias("lead")
    leads = lists.groupBy("key").agg(lead, F.min("comp").alias("low"), F.max("comp").alias("top")).filter("low <> top").select("key", "lead")
    named = lists.join(cut(leads, scratch), "key").filter("comp <> lead.comp")
    named = named.groupBy("rep", F.negative("lead.neg").alias("to"), F.col("lead.weight").alias("weight")).agg(F.count(F.lit(1)).alias("n"))
    named = named.select(F.least("rep", "to").alias("u"), F.greatest("rep", "to").alias("v"), "rep", "to", "n", "weight")
    if tried is not None:
        named = named.join(tried, ["u", "v"], "left_anti")
    chosen = named.groupBy("rep").agg(F.max(F.struct("n", "weight", F.negative("to").alias("neg"), "u", "v")).alias("m"))
    return chosen.select("m.u", "m.v").distinct()


def _rest_pairs(lists: DataFrame, sets: DataFrame, scratch: list[str]) -> DataFrame:
    """(u, v): documents of different components, met in a list together, that can be similar at all.

    The same prefix merge, on the shingles themselves: a document's shingles are ordered, first
    those that no other component has, then by how many documents have them. Of documents of
    sizes m and n, THRESHOLD needs an intersection of THRESHOLD * (m + n) / (100 + THRESHOLD); a
    first common shingle at place p leaves one of n - p at most. Most of what no star linked
    differs from all else in so many shingles that nothing common comes early enough.
    """
    left = cut(_spread(lists, scratch).select("rep", "comp", "n_shingles").distinct(), scratch)
    owned = sets.join(left, "rep").select("rep", "comp", "n_shingles", "shingles").mapInArrow(_explode_sets, "rep long, comp long, n_shingles long, key long")
    common = owned.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("top")).filter("low <> top").select("key", "df")
    by_rep = Window.partitionBy("rep")
    place = F.col("n_shingles") - F.count(F.lit(1)).over(by_rep) + F.row_number().over(by_rep.orderBy("df", "key")) - 1
    rest = owned.join(common, "key").withColumn("room", F.col("n_shingles") - place).filter(f"100 * room >= {THRESHOLD} * n_shingles")
    rest = cut(rest.select("key", "rep", "comp", "n_shingles", "room"), scratch)
    least = rest.groupBy("key").agg(F.min("n_shingles").alias("least"))
    rest = rest.join(least, "key").filter(f"{100 + THRESHOLD} * room >= {THRESHOLD} * (n_shingles + greatest(least, cast(ceil(n_shingles * {THRESHOLD} / 100) as long)))")
    rest = cut(_spread(rest.drop("least"), scratch), scratch)
    # Every pair of different components has a member outside a list's commonest component.
    main = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"))
    other = rest.join(main, "key").filter("comp <> m.comp").select(*(F.col(c).alias("u_" + c) for c in ("key", "rep", "comp", "n_shingles", "room")))
    fits = F.expr(f"comp <> u_comp and {100 + THRESHOLD} * least(room, u_room) >= {THRESHOLD} * (n_shingles + u_n_shingles)")
    pairs = other.join(rest, (F.col("u_key") == F.col("key")) & fits)
    return pairs.select(F.least("u_rep", "rep").alias("u"), F.greatest("u_rep", "rep").alias("v")).distinct()


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp(rep, comp) after links(u, v) between nodes: only links between components count, and only these are relabelled."""
    ends = [comp.select(F.col("rep").alias(x), F.col("comp").alias("c" + x)) for x in "uv"]
    between = links.join(ends[0], "u").join(ends[1], "v").filter("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct()
    moved = components(between).filter("rep <> comp").select(F.col("rep").alias("comp"), F.col("comp").alias("to"))
    return join_hot(comp, moved, ["comp"], "rep", "left", 8).select("rep", F.coalesce("to", "comp").alias("comp"))


def near_links(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed links (u, v) between representatives, which connect every component of similar documents; and (rep, comp) of all that have a list.

    docs(doc_id, text); reps(rep, doc_id, key, n_shingles, sig), one row per class of documents with the same words.
    """
    posted = reps.select("rep", "sig").mapInArrow(_postings, "rep long, posting long")
    shared = posted.groupBy("posting").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    owned = posted.join(shared, "posting").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "posting"))).alias("own"), F.sum("df").alias("weight"))
    owned = owned.filter(F.size("own") >= MATCHES)
    prefix = F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1))
    index = owned.select("rep", "weight", F.explode(prefix).alias("p")).select("rep", "weight", F.col("p.posting").alias("key"))
    scratch: list[str] = []
    index = cut(index.join(reps.select("rep", "n_shingles"), "rep"), scratch)
    members = cut(reps.join(index.select("rep").distinct(), "rep", "left_semi"), scratch)
    sigs = members.select("rep", "sig")
    texts = route_filter(docs.select("doc_id", "text"), F.col("doc_id"), members, F.col("doc_id"))
    found = texts.mapInArrow(_sets, f"doc_id {kind(docs, 'doc_id')}, key binary, shingles binary")
    named = members.select("rep", F.col("doc_id").alias("id"), F.col("key").alias("of"))
    sets = cut(found.join(named, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("rep", "shingles").dropDuplicates(["rep"]), scratch)
    comp = members.select("rep", F.col("rep").alias("comp"))
    links = tried = None
    turn, more, total = 0, True, members.count()
    while True:
        lists = index.join(comp, "rep")
        last = turn == STAR_ROUNDS or not more
        pairs = _rest_pairs(lists, sets, scratch) if last else _star_pairs(lists, tried, scratch)
        if last and tried is not None:
            pairs = pairs.join(tried, ["u", "v"], "left_anti")
        pairs = cut(pairs, scratch)
        tried = pairs if tried is None else tried.union(pairs)
        probed = (
            pairs.join(sigs.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), "u")
            .join(sigs.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v")), "v")
            .mapInArrow(_probe, "u long, v long")
        )
        new = cut(
            probed.join(sets.select(F.col("rep").alias("u"), F.col("shingles").alias("set_u")), "u")
            .join(sets.select(F.col("rep").alias("v"), F.col("shingles").alias("set_v")), "v")
            .select("u", "v", "set_u", "set_v")
            .mapInArrow(_confirm, "u long, v long")
        )
        links = new if links is None else links.union(new)
        n = new.count()
        if n or last:
            # The last components outlive this function.
            comp = cut(_merged(comp, new) if n else comp, None if last else scratch)
        if last:
            remove(reps.sparkSession, scratch)
            return links, comp
        # Where few documents found a link, leads are no longer what connects them.
        more = n * STAR_YIELD > total
        turn += 1


def _verdicts(docs: DataFrame) -> DataFrame:
    """near_dedup with print, a hash of the text, that tells rows of one doc_id apart."""
    text_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = docs.withColumn("print", F.xxhash64("text")).mapInArrow(_sign, f"doc_id {kind(docs, 'doc_id')}, print long, key binary, n_shingles long, sig binary")
    signed = cut(signed.withColumn("row", F.monotonically_increasing_id()))
    # A class goes by one of its rows, the first of those with the smallest doc_id.
    classes = signed.filter("n_shingles > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("m"))
    classes = cut(classes.select("key", F.col("m.row").alias("rep"), F.col("m.doc_id").alias("doc_id")))
    own = signed.select(F.col("row").alias("rep"), "n_shingles", "sig")
    reps = cut(classes.join(own, "rep").select("rep", "doc_id", "key", "n_shingles", "sig"))
    comp = near_links(docs, reps)[1]
    comp = comp.join(classes.select("rep", "doc_id"), "rep")
    # Only components of several nodes say anything of a node that it doesn't know itself.
    first = comp.groupBy("comp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("comp", "first")
    named = join_hot(comp.select("rep", "comp"), cut(first), ["comp"], "rep", salts=8).select("rep", "first")
    of = classes.join(named, "rep", "left").select("key", F.coalesce("first", "doc_id").alias("first"))
    out = signed.select("doc_id", "print", "key", "n_shingles").join(of, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "print", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents without words (null, empty, white space) have no shingles and are linked with
    nothing; with fewer words than a shingle has, the whole sequence is one shingle. Rows that
    repeat a doc_id are documents of their own, and all rows of the smallest doc_id are kept. A
    component's id is its smallest doc_id that isn't null; if all are null, so is the id, and its rows are kept.
    """
    return _verdicts(docs).drop("print")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that near-deduplication keeps, with all their columns, whatever their names.

    Of a group, the rows with its smallest doc_id stay; a row with a null doc_id goes if its group has an id. Rows
    without words stay. Only rows that may go are shuffled with their texts; all others pass by.
    """
    out = _verdicts(docs).filter("not kept").select(F.struct(F.col("doc_id").alias("id"), "print").alias("of"))
    dropped = cut(out.distinct())
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("print"))
    marked = route_mark(docs, own, dropped, F.col("of"))
    named = F.struct(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("print"))
    stay = marked.filter("routed").select("row", named.alias("own")).join(dropped, F.col("own").eqNullSafe(F.col("of")), "left_anti")
    return marked.filter("not routed").select("row.*").unionByName(stay.select("row.*"))
