"""Groups of texts whose sets of word shingles are alike: SimHash links, completed by an exact prefix index.

Texts at a similarity of 0.8 differ in about ten of 64 fingerprint bits, more than any table of
Hamming balls can hold.  So links of `simhash.links` come first, and an index that loses none
completes them.  Shingles have one global order, rare ones first.  If two sets have a Jaccard
similarity of s, they share a shingle among the first n - ceil(s n) + 1 of each, and what can
follow that shingle in either bounds their overlap.  Every candidate is judged by these first
shingles, which bound the overlap from above, and what is left is verified on whole sets.

A shingle's holders (a bucket) are not expanded into pairs.  All are tried with the one in which
the shingle stands first, which has the fewest shingles of its own; then only holders that links
don't yet join, outside the bucket's commonest component against all, in cells of at most
`BLOCK` by `BLOCK` rows, until no bucket holds an untried pair.

The order takes counts of shingles that are frequent in some task's chunk, over all texts.  A
passage that many texts share, but few of a chunk, is unknown to these, and its buckets would
make pairs with the square of its texts; so shingles that the index itself shows to be frequent
are ordered anew, and texts that have one among their first ones are indexed again.  The order
decides how large buckets are, never what is found.

Scale: equal sets are one node.  The index holds a fifth of all shingles, aggregated once by
shingle; whole sets travel for candidates only, and a node with many of these is dealt over
many keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tidewell.llm import scratch
from tidewell.llm.components import components
from tidewell.llm.simhash import links, majority, shingle_hashes

#: Rows and columns of a cell of a large bucket.
BLOCK = 4096
#: Candidates of a row and cell that are tried at first, and the factor by which they grow until none is left.
TRIED, GROWTH = 32, 16
#: Candidates of a node that meet at one key.
SPLIT = 1024
#: Shingles counted at once, how often one must occur in these to be counted, and how many the order knows.
CHUNK, FREQUENT, KNOWN = 1 << 19, 3, 1 << 18
#: Holders in the index from which a shingle is ordered anew, and how often that is done at most.
HOLDERS, ROUNDS = 8, 6
#: At most so many bytes of identifiers are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 2 << 20


def few(table: DataFrame) -> DataFrame:
    """A written table of identifiers, broadcast where it is small."""
    return F.broadcast(table) if scratch.size(table) <= BROADCAST_BYTES else table


def least_overlap(total: int, similarity: float) -> int:
    """Shared shingles that two sets of together `total` need."""
    return math.ceil(similarity / (1 + similarity) * total - 1e-9)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", size))


def jaccard(a: str, b: str, size: int) -> float:
    """Similarity of the shingle sets of two texts; 1 if both are empty."""
    x, y = shingle_set(a, size), shingle_set(b, size)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    """Rows of `docs` as doc with row, set (a 128-bit hash of the shingle set), n (its size) and
    fp; and rows of frequent shingles with how often a chunk had them (times)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        schema, total = None, 0

        def counted() -> pa.RecordBatch:
            names, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            names, times = names[times >= FREQUENT], times[times >= FREQUENT]
            arrays = [pa.nulls(len(names), f.type) for f in schema][:5]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(names.view(np.int64)), pa.array(times.astype(np.int64))], schema=schema)

        for batch in batches:
            if schema is None:
                kinds = {"doc": batch.schema.field(0).type, "row": pa.int64(), "set": pa.binary(), "n": pa.int32(), "fp": pa.int64(), "token": pa.int64(), "times": pa.int64()}
                schema = pa.schema(list(kinds.items()))
            sets, ns, fps = [], [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), size)
                fps.append(majority(hashes))
                hashes = np.unique(hashes)
                sets.append(xxhash.xxh128_digest(hashes.astype("<u8").tobytes()))
                ns.append(len(hashes))
                held.append(hashes)
                total += len(hashes)
                if total >= CHUNK:
                    yield counted()
                    total = 0
            none = pa.nulls(batch.num_rows, pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(ns, pa.int32()), pa.array(fps, pa.int64()), none, none]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        if held:
            yield counted()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    longs = [StructField(k, t) for k, t in (("row", LongType()), ("set", BinaryType()), ("n", IntegerType()), ("fp", LongType()), ("token", LongType()), ("times", LongType()))]
    return rows.mapInArrow(scratch.tidied(run), StructType([StructField("doc", rows.schema["doc"].dataType), *longs]))


class Order:
    """The global order of shingles: by how often the known ones were counted (0 for others, 65,535 at most), then by hash."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray):
        tokens = np.asarray(tokens, dtype=np.int64).view(np.uint64)
        order = np.argsort(tokens)
        self.tokens, self.times = tokens[order], np.minimum(np.asarray(times, dtype=np.int64)[order], 0xFFFF)

    def counted(self, own: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(own), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, own), len(self.tokens) - 1)
        return np.where(self.tokens[at] == own, self.times[at], 0)

    def raised(self, tokens: np.ndarray, times: np.ndarray) -> Order:
        """An order that counts these shingles at least so often.  All known ones stay and none comes earlier than
        before, so the first shingles of a set that holds none of these among them are the same in both orders."""
        tokens = np.concatenate((self.tokens, np.asarray(tokens, dtype=np.int64).view(np.uint64)))
        names, at = np.unique(tokens, return_inverse=True)
        most = np.zeros(len(names), dtype=np.int64)
        np.maximum.at(most, at, np.concatenate((self.times, np.asarray(times, dtype=np.int64))))
        return Order(names.view(np.int64), most)

    def head(self, own: np.ndarray, similarity: float) -> np.ndarray:
        """The first shingles of a sorted set, of which alike sets share one at least."""
        return own[np.argsort(self.counted(own), kind="stable")][: first(len(own), similarity)]

    def brief(self, own: np.ndarray, similarity: float) -> bytes:
        """A head for `most`: how many of it aren't known, the upper halves of the hashes, the known ones' counts."""
        head = self.head(own, similarity)
        counts = self.counted(head)
        return b"".join((np.array([(counts == 0).sum()], dtype="<u4").tobytes(), (head >> np.uint64(32)).astype("<u4").tobytes(), counts[counts > 0].astype("<u2").tobytes()))


def unfolded(brief: bytes, n: int) -> np.ndarray:
    """Counts and halves of a head of n shingles as one number each, which grow."""
    none = int(np.frombuffer(brief, dtype="<u4", count=1)[0])
    out = np.frombuffer(brief, dtype="<u4", count=n, offset=4).astype(np.uint64)
    out[none:] |= np.frombuffer(brief, dtype="<u2", offset=4 + 4 * n).astype(np.uint64) << np.uint64(32)
    return out


def first(n: int, similarity: float) -> int:
    """Of n shingles in the global order, how many the index holds."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def most(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> int:
    """The most shingles that sets of nx and ny with brief heads x and y can share: before the place where
    one head ends it is known which may be shared, and from there on the smaller rest can be."""
    if not len(x) or not len(y):
        return 0
    cut = min(x[-1], y[-1])
    ix, iy = int(np.searchsorted(x, cut)), int(np.searchsorted(y, cut))
    return int(np.isin(x[:ix], y[:iy]).sum()) + min(nx - ix, ny - iy)


def _prefixes(texts: DataFrame, order: Order, size: int, similarity: float) -> DataFrame:
    """From (row, text): token, node, n and pos of the first shingles of each set in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, sizes = [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), size)
                heads.append(order.head(own, similarity))
                sizes.append(len(own))
            counts = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
            at = np.repeat(np.arange(len(heads)), counts)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            token = np.concatenate([np.zeros(0, dtype=np.uint64), *heads]).view(np.int64)
            arrays = [pa.array(token), batch.column(0).take(pa.array(at)), pa.array(np.array(sizes, dtype=np.int32)[at]), pa.array(pos.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "n", "pos"])

    return texts.mapInArrow(scratch.tidied(run), "token long, node long, n int, pos int")


def _index(texts: DataFrame, order: Order, size: int, similarity: float) -> tuple[DataFrame, DataFrame, Order]:
    """The prefixes of all texts (row, text), their tokens with two nodes at least (token), and the order that they're in."""

    def held(table: DataFrame) -> DataFrame:
        return table.groupBy("token").agg(F.count(F.lit(1)).alias("members"))

    def tidy() -> None:
        scratch.release(texts.sparkSession)
        scratch.shrink(texts.sparkSession)

    def underrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = order.counted(batch.column(0).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(np.minimum(batch.column(1).to_numpy(), 0xFFFF) > 2 * counts))

    table = last = scratch.written(_prefixes(texts, order, size, similarity), "near-index")
    for _ in range(ROUNDS):  # after the first round only what has been indexed again can show more
        more = held(last).where(F.col("members") >= HOLDERS).mapInArrow(scratch.tidied(underrated), "token long, members long")
        more = scratch.written(more.orderBy(F.desc("members"), "token").limit(KNOWN), "near-underrated")
        tidy()
        known = more.toArrow()
        if not len(known):
            break
        order = order.raised(known["token"].to_numpy(), known["members"].to_numpy())
        anew = scratch.written(table.join(few(more.select("token")), "token", "left_semi").select(F.col("node").alias("row")).distinct(), "near-anew")
        last = scratch.written(_prefixes(texts.join(few(anew), "row", "left_semi"), order, size, similarity), "near-index")
        table = table.join(few(anew.withColumnRenamed("row", "node")), "node", "left_anti").select(*last.columns).unionByName(last)
    shared = scratch.written(held(table).where("members > 1").select("token"), "near-shared")
    tidy()
    return table, shared, order


def _possible(n, pos, other_n, other_pos, similarity: float):
    """Whether two sets that share a shingle at these places, and none before, can be alike enough."""
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (n + other_n) - F.lit(1e-9))
    return F.least(n - pos, other_n - other_pos) >= need


def _dealt(pairs: DataFrame, sets: DataFrame, side: str, columns: list[str]) -> DataFrame:
    """Join columns of each pair's node on one side; a node with many pairs is dealt over as many keys as it needs."""
    own = sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])
    hot = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts")).where("parts > 1")
    hot = scratch.written(hot, "near-hot")
    if hot.isEmpty():
        return pairs.join(own, side)
    spread = pairs.join(few(hot), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))))
    copies = own.join(few(hot), side, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    return spread.drop("parts").join(copies.drop("parts"), [side, "part"]).drop("part")


def _verified(pairs: DataFrame, texts: DataFrame, order: Order, size: int, similarity: float) -> DataFrame:
    """Those of the written pairs (a, b) of nodes whose whole shingle sets have at least the similarity."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), size) for t in part.column(1)]
                heads = [order.brief(s, similarity) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array(heads, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "head", "own"])

    def judged(good):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select([0, 1]).filter(pa.array([good(*r) for r in zip(*batch.columns[2:], strict=True)], pa.bool_()))

        return scratch.tidied(run)

    def hashes(x) -> np.ndarray:
        return np.frombuffer(x.as_buffer(), dtype=np.uint64)

    def possible(nx, x, ny, y) -> bool:
        nx, ny = nx.as_py(), ny.as_py()
        x, y = (unfolded(h.as_buffer(), first(n, similarity)) for h, n in ((x, nx), (y, ny)))
        return most(x, nx, y, ny) >= least_overlap(nx + ny, similarity)

    def alike(x, y) -> bool:
        x, y = hashes(x), hashes(y)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    spark = pairs.sparkSession
    wanted = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-wanted")
    sets = scratch.written(texts.join(few(wanted), "row", "left_semi").mapInArrow(scratch.tidied(whole), "node long, n int, head binary, own binary"), "near-sets")
    heads = _dealt(_dealt(pairs, sets, "a", ["n", "head"]), sets, "b", ["n", "head"]).select("a", "b", "n_a", "head_a", "n_b", "head_b")
    left = scratch.written(heads.mapInArrow(judged(possible), "a long, b long"), "near-possible")
    scratch.release(spark)
    scratch.shrink(spark)
    kept = scratch.written(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-kept")
    own = sets.join(few(kept), "node", "left_semi").select("node", "own")
    both = _dealt(_dealt(left, own, "a", ["own"]), own, "b", ["own"]).select("a", "b", "own_a", "own_b")
    found = scratch.written(both.mapInArrow(judged(alike), "a long, b long"), "near-links")
    scratch.drop(sets)
    scratch.release(spark)
    scratch.shrink(spark)
    return found


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows whose first `keys` columns are equal."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(both) for both in zip(held, own, strict=True)] if held else own
        cuts = (np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in held[:keys]])) + 1).tolist()
        for start, end in zip([0, *cuts], cuts, strict=False):
            yield [c[start:end] for c in held]
        held = [c[cuts[-1] :].copy() if cuts else c for c in held]
    if held:
        yield held


def meet(cell: list[np.ndarray], most: int, similarity: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Nodes (a > b) of a cell's possible pairs of one row in question and one other row with another
    root: `most` a row, those that may share most first; and whether there are more."""
    asked, node, root, n, pos = cell[3:]
    left, right = np.flatnonzero(asked), np.flatnonzero(~asked)
    found, more = [], False
    for at in range(0, len(left), 256):
        x = left[at : at + 256]
        room = np.minimum((n - pos)[x][:, None], (n - pos)[right][None, :])
        good = root[x][:, None] != root[right][None, :]
        good &= room >= np.ceil(similarity / (1 + similarity) * (n[x][:, None] + n[right][None, :]) - 1e-9)
        if (good.sum(axis=1) > most).any():
            more = True
            score = np.where(good, room / (n[x][:, None] + n[right][None, :]), -1)
            first = np.argsort(-score, axis=1, kind="stable")[:, :most]
            kept = np.zeros_like(good)
            np.put_along_axis(kept, first, True, axis=1)
            good &= kept
        i, j = np.nonzero(good)
        found.append((node[x[i]], node[right[j]]))
    x, y = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return np.maximum(x, y), np.minimum(x, y), more


def _meetings(live: DataFrame, most: int, similarity: float) -> DataFrame:
    """token, a, b and more of possible pairs of a bucket's members (token, node, n, pos, root) with different roots; see `meet`."""
    each = live.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    tops = each.groupBy("token").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top"))
    tops = tops.where(F.col("all") > F.col("top.c")).select(
        "token", F.col("top.root").alias("common"), F.ceil(F.col("all") / BLOCK).alias("columns"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK).alias("lines")
    )
    rows = live.join(scratch.written(tops, "near-tops"), "token")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    others = rows.select("token", own("columns").alias("column"), F.explode(upto("lines")).alias("line"), F.lit(False).alias("asked"), "node", "root", "n", "pos")
    asked = rows.where("root != common").select("token", F.explode(upto("columns")).alias("column"), own("lines").alias("line"), F.lit(True).alias("asked"), "node", "root", "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, n = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=["token", "a", "b", "more"])

        for cell in runs(batches, 3):
            a, b, more = meet(cell, most, similarity)
            if len(a):
                made.append((np.full(len(a), cell[0][0]), a, b, np.full(len(a), more)))
                n += len(a)
            if n >= 65536 or len(made) >= 65536:
                yield batch()
                made, n = [], 0
        if made:
            yield batch()

    cell = ["token", "column", "line"]
    return others.unionByName(asked).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(scratch.tidied(run), "token long, a long, b long, more boolean")


def _distinct_buckets(met: DataFrame, heads: DataFrame) -> DataFrame:
    """token of the buckets that are left to be tried: those of more than two, and of buckets with the same
    members (by 128 bits) the first in the global order.

    Its shingle stands first in each member, which leaves all pairs at least the room that the others leave.
    """
    large = heads.where("members > 2").select("token")
    names = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"name{k}") for k in (1, 2)]
    own = met.join(large, "token", "left_semi").groupBy("token").agg(*names, F.count(F.lit(1)).alias("members"), F.min(F.struct("node", "pos")).alias("at"))
    return own.groupBy("members", "name1", "name2", F.col("at.node").alias("node")).agg(F.min(F.struct(F.col("at.pos").alias("pos"), "token")).alias("first")).select("first.token")


def _pairs(rows: DataFrame) -> DataFrame:
    """Unordered pairs (a > b), once each."""
    return rows.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def _classes(docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, row, set) and their sets' components (set, root)."""
    both = scratch.written(_sketches(docs, size), "near-rows")
    rows = both.where("row is not null")
    known = both.where("row is null").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(KNOWN).toArrow()
    nodes = scratch.written(rows.groupBy("set").agg(F.min("row").alias("node"), F.min("fp").alias("fp"), F.count(F.lit(1)).alias("rows")), "near-nodes")
    texts = rows.select("row", F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"))
    again = scratch.written(rows.join(nodes.where("rows > 1").select("set", "node"), "set").where("row != node").select("row"), "near-again")
    order = Order(known["token"].to_numpy(), known["times"].to_numpy())
    table, shared, order = _index(texts.join(few(again), "row", "left_anti"), order, size, similarity)
    met = scratch.written(table.join(shared, "token", "left_semi"), "near-met")
    scratch.drop(table)
    scratch.release(docs.sparkSession)
    scratch.shrink(docs.sparkSession)
    heads = met.groupBy("token").agg(F.min(F.struct("pos", "node", "n")).alias("head"), F.count(F.lit(1)).alias("members"))
    heads = scratch.written(heads.select("token", "members", F.col("head.node").alias("b"), F.col("head.n").alias("bn"), F.col("head.pos").alias("bp")), "near-heads")
    fitting = met.join(heads, "token").where(_possible(F.col("n"), F.col("pos"), F.col("bn"), F.col("bp"), similarity))
    fps = scratch.written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-fps")
    near = links(fps.select("fp")).join(fps.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(fps.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    alike = nodes.join(fps.withColumnRenamed("node", "first"), "fp")
    pairs = fitting.select(F.col("node").alias("a"), "b").unionByName(near.select(F.col("na").alias("a"), F.col("nb").alias("b"))).unionByName(alike.select(F.col("node").alias("a"), F.col("first").alias("b")))
    tried = scratch.written(_pairs(pairs), "near-tried")
    found = _verified(tried, texts, order, size, similarity)
    table, most = scratch.written(met.join(_distinct_buckets(met, heads), "token", "left_semi"), "near-table"), TRIED
    while True:
        roots = scratch.written(components(found), "near-roots")
        if table.isEmpty():
            break
        live = scratch.written(table.join(roots, table["node"] == roots["node"], "left").select("token", table["node"], "n", "pos", F.coalesce("root", table["node"]).alias("root")), "near-live")
        new = scratch.written(_meetings(live, most, similarity), "near-meetings")
        pairs = scratch.written(_pairs(new).join(tried, ["a", "b"], "left_anti"), "near-tried")
        table = scratch.written(table.join(new.where("more").select("token").distinct(), "token", "left_semi"), "near-table")
        if not pairs.isEmpty():
            found = found.unionByName(_verified(pairs, texts, order, size, similarity))
            tried = tried.unionByName(pairs)
        elif table.isEmpty():
            break
        most *= GROWTH
    named = nodes.select("set", "node").join(roots, "node", "left").select("set", F.coalesce("root", "node").alias("root"))
    return rows, scratch.written(named, "near-classes")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Return doc_id, component_id (smallest doc_id that links reach) for each row.

    Texts link whose sets of `size`-word shingles (XXH64 of words, A-Z lower-cased) have at least
    the Jaccard similarity.  Texts without words are alike; one with fewer words than `size` has
    one shingle.  Null counts as empty.  A null doc_id is never smallest unless alone (then null).
    Repeated rows are alike.  No rows: an empty result.  Other columns are ignored.
    """
    rows, classes = _classes(docs.select("doc_id", "text"), size, similarity)
    own = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "set")
    ids = own.groupBy("set").agg(F.min("doc_id").alias("least")).join(classes, "set").groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(classes.join(ids, "root").select("set", "component_id"), "set").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Return the rows of `docs` that stay, with all their columns: of each group of `similar_groups`
    the one with the smallest doc_id (a null one comes last; of equal ids one row stays)."""
    rows, classes = _classes(docs, size, similarity)
    key = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")
    best = rows.groupBy("set").agg(F.min(key).alias("best")).join(classes, "set").groupBy("root").agg(F.min("best").alias("best"))
    stays = scratch.written(best.select(F.col("best.row").alias("row")), "near-stays")
    gone = scratch.written(rows.select("row").join(stays, "row", "left_anti"), "near-gone")
    return rows.join(few(gone), "row", "left_anti").select("doc.*")
