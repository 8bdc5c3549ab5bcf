"""Nearest neighbours by randomly rotated one-bit codes.

A vector's offset from the centroid is rotated (sign flips and Hadamard transforms) and kept as
sign bits with two scalars: its norm and its inner product with the code.  A query's offset is
rotated too and rounded to `PLANES` bit planes.  Counts of common bits and the scalars estimate
distances, with an error bound.  A first search takes each query's nearest by estimate and
compares these in full: the k-th distance is the limit.  A second one finds every vector whose
lower bound reaches the limit, and only these are fetched and compared in full, in double precision.

The bound allows for `EPSILON` standard errors.  `exact` puts the largest possible error in its
place, which prunes less and loses nothing.

Scale: the index is one map-side pass.  Codes lie in groups of about `CODES` rows, queries in
blocks of about `QUERIES`; a task holds a group's codes and a block, never vectors but those asked
for.  Queries are all rows with a divisible id, in blocks against all codes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import scratch

#: Codes of a group, queries of a block, and vectors compared in full at once.
CODES, QUERIES, FULL = 1 << 15, 1 << 10, 1 << 13
#: Bits that a query's components are rounded to, and standard errors that the bound allows for.
PLANES, EPSILON = 6, 3.0
#: Vectors whose mean is the centroid, about; only the `CENTRED` most frequent lengths have one, others the origin.
SAMPLE, CENTRED = 20_000, 64
#: Rows of a tile of codes.
TILE = 2048
#: At most so many bytes of small tables are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 4 << 20


def few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if scratch.size(table) <= BROADCAST_BYTES else table


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector that isn't zero: uid, vec_id, d (its length), embedding."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e).where("vec_id is not null and embedding is not null")
    rows = rows.where(~bad & F.exists(e, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.size(e).alias("d"), "embedding")


@functools.lru_cache(maxsize=64)
def _flips(width: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, width)).choice((-1.0, 1.0), (3, width))


def width(d: int) -> int:
    """Length of a rotated vector: the power of two from 64 on that holds it."""
    return max(64, 1 << max(d - 1, 0).bit_length())


def rotated(rows: np.ndarray, seed: int = 1) -> np.ndarray:
    """Rows filled up to `width` and turned; lengths and angles stay."""
    n, d = rows.shape
    w = width(d)
    out = np.zeros((n, w))
    out[:, :d] = rows
    for signs in _flips(w, seed):
        out *= signs
        h = 1
        while h < w:
            pairs = out.reshape(n, w // (2 * h), 2, h)
            out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, w)
            h *= 2
        out /= np.sqrt(w)
    return out


def matrix(column) -> np.ndarray:
    """A list column whose rows have one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def offset(centroids: dict[int, np.ndarray], column, d: int) -> np.ndarray:
    rows = matrix(column)
    return rows - centroids[d] if d in centroids else rows


def coded(offsets: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64 bits a word), norms, and inner products of unit offsets with their codes."""
    turned = rotated(offsets, seed)
    norm = np.sqrt((turned * turned).sum(axis=1))
    fit = np.abs(turned).sum(axis=1) / (np.sqrt(turned.shape[1]) * np.where(norm > 0, norm, 1))
    return np.packbits(turned > 0, axis=1, bitorder="little").view("<u8"), norm, np.where(norm > 0, fit, 1.0)


class Asked:
    """A block of queries: their rotated offsets in bit planes."""

    def __init__(self, offsets: np.ndarray, seed: int = 1):
        turned = rotated(offsets, seed)
        self.norm = np.sqrt((turned * turned).sum(axis=1))
        unit = turned / np.where(self.norm > 0, self.norm, 1)[:, None]
        self.low = unit.min(axis=1)
        self.step = np.maximum((unit.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-30)
        whole = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.planes = [np.packbits(whole >> p & 1, axis=1, bitorder="little").view("<u8") for p in range(PLANES)]
        self.sum = whole.sum(axis=1, dtype=np.int64)

    def distances(self, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances of codes (rows) and queries, and how far they may be too large."""
        w = codes.shape[1] * 64
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        common = np.zeros((len(codes), len(self.norm)), dtype=np.int32)
        for p, plane in enumerate(self.planes):
            for j in range(codes.shape[1]):
                common += np.bitwise_count(codes[:, j, None] & plane[None, :, j]).astype(np.int32) << p
        dot = self.step * (2 * common - self.sum) + self.low * (2 * ones[:, None] - w)
        inner = dot / np.sqrt(w) / fit[:, None]
        if exact:
            error = np.sqrt(np.maximum(1 - fit * fit, 0))[:, None] + self.step * np.sqrt(w) / 2
        else:
            error = EPSILON * np.sqrt(np.maximum(1 - fit * fit, 0)[:, None] / (w - 1) + self.step**2 / 12)
        both = 2 * norm[:, None] * self.norm
        return norm[:, None] ** 2 + self.norm**2 - both * inner, both * (error / fit[:, None] + 1e-9)


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, summed in order of components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        diff = a[:, j] - b[:, j]
        total += diff * diff
    return np.sqrt(total)


def _best(query: np.ndarray, vec: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Which of the (query, vec, dist) are among their query's k nearest, ties to the smaller vec."""
    order = np.lexsort((vec, dist, query))
    q = query[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, dtype=int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


class _Search:
    """Tables of one search: vectors, codes in groups and queries in blocks."""

    def __init__(self, vectors: DataFrame, every: int, k: int, seed: int, exact: bool):
        self.k, self.seed, self.exact = k, seed, exact
        self.vectors = scratch.written(usable(vectors), "ann-vectors")
        asked = self.vectors.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
        asked = asked.withColumn("d", F.size("embedding"))
        parts = self.vectors.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / CODES).alias("groups"), F.count(F.lit(1)).alias("n"))
        parts = parts.join(asked.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("blocks")), "d", "left")
        self.parts = scratch.written(parts, "ann-parts")  # a row for each length
        asked = asked.join(few(self.parts), "d").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
        order = Window.partitionBy("d", "block").orderBy("query_id")
        self.queries = scratch.written(asked.select("d", "block", F.row_number().over(order).alias("at"), "query_id", "embedding"), "ann-queries")
        self.centroids = self._centroids()
        self.codes = scratch.written(self._index(), "ann-codes")

    def _centroids(self) -> dict[int, np.ndarray]:
        most = self.parts.orderBy(F.desc("n"), "d").limit(CENTRED)
        draw = F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) / (1 << 30)
        some = self.vectors.join(F.broadcast(most.select("d", "n")), "d").where(draw < SAMPLE / F.col("n"))
        means = some.select("d", F.posexplode("embedding")).groupBy("d", "pos").agg(F.avg("col").alias("mean")).collect()  # as many as the lengths' components
        out: dict[int, np.ndarray] = {}
        for d, pos, mean in means:
            out.setdefault(d, np.zeros(d))[pos] = mean
        return out

    def _index(self) -> DataFrame:
        kinds = {"d": pa.int32(), "grp": pa.int64(), "uid": pa.int64(), "vec_id": pa.int64(), "code": pa.binary(), "norm": pa.float64(), "fit": pa.float64()}
        offsets, seed = functools.partial(offset, self.centroids), self.seed

        def run(batches):
            for batch in batches:
                of = batch.column(0).to_numpy()
                for d in np.unique(of).tolist():
                    own = batch.filter(pa.array(of == d))
                    for at in range(0, own.num_rows, TILE):
                        part = own.slice(at, TILE)
                        codes, norm, fit = coded(offsets(part.column(4), d), seed)
                        arrays = [*part.columns[:4], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit)]
                        yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(list(kinds.items())))

        rows = self.vectors.join(few(self.parts.where("blocks is not null")), "d").select("d", F.pmod(F.xxhash64("uid"), "groups").alias("grp"), "uid", "vec_id", "embedding")
        return rows.mapInArrow(scratch.tidied(run), "d int, grp long, uid long, vec_id long, code binary, norm double, fit double")

    def cells(self, queries: DataFrame, run, ddl: str) -> DataFrame:
        """Bring each group of codes and each block of queries (d, block, at, query_id, embedding, ...) together."""
        parts = few(self.parts.where("blocks is not null").select("d", "groups", "blocks"))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = self.codes.join(parts, "d").withColumn("block", upto("blocks")).select("d", "grp", "block", "uid", "vec_id", "code", "norm", "fit")
        right = queries.join(parts, "d").withColumn("grp", upto("groups")).drop("groups", "blocks")
        key = ["d", "grp", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, ddl)

    def near(self) -> DataFrame:
        """Each group's 2 k nearest of each query, by estimate: d, block, at, uid, about."""
        offsets, seed, exact, most = functools.partial(offset, self.centroids), self.seed, self.exact, 2 * self.k

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            none = np.zeros(0, dtype=np.int64)
            best = (none, none, np.zeros(0))
            if left.num_rows and right.num_rows:
                d = right["d"][0].as_py()
                asked, ids = Asked(offsets(right["embedding"], d), seed), right["query_id"].to_numpy()
                for vec, uid, codes, norm, fit in _tiles(left):
                    about, _ = asked.distances(codes, norm, fit, exact)
                    about[vec[:, None] == ids[None, :]] = np.inf
                    first = np.argpartition(about, min(most, len(vec)) - 1, axis=0)[:most]
                    q = np.tile(np.arange(len(ids)), len(first))
                    value = about[first.ravel(), q]
                    new = [np.concatenate(x) for x in zip(best, (q, uid[first.ravel()], value), strict=True)]
                    new = [x[np.isfinite(new[2])] for x in new]
                    top = _best(*new, most)
                    best = tuple(x[top] for x in new)
            at = right["at"].to_numpy()[best[0]] if len(best[0]) else none
            d, block = (right[c][0].as_py() if right.num_rows else 0 for c in ("d", "block"))
            return pa.table({"d": pa.array(np.full(len(at), d), pa.int32()), "block": pa.array(np.full(len(at), block), pa.int64()), "at": pa.array(at, pa.int32()), "uid": pa.array(best[1], pa.int64()), "about": pa.array(best[2])})

        found = self.cells(self.queries, run, "d int, block long, at int, uid long, about double")
        order = Window.partitionBy("d", "block", "at").orderBy("about", "uid")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place", "about")

    def reached(self, limits: DataFrame) -> DataFrame:
        """All vectors whose lower bound reaches their query's limit: d, block, uid, ats (the queries)."""
        offsets, seed, exact = functools.partial(offset, self.centroids), self.seed, self.exact

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            uids, lists = [], []
            if left.num_rows and right.num_rows:
                asked, ids = Asked(offsets(right["embedding"], right["d"][0].as_py()), seed), right["query_id"].to_numpy()
                limit, at = right["limit"].to_numpy(), right["at"].to_numpy()
                for vec, uid, codes, norm, fit in _tiles(left):
                    about, error = asked.distances(codes, norm, fit, exact)
                    good = (about - error <= limit**2 * (1 + 1e-9)) & (vec[:, None] != ids[None, :])
                    for i in np.flatnonzero(good.any(axis=1)):
                        uids.append(uid[i])
                        lists.append(at[good[i]])
            d, block = (right[c][0].as_py() if right.num_rows else 0 for c in ("d", "block"))
            return pa.table({"d": pa.array([d] * len(uids), pa.int32()), "block": pa.array([block] * len(uids), pa.int64()), "uid": pa.array(uids, pa.int64()), "ats": pa.array(lists, pa.list_(pa.int32()))})

        asked = self.queries.join(limits, ["d", "block", "at"], "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        return self.cells(asked, run, "d int, block long, uid long, ats array<int>")

    def compared(self, found: DataFrame) -> DataFrame:
        """Full distances of found vectors (d, block, uid, ats): each query's k nearest as query_id, vec_id, score, d, block, at."""
        k = self.k
        counts = found.groupBy("d", "block").agg(F.ceil(F.count(F.lit(1)) / FULL).alias("parts"))
        counts = scratch.written(counts, "ann-full")
        rows = found.join(few(counts), ["d", "block"]).withColumn("part", F.pmod(F.xxhash64("uid"), "parts")).drop("parts")
        rows = rows.join(self.vectors.select("uid", "vec_id", "embedding"), "uid")
        asked = self.queries.join(few(counts), ["d", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            if left.num_rows and right.num_rows:
                place = np.zeros(max(right["at"].to_pylist()) + 1, dtype=np.int64)
                place[right["at"].to_numpy()] = np.arange(right.num_rows)
                queries = matrix(right["embedding"])
                for at in range(0, left.num_rows, TILE):
                    part = left.slice(at, TILE).combine_chunks()
                    ats, vec, full = part["ats"].combine_chunks(), part["vec_id"].to_numpy(), matrix(part["embedding"])
                    v = np.repeat(np.arange(len(vec)), np.diff(np.asarray(ats.offsets)))
                    q = place[np.asarray(ats.flatten())]
                    for s in range(0, len(v), 200_000):
                        a, b = v[s : s + 200_000], q[s : s + 200_000]
                        new = tuple(np.concatenate(x) for x in zip(best, (b, vec[a], lengths(full[a], queries[b])), strict=True))
                        top = _best(*new, k)
                        best = tuple(x[top] for x in new)
            own = right.take(pa.array(best[0])) if right.num_rows else right
            return pa.table({"query_id": own["query_id"], "vec_id": pa.array(best[1], pa.int64()), "score": pa.array(best[2]), "d": own["d"], "block": own["block"], "at": own["at"]})

        key = ["d", "block", "part"]
        ddl = "query_id long, vec_id long, score double, d int, block long, at int"
        return rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, ddl)


def _tiles(left: pa.Table):
    vec, uid, norm, fit = (left[c].to_numpy() for c in ("vec_id", "uid", "norm", "fit"))
    codes = np.frombuffer(b"".join(left["code"].to_pylist()), dtype="<u8").reshape(len(vec), -1)
    for at in range(0, len(vec), TILE):
        own = slice(at, at + TILE)
        yield vec[own], uid[own], codes[own], norm[own], fit[own]


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, seed: int = 1, exact: bool = False) -> DataFrame:
    """Return query_id, rank (from 1), vec_id, score for rows whose vec_id is divisible by `every`.

    Vectors that are null, zero, not finite in some component or without an id take no part; one is
    near only to queries of its own length.  Ties go to the smaller vec_id; a vec_id is never its own
    neighbour; rows with a repeated vec_id are neighbours each, of those with a query's id the least
    vector is asked.  No rows: an empty result.  Other columns are ignored.
    """
    search = _Search(vectors, every, k, seed, exact)
    if search.queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = search.near().groupBy("d", "block", "uid").agg(F.collect_list("at").alias("ats"))
    first = ranked(search.compared(scratch.written(near, "ann-near")), k)
    limits = first.where(F.col("rank") == k).select("d", "block", "at", F.col("score").alias("limit"))
    reached = scratch.written(search.reached(scratch.written(limits, "ann-limits")), "ann-reached")
    found = search.compared(reached)
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")
