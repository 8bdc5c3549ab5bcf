"""Substring dedup by recompression.

A window is `WINDOW` consecutive words; a word goes when a window that covers it also starts in
a document with a smaller doc_id.  Rounds name runs of one symbol and pairs (a left symbol before
a right one, sides by a bit of the name).  A symbol's name comes from its words alone, so it is
the same everywhere; where it begins and ends depends on the symbols beside it, so equal
substrings have the same symbols but near their ends.

Spark finds repeats from long symbols to short ones, each time by the least document of a name:
1. whole sequences, the top symbols: a document that repeats a smaller one's goes as a whole;
2. symbols of `HIGH` rounds (about twenty words) that a smaller document has;
3. windows.  Every window takes as its mark the least name of a symbol of `LOW` rounds inside it,
   with the words that it depends on (or its own name where there is none, as in long runs).
   Marks that one document alone has say that their windows do not repeat; windows of shared
   marks are named and compared, but for those inside a long symbol that goes.

What goes is joined into segments, each with the place in a smaller document that it repeats, and
verified: both places' words must have the same SHA-256.  If any differ, two words or sequences
have shared a name, and all is done again with names of another seed.  So the result is exact.

Scale: about a fifth of the words' number in marks is shuffled once and combined map-side; all
later exchanges hold shared marks and windows, and texts three times.  Names meet their counts in
equi-joins of written tables, which adaptive execution splits where a name is common.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import scratch
from tidewell.llm.words import ONE, TWO, chained, digest, mix, named, proof, summed, sums

WINDOW = 13
Naming = Callable[[bytes, int], int]
#: Rounds of the symbols inside windows, and of long symbols.
LOW, HIGH = 2, 10
GROUP_BYTES = 2_000_000
SEEDS = range(8)
#: At most so many bytes of repeated ids are broadcast; beyond that a shuffled join is used.
BROADCAST_BYTES = 4 << 20


def _cut(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a symbol starts: neither a run goes on nor a left symbol meets a right one."""
    right = mix(names ^ ONE) >> np.uint64(63) == 1
    starts = np.ones(len(names), dtype=bool)
    starts[1:] = (names[1:] != names[:-1]) & ~(~right[:-1] & right[1:])
    starts[first] = True
    return starts


def symbols(names: np.ndarray, bounds: np.ndarray, rounds: int) -> list[np.ndarray]:
    """Where the symbols of each round start, from the words on; the end is added."""
    one = sums(names, ONE)
    first = bounds[:-1][np.diff(bounds) > 0]
    levels = [np.arange(len(names) + 1)]
    for _ in range(rounds):
        at = levels[-1]
        own = names if len(levels) == 1 else summed(one, ONE, at[:-1], at[1:])
        starts = _cut(own, np.searchsorted(at, first))
        levels.append(np.append(at[:-1][starts], at[-1]))
    return levels


def marks(names: np.ndarray, bounds: np.ndarray, window: int = WINDOW, levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window: the text it is in, its first word and its mark; `levels` are the first rounds' symbols, if known."""
    counts = np.maximum(np.diff(bounds) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][text]
    if not len(at):
        return text, at, np.zeros(0, dtype=np.uint64)
    one = sums(names, ONE)
    levels = levels or symbols(names, bounds, LOW)
    starts, ends = levels[-1][:-1], levels[-1][1:]
    # What a symbol's ends depend on: a symbol of each round before on either side.
    a, b = starts.copy(), ends.copy()
    of = np.searchsorted(bounds, starts, side="right") - 1
    good = np.ones(len(starts), dtype=bool)
    for level in reversed(levels[:-1]):
        left, right = np.searchsorted(level, a, side="right") - 2, np.searchsorted(level, b, side="left") + 1
        good &= (left >= 0) & (right < len(level))
        a, b = level[np.maximum(left, 0)], level[np.minimum(right, len(level) - 1)]
    good &= (a >= bounds[of]) & (b <= bounds[of + 1])
    a, b = a[good], b[good]
    keys = summed(one, ONE, a, b)
    # How many start before a window and end by its end, counted by place, which costs less than a search for each window.
    lo, hi = np.cumsum(np.bincount(a + 1, minlength=len(names) + 2))[at], np.cumsum(np.bincount(b, minlength=len(names) + 1))[at + window]
    out = mix(summed(one, ONE, at, at + window) ^ TWO)
    some = np.flatnonzero(lo < hi)
    if len(some):
        low, high = lo[some], hi[some]
        best = keys[low]
        for k in range(1, int((high - low).max())):
            more = low + k < high
            best[more] = np.minimum(best[more], keys[low[more] + k])
        out[some] = best
    return text, at - bounds[text], out


def _groups(batches: Iterator[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text, the third column."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def _mapped(rows: DataFrame, run: Callable[[pa.RecordBatch], dict], ddl: str) -> DataFrame:
    """Map slices of rows (doc_id, tag, text, ...)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            yield pa.RecordBatch.from_pydict(run(part))

    return rows.mapInArrow(scratch.tidied(each), ddl)


def _tagged(docs: DataFrame, again: DataFrame | None) -> DataFrame:
    """doc_id, tag and text: the tag is 0, but for repeated ids (`again`) a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tag = F.lit(0).cast("long")
    if again is not None:
        rows = rows.join(F.broadcast(again) if scratch.size(again) <= BROADCAST_BYTES else again, "doc_id", "left")
        tag = F.when(F.col("again"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)
    return rows.select("doc_id", tag.alias("tag"), "text")


def _rows(docs: DataFrame, again: DataFrame | None) -> DataFrame:
    """The same for rows that have a doc_id, with bytes of text; null counts as empty."""
    return _tagged(docs, again).where("doc_id is not null").select("doc_id", "tag", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))


def _of(part: pa.RecordBatch, at: np.ndarray) -> dict:
    at = pa.array(at, pa.int64())
    return {"doc_id": part.column(0).take(at), "tag": part.column(1).take(at)}


def _symbols(rows: DataFrame, window: int, seed: int, name: Naming | None) -> DataFrame:
    """Each row's marks (h1; h2 null); its long symbols and its whole sequence (h1, h2 with at and n)."""
    def run(part: pa.RecordBatch) -> dict:
        names, bounds = named(part.column(2).to_pylist(), seed, name)
        levels = symbols(names, bounds, HIGH)
        text, _, mark = marks(names, bounds, window, levels[: LOW + 1])
        for _ in range(2):  # neighbours mostly have one mark; what is left is sorted
            new = np.ones(len(mark), dtype=bool)
            new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
            text, mark = text[new], mark[new]
            order = np.lexsort((mark, text))
            text, mark = text[order], mark[order]
        cuts = levels[-1]
        long = np.flatnonzero(np.diff(cuts) >= window)
        whole = np.flatnonzero(np.diff(bounds) >= window)
        starts, ends = np.concatenate((cuts[long], bounds[whole])), np.concatenate((cuts[long + 1], bounds[whole + 1]))
        of = np.concatenate((np.searchsorted(bounds, cuts[long], side="right") - 1, whole))
        own = np.array([digest(names[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=np.int64).reshape(-1, 2)
        none = pa.nulls(len(mark), pa.int64())
        return {
            "h1": pa.array(np.concatenate((mark.view(np.int64), own[:, 0]))),
            "h2": pa.concat_arrays([none, pa.array(own[:, 1])]),
            **_of(part, np.concatenate((text, of))),
            "at": pa.concat_arrays([none.cast(pa.int32()), pa.array((starts - bounds[of]).astype(np.int32))]),
            "n": pa.concat_arrays([none.cast(pa.int32()), pa.array((ends - starts).astype(np.int32))]),
        }

    return _mapped(rows, run, "h1 long, h2 long, doc_id long, tag long, at int, n int")


def _windows(rows: DataFrame, window: int, seed: int, name: Naming | None) -> DataFrame:
    """Windows of rows (doc_id, tag, text, marks, gone) that have one of the marks and aren't inside what goes: h1, h2, doc_id, tag, at."""
    def run(part: pa.RecordBatch) -> dict:
        names, bounds = named(part.column(2).to_pylist(), seed, name)
        text, at, mark = marks(names, bounds, window)
        lists = part.column(3)
        own = np.asarray(lists.flatten()).view(np.uint64)
        of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        # Join (text, mark) with the lists by one sorted array of mixed pairs, neighbours of one mark at once.
        pair = lambda t, m: mix(m ^ mix(t.astype(np.uint64) + ONE))
        new = np.ones(len(mark), dtype=bool)
        new[1:] = (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])
        keep = np.isin(pair(text[new], mark[new]), pair(of, own))[np.cumsum(new) - 1]
        # A window inside a symbol that goes ends where no more is covered than the window itself.
        cover = np.zeros(len(names) + 1, dtype=np.int64)
        for i, spans in enumerate(part.column(4)):
            for s in spans.as_py() or ():
                first = bounds[i] + s["at"]
                cover[first] += 1
                cover[first + s["n"] - window + 1] -= 1
        start = bounds[text] + at
        keep &= np.cumsum(cover)[start] == 0
        text, at, start = text[keep], at[keep], start[keep]
        h1, h2 = (chained(names, start, window, base).view(np.int64) for base in (ONE, TWO))
        return {"h1": pa.array(h1), "h2": pa.array(h2), **_of(part, text), "at": pa.array(at, pa.int32())}

    return _mapped(rows, run, "h1 long, h2 long, doc_id long, tag long, at int")


def _gone(places: DataFrame, what: str, n: Column, tagged: bool) -> DataFrame:
    """Of named places those whose name a smaller document has, with a place there: l_id, l_tag, l_at.
    Without `tagged` all tags are 0."""
    tag = F.min_by("tag", "doc_id") if tagged else F.lit(0).cast("long")
    low = places.groupBy("h1", "h2").agg(F.min("doc_id").alias("l_id"), F.max("doc_id").alias("high"), tag.alias("l_tag"), F.min_by("at", "doc_id").alias("l_at"))
    low = scratch.written(low.where("l_id < high").drop("high"), f"repeats-{what}-low")
    scratch.release(places.sparkSession)
    found = places.join(low, ["h1", "h2"]).where("l_id < doc_id").select("doc_id", "tag", "at", n.alias("n"), "l_id", "l_tag", "l_at")
    return scratch.written(found, f"repeats-{what}-gone")


def _segments(gone: DataFrame) -> DataFrame:
    """Places that go, joined where they follow or overlap each other and repeat the same stretch."""
    place = F.struct("l_id", "l_tag", (F.col("at") - F.col("l_at")).alias("by"), "at", "n")
    rows = gone.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(place)).alias("places"))  # as many as the text has words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            of = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            l_id, l_tag, by, at, n = (np.asarray(c) for c in lists.flatten().flatten())
            if not len(of):
                continue
            same = np.zeros(len(of), dtype=bool)
            same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in (of, l_id, l_tag, by)])
            # Ends grow with starts but for long symbols, which hold what starts inside them.
            first = np.flatnonzero(~same)
            group = np.cumsum(~same) - 1
            shift = group * (int((at + n).max()) + 1)
            reach = np.maximum.accumulate(at + n + shift) - shift
            new = ~same
            new[1:] |= at[1:] > reach[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(of)) - 1
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0).take(pa.array(of[first])),
                    "tag": batch.column(1).take(pa.array(of[first])),
                    "at": pa.array(at[first]),
                    "n": pa.array((reach[last] - at[first]).astype(np.int32)),
                    "l_id": pa.array(l_id[first]),
                    "l_tag": pa.array(l_tag[first]),
                    "l_at": pa.array((at - by)[first].astype(np.int32)),
                }
            )

    return rows.mapInArrow(scratch.tidied(run), "doc_id long, tag long, at int, n int, l_id long, l_tag long, l_at int")


def _false(segments: DataFrame, rows: DataFrame) -> bool:
    """Whether words of a segment differ from those at the place that it is said to repeat."""
    own = segments.select("doc_id", "tag", "at", "n")
    asked = own.unionByName(segments.select(F.col("l_id").alias("doc_id"), F.col("l_tag").alias("tag"), F.col("l_at").alias("at"), "n")).distinct()
    asked = scratch.written(asked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "repeats-asked")

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"at": [], "n": [], "proof": []}
        of = []
        for i, (text, spans) in enumerate(zip(part.column(2), part.column(3), strict=True)):
            words = text.as_py().split()
            for s in spans.as_py():
                of.append(i)
                out["at"].append(s["at"])
                out["n"].append(s["n"])
                out["proof"].append(proof(words[s["at"] : s["at"] + s["n"]]))
        ints = {k: pa.array(out[k], pa.int32()) for k in ("at", "n")}
        return {**_of(part, np.array(of, dtype=np.int64)), **ints, "proof": pa.array(out["proof"], pa.binary())}

    rows = rows.join(asked, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
    proofs = scratch.written(_mapped(rows, run, "doc_id long, tag long, at int, n int, proof binary").distinct(), "repeats-proofs")
    there = proofs.select(F.col("doc_id").alias("l_id"), F.col("tag").alias("l_tag"), F.col("at").alias("l_at"), "n", F.col("proof").alias("wanted"))
    both = segments.join(proofs, ["doc_id", "tag", "at", "n"]).join(there, ["l_id", "l_tag", "l_at", "n"])
    return not both.where("proof != wanted").isEmpty()


def _repeats(rows: DataFrame, window: int, seed: int, name: Naming | None, tagged: bool) -> DataFrame:
    """Segments that go, not yet verified: doc_id, tag, at, n, l_id, l_tag, l_at."""
    spark = rows.sparkSession
    own_names = scratch.written(_symbols(rows, window, seed, name), "repeats-symbols")
    long = _gone(own_names.where("h2 is not null"), "long", F.col("n"), tagged)
    # A symbol that is the whole text is in the table twice, as a row of equal texts is.
    sizes = own_names.where("h2 is not null").groupBy("doc_id", "tag").agg(F.max("n").alias("size"))
    copies = scratch.written(long.where("at = 0").join(sizes, ["doc_id", "tag"]).where("n = size").select("doc_id", "tag").distinct(), "repeats-copies")
    own = own_names.where("h2 is null").select(F.col("h1").alias("mark"), "doc_id", "tag")
    shared = own.groupBy("mark").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("mark")
    shared = scratch.written(shared, "repeats-shared")
    scratch.release(spark)
    lists = own.join(shared, "mark", "left_semi").groupBy("doc_id", "tag").agg(F.collect_set("mark").alias("marks"))
    inside = long.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    lists = scratch.written(lists.join(copies, ["doc_id", "tag"], "left_anti").join(inside, ["doc_id", "tag"], "left"), "repeats-lists")
    scratch.drop(own_names)
    scratch.release(spark)
    windows = scratch.written(_windows(rows.join(lists, ["doc_id", "tag"]).select("doc_id", "tag", "text", "marks", "gone"), window, seed, name), "repeats-windows")
    scratch.drop(lists)
    scratch.release(spark)
    short = _gone(windows, "short", F.lit(window), tagged)
    scratch.drop(windows)
    scratch.release(spark)
    # Of a whole copy its longest symbol says all.
    whole = long.join(copies, ["doc_id", "tag"], "left_semi").where("at = 0").groupBy("doc_id", "tag").agg(F.max(F.struct("n", "l_id", "l_tag", "l_at")).alias("s"))
    whole = whole.select("doc_id", "tag", F.lit(0).alias("at"), "s.*").select(*long.columns)
    rest = long.join(copies, ["doc_id", "tag"], "left_anti").unionByName(short)
    return scratch.written(_segments(rest).select(*long.columns).unionByName(whole), "repeats-segments")


def _kept(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if spans.is_valid and len(spans):
                    gone = np.zeros(len(words) + 1, dtype=np.int64)
                    at, n = (np.asarray(c) for c in spans.values.flatten())
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n, -1)
                    words = [w for w, g in zip(words, (np.cumsum(gone) > 0).tolist(), strict=False) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "text": pa.array(kept, pa.binary()).cast(pa.string())}
            )

    return texts.mapInArrow(scratch.tidied(run), "doc_id long, n_words long, n_removed long, text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, name: Naming | None = None) -> DataFrame:
    """Return doc_id, n_words, n_removed, text (kept words joined by one space) for each row.

    Null and empty texts have no words; texts shorter than a window lose none.  A null
    doc_id is neither smaller nor larger than any, so its row stays whole.  Rows with the
    same doc_id are one document: none of them is smaller than another.  No rows: an empty
    result.  Other columns are ignored.  `name` gives a word's 64-bit name for a seed, if not the usual one.
    """
    spark = docs.sparkSession
    again = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and doc_id is not null")
    again = scratch.written(again.select("doc_id", F.lit(True).alias("again")), "repeats-again")
    again = None if again.isEmpty() else again
    rows = _rows(docs, again)
    for seed in SEEDS:
        segments = _repeats(rows, window, seed, name, again is not None)
        false = _false(segments, rows)
        scratch.release(spark)
        if not false:
            break
    else:
        raise RuntimeError("words share names under every seed")
    gone = scratch.written(segments.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "n")).alias("spans")), "repeats-gone")
    return _kept(_tagged(docs, again).join(gone, ["doc_id", "tag"], "left").select("doc_id", "text", "spans"))
