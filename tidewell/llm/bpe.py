"""Byte-level BPE by prefix dynamic programming.

For each prefix of a pre-token's bytes exactly one vocabulary token can end the
prefix's encoding: the one that, next to the last token of the shorter prefix before
it, would survive as a pair.  Storing that token for each prefix makes appends exact
and cheap, and an edit re-encodes from the edited byte on.  `Prefixes` holds one pre-token's;
`Batch` finds those of many at once, prefixes of one length after those of the length before.

Scale: one map-side pass without an exchange.  Caches hold a bounded number of short strings, and
a group of texts is coded at once whose size is bounded but for one long text.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.chunks import cut

#: Pre-tokens of at most so many bytes are coded together, at most so many at once.
SHORT, AT_ONCE = 128, 20_000
_coders: dict[tuple[str, str], "Coder"] = {}


class Vocabulary:
    """Ranks of byte strings and the pair that each token was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.tokens[i] = b
        self.pairs = [self._pair(i) for i in range(len(self.tokens))]
        #: Tokens that merges can lead to, with their length.
        self.reached = {b: i for b, i in ranks.items() if self.pairs[i]}
        #: The longest of them by their last three bytes.
        self.tails: dict[bytes, int] = {}
        for b in sorted(self.reached, key=len):
            self.tails[b[-3:]] = len(b)
        #: Pairs judged by `valid`, as one number.
        self.known: dict[int, bool] = {}

    def _pair(self, token: int) -> tuple[int, int] | None:
        """The last merge inside a token; a byte's is itself twice; None if no merges lead to it."""
        raw, ranks = self.tokens[token], self.ranks
        if len(raw) < 2:
            return (token, token) if raw else None
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1))
            if rank >= token:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        left, right = (ranks.get(p) for p in parts)
        return None if left is None or right is None else (left, right)

    def valid(self, left: int, right: int) -> bool:
        """Whether merging would leave these two tokens side by side."""
        if len(self.known) > 1_000_000:
            self.known.clear()
        fits = self.known[left << 32 | right] = self._undo(left, right)
        return fits

    def _undo(self, left: int, right: int) -> bool:
        # A pair that is a token itself would have merged.  Undo merges, latest first; a merge across the border ranked before the undone one would have come first.
        get, tokens, pairs, limit = self.ranks.get, self.tokens, self.pairs, len(self.tokens)
        while True:
            if get(tokens[left] + tokens[right], limit) < limit:
                return False
            whole_left, whole_right = len(tokens[left]) > 1, len(tokens[right]) > 1
            if whole_left and (left > right or not whole_right):
                limit, left = left, pairs[left][1]
            elif whole_right:
                limit, right = right + 1, pairs[right][0]
            else:
                return True


class Prefixes:
    """Last tokens of all prefixes of one pre-token's bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> "Prefixes":
        vocabulary, data = self.vocabulary, self.data + more
        get, tail, known, valid, last = vocabulary.reached.get, vocabulary.tails.get, vocabulary.known.get, vocabulary.valid, self.last
        for end in range(len(self.data) + 1, len(data) + 1):
            most = tail(data[end - 3 : end], 2) if end > 2 else end
            for at in range(end - most if end > most else 0, end):
                token = get(data[at:end])
                if token is None:
                    continue
                if not at:
                    last.append(token)
                    break
                before = last[at]
                fits = known(before << 32 | token)
                if valid(before, token) if fits is None else fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"the vocabulary lacks byte {data[end - 1]}")
        self.data = data
        return self

    def edit(self, at: int, removed: int, inserted: bytes) -> "Prefixes":
        """Replace bytes; prefixes before `at` stay as they are."""
        tail = inserted + self.data[at + removed :]
        self.data, self.last = self.data[:at], self.last[: at + 1]
        return self.append(tail)

    def become(self, data: bytes) -> "Prefixes":
        """Turn to other bytes, keeping what belongs to the common prefix."""
        old = self.data
        same, most = 0, min(len(old), len(data))
        while same < most and old[same] == data[same]:
            same += 1
        if same < len(old):
            self.data = data[:same]
            del self.last[same + 1 :]
        return self.append(data[same:])

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        last, names = self.last, self.vocabulary.tokens
        while end:
            token = last[end]
            out.append(token)
            end -= len(names[token])
        out.reverse()
        return out


class Batch:
    """Last tokens of all prefixes of many pre-tokens at once, which hold no byte 255 (no UTF-8 does)."""

    END = 255
    #: Slots of the cache of judged pairs, as a power of two, and the multiplier that spreads them.
    BITS, SPREAD = 19, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.lengths = np.array([len(b) for b in vocabulary.tokens], dtype=np.int64)
        self.judged = np.full(1 << self.BITS, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        # A trie of the tokens.  A node's children lie at its base plus their byte, where `check` has that base.
        children: dict[bytes, list[int]] = {}
        for b in vocabulary.reached:
            for i in range(len(b) - 1, -1, -1):
                own = children.setdefault(b[:i], [])
                if b[i] not in own:
                    own.append(b[i])
                if len(own) > 1:
                    break  # the prefix had children before, so its own prefixes know it
        size = 1 << max(12, (4 * len(children)).bit_length())
        taken, bases, at = bytearray(size + 256), {}, 1
        used = bytearray(size)
        for node in sorted(children, key=lambda n: -len(children[n])):
            while used[at] or any(taken[at + c] for c in children[node]):
                at = (at * 1_103_515_245 + 12_345) % size or 1
            bases[node], used[at] = at, 1
            for c in children[node]:
                taken[at + c] = 1
        self.check, self.next, self.token = (np.full(size + 256, x, dtype=np.int32) for x in (0, 0, -1))
        for node, own in children.items():
            base = bases[node]
            for c in own:
                if c != self.END or not node:
                    child = node + bytes((c,))
                    self.check[base + c], self.next[base + c], self.token[base + c] = base, bases.get(child, 0), vocabulary.reached.get(child, -1)
        self.root = bases.get(b"", 1)

    def _valid(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging would leave these pairs of tokens side by side."""
        pairs = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slots = pairs * self.SPREAD >> np.uint64(64 - self.BITS)
        got = self.judged[slots]
        new = np.flatnonzero(got >> np.uint64(1) != pairs)
        if len(new):
            some, of = np.unique(pairs[new], return_inverse=True)
            known, valid = self.vocabulary.known.get, self.vocabulary.valid
            fits = [valid(p >> 32, p & 0xFFFFFFFF) if (f := known(p)) is None else f for p in some.tolist()]
            judged = (some << np.uint64(1) | np.array(fits, dtype=np.uint64))[of]
            self.judged[slots[new]] = got[new] = judged
        return got & np.uint64(1) == 1

    def tokens(self, words: list[bytes]) -> list[bytes]:
        """Ids of non-empty pre-tokens as unsigned 32-bit integers."""
        data = np.frombuffer(b"\xff".join(words) + b"\xff", dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(lengths + 1) - lengths - 1
        longest_first = np.argsort(-lengths, kind="stable")
        ordered, reach = starts[longest_first], np.sort(lengths)
        last = np.full(len(data), -1, dtype=np.int32)  # of each word's prefix that ends before this byte
        for at in range(int(reach[-1])):
            here = ordered[: len(words) - int(np.searchsorted(reach, at, side="right"))] + at
            left = last[here]
            if at and int(left.min()) < 0:
                raise ValueError(f"the vocabulary lacks byte {data[here[np.argmin(left)] - 1]}")
            node = np.full(len(here), self.root, dtype=np.int32)
            while len(here):
                slot = node + data[here]
                here = here + 1
                inside = self.check[slot] == node
                token = np.where(inside, self.token[slot], -1)
                ends = np.flatnonzero(token >= 0)
                if at and len(ends):
                    ends = ends[self._valid(left[ends], token[ends])]
                last[here[ends]] = token[ends]
                node = np.where(inside, self.next[slot], 0)
                on = np.flatnonzero(node)
                here, left, node = here[on], left[on], node[on]
        # Tokens from each word's end to its start.
        of, at, counts, steps = np.arange(len(words)), starts + lengths, np.zeros(len(words), dtype=np.int64), []
        while len(of):
            token = last[at]
            if int(token.min()) < 0:
                raise ValueError(f"the vocabulary lacks byte {data[at[np.argmin(token)] - 1]}")
            steps.append((of, token))
            counts[of] += 1
            at = at - self.lengths[token]
            on = at > starts[of]
            of, at = of[on], at[on]
        bounds = np.cumsum(counts)
        ids = np.empty(int(bounds[-1]), dtype=np.uint32)
        for k, (of, token) in enumerate(steps):
            ids[bounds[of] - 1 - k] = token
        raw, ends = ids.tobytes(), (4 * bounds).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Coder:
    """Encoder and decoder for a file of ranks and a pre-token pattern.

    Ids of short pre-tokens, and of short parts between safe cuts, are kept from text to text.
    """

    def __init__(self, path: str, pattern: str, limit: int = 500_000, longest: int = 64):
        with open(path, "rb") as f:
            self.vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.pattern, self.limit, self.longest = regex.compile(pattern), limit, longest
        self.batch = Batch(self.vocabulary)
        #: Ids of pre-tokens, and of parts without their leading space.
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        #: Those kept before, at most half of `limit` and what a group adds; what is met again is kept on.
        self.former: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encode pre-tokens: short ones at once, others in order, each from the prefix that it shares with the one before."""
        names = list(words)
        raws = [w.encode() for w in names]
        whole, one = list(map(self.vocabulary.ranks.get, raws)), struct.Struct("=I").pack
        known = {w: one(t) for w, t in zip(names, whole, strict=True) if t is not None}
        short = [k for k, t in enumerate(whole) if t is None and 0 < len(raws[k]) <= SHORT]
        long = [(raws[k], names[k]) for k, t in enumerate(whole) if t is None and not 0 < len(raws[k]) <= SHORT]
        for i in range(0, len(short), AT_ONCE):
            part = short[i : i + AT_ONCE]
            known.update(zip([names[k] for k in part], self.batch.tokens([raws[k] for k in part]), strict=True))
        table = Prefixes(self.vocabulary)
        for raw, word in sorted(long):
            known[word] = array("I", table.become(raw).tokens()).tobytes()
        return known

    def _again(self, kept: dict[str, bytes], former: dict[str, bytes], new: set[str]) -> set[str]:
        """Keep on what was kept before the last change of tables; returns it."""
        again = new & former.keys()
        kept.update(zip(again, map(former.__getitem__, again), strict=True))
        return again

    def _found(self, parts: list[str]) -> dict[str, list[str]]:
        """Pre-tokens of parts with their leading space, found in one text since each ends at a safe cut."""
        words = self.pattern.findall(" " + " ".join(parts)) if parts else []
        lengths, sizes = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) for x in (words, parts))
        ends, bounds = np.cumsum(lengths), np.cumsum(sizes + 1)
        at = np.searchsorted(ends, bounds)
        if not np.array_equal(ends[-1:], bounds[-1:]) or not np.array_equal(ends[at], bounds):  # a pattern that skips text
            return {p: self.pattern.findall(" " + p) for p in parts}
        stops = (at + 1).tolist()
        return {p: words[a:b] for p, a, b in zip(parts, [0, *stops], stops, strict=False)}

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.limit // 2 or len(self.parts) > self.limit // 2:
            self.former, self.words, self.parts = (self.words, self.parts), {}, {}
        cuts = [cut(t) if t else [""] for t in texts]
        new = set().union(*(c[1:] for c in cuts)) - self.parts.keys()
        new -= self._again(self.parts, self.former[1], new)
        found = self._found(list(new))
        heads = [self.pattern.findall(c[0]) for c in cuts]
        unknown = {w for words in (*found.values(), *heads) for w in words} - self.words.keys()
        fresh = self.learn(unknown - self._again(self.words, self.former[0], unknown))
        self.words.update(fresh)
        ids = self.words.__getitem__
        for part, words in found.items():
            self.parts[part] = b"".join(map(ids, words))
        get = self.parts.__getitem__
        out = [b"".join([*map(ids, h), *map(get, c[1:])]) for h, c in zip(heads, cuts, strict=True)]
        for kept, more in ((self.words, fresh), (self.parts, found)):
            for k in more:
                if len(k) > self.longest:
                    del kept[k]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, array("I", ids)))


def groups(texts: Iterable[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Lists of texts of about `most` characters, or one longer text."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Return doc_id, n_tokens, ids (little-endian unsigned 32-bit)[, decoded (bytes, from the ids)].

    A null or empty text has no ids.  Each row is coded by itself, so ties and repeated
    rows need no rule; no rows: an empty result.  Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            ids = [x for group in groups(t.as_py() or "" for t in batch.column(1)) for x in own.encode_many(group)]
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
            if decoded:
                columns["decoded"] = pa.array(list(map(own.decode, ids)), pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    ddl = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ddl)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Return doc_id, decoded for rows of doc_id, ids; null ids decode to nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array([own.decode(x.as_py() or b"") for x in batch.column(1)], pa.binary())})

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")
