"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

The model is trained by follow-the-regularised-leader (proximal) with elastic-net penalties
and calibrated by a temperature on a fifth of its sample that training never saw.

Scale: fitting takes a bounded sample of labelled texts, whole ones chosen by a hash of doc_id, to
the driver (see `fit_sample`); prediction is one map-side pass over whole texts, each in chunks.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewell.llm import scratch

#: The fitting sample of a language: expected texts and characters at most, but one text at least; and expected texts of all.
PER_LANGUAGE, CHARACTERS, TEXTS = 400, 4_000_000, 40_000
#: Bits of a gram's number, fewer where the weights of all languages would be more than `CELLS`; and the grams' lengths.
BITS, CELLS, ORDERS = 15, 1 << 23, (1, 2, 3)
#: Characters of a text that are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams of a whole text and their relative frequencies; None without letters.

    Letters are lower-cased; what lies between them counts as one space, and so do both ends.
    """
    counts = np.zeros(1 << bits, dtype=np.int64)
    before, any_letter = np.array([32], dtype=np.uint32), False
    text = text or ""
    for at in range(0, len(text) + 1, CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        any_letter |= bool(letter.any())
        last = at + CHUNK > len(text)
        codes = np.concatenate((before, np.where(letter, codes, np.uint32(32)), np.full(int(last), 32, dtype=np.uint32)))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        # Grams that end in this chunk; those that end before it were counted with the one before.
        old = len(before) if at else 0
        gram = np.zeros(len(codes), dtype=np.uint32)
        for k in range(max(ORDERS)):
            gram = gram[: len(codes) - k] * np.uint32(0x01000193) + codes[k:] + np.uint32(1)
            own = gram[max(old - k, 0) :]
            if k + 1 in ORDERS and len(own):
                counts += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
        before = codes[len(codes) - min(len(codes), max(ORDERS) - 1) :]
    if not any_letter:
        return None
    own = np.flatnonzero(counts)
    return own, counts[own] / counts.sum()


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # by gram and language; the last row is the bias
    temperature: float = 1.0

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def vector(self, own: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[own]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def logits(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self.weights[own] * x[:, None]).sum(axis=0) + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """The most likely language (ties: the first by name) and its calibrated probability; `und` and 0 without letters."""
        found = features(text, self.bits)
        if found is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found[0], self.vector(*found)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(min(p[k], 1.0))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], languages: list[str], l1: float = 1e-4, l2: float = 1e-4, alpha: float = 0.5, beta: float = 1.0, epochs: int = 3, seed: int = 1) -> Model:
    """Train and calibrate; every fifth example of a language is kept for the temperature."""
    bits = max(min(BITS, (CELLS // max(len(set(languages)), 1)).bit_length() - 1), 1)
    known = [(f, y) for t, y in zip(texts, languages, strict=True) if (f := features(t, bits))]
    names = sorted({y for _, y in known})
    df = np.zeros(1 << bits)
    for (own, _), _ in known:
        df[own] += 1
    idf = np.log((1 + len(known)) / (1 + df)) + 1
    model = Model(names, idf, np.zeros(((1 << bits) + 1, len(names))))
    if not known:
        return model
    index, seen = {y: k for k, y in enumerate(names)}, np.zeros(len(names), dtype=np.int64)
    train, held = [], []
    for (own, tf), y in known:
        k = index[y]
        (held if seen[k] % 5 == 4 else train).append((own, model.vector(own, tf), k))
        seen[k] += 1
    z, n, w = np.zeros_like(model.weights), np.zeros_like(model.weights), model.weights
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            own, x, y = train[i]
            rows, x = np.append(own, len(w) - 1), np.append(x, 1.0)
            error = softmax((w[rows] * x[:, None]).sum(axis=0))
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w[rows]
            n[rows] += g * g
            zr = z[rows]
            w[rows] = np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))
    if held:
        scores = [(model.logits(own, x), y) for own, x, y in held]
        loss = lambda t: -sum(np.log(max(softmax(s / t)[y], 1e-12)) for s, y in scores)
        model.temperature = float(min(np.geomspace(0.2, 20, 61), key=loss))
    return model


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out quarter; a null lang, doc_id or text is no label.

    A text is drawn by a hash of its doc_id, so that a language gives about `PER_LANGUAGE` texts
    (fewer if there are many languages) of about `CHARACTERS` together; its first drawn text always.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null and text is not null")
    rows = rows.where(~held_out(docs)).withColumn("draw", F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / (1 << 30))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min("draw").alias("first"))
    counts = scratch.written(counts, "lang-counts")  # a row for each language
    texts = max(min(PER_LANGUAGE, TEXTS // max(counts.count(), 1)), 1)
    share = F.greatest(F.least(texts / F.col("n"), CHARACTERS / F.greatest("chars", F.lit(1))), "first")
    sample = rows.join(F.broadcast(counts.select("lang", share.alias("share"))), "lang").where(F.col("draw") <= F.col("share"))
    found = [tuple(r) for r in sample.select("doc_id", "text", "lang").collect()]
    found.sort(key=lambda r: (hash((r[0], 7)), r))
    model = fit([r[1] for r in found], [r[2] for r in found])
    scratch.trim()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred and score (0 to 1) to all rows and columns of `docs`.

    A text that is null or has no letter is `und` with score 0.  Clashing columns of
    `docs` named lang_pred or score are replaced.  No rows: an empty result.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index("text"))
            found = [model.predict(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                schema=batch.schema.append(pa.field("lang_pred", pa.string())).append(pa.field("score", pa.float64())),
            )

    base = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInArrow(scratch.tidied(run), schema)
