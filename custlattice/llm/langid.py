"""Language identification by nearest centroids: normalised TF-IDF vectors of hashed byte n-grams, several centroids per language.

The classifier is fitted on a bounded sample of labelled rows; predicting is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlattice.llm.staging import staged
from custlattice.llm.tokens import mix, slices, text_bytes

#: Training rows, shared evenly by the languages, and centroids per language.
SAMPLE = 4_000
CENTROIDS = 4
BITS = 12
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: A text whose distance from its centroid is above the centroid's own largest training distance, times this, is rejected.
SLACK = 1.25

#: Letters and bytes of other characters; everything else is one space.
_MAP = np.full(256, 32, dtype=np.uint8)
_MAP[97:123] = _MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)


def counts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x 2^BITS: how often each hashed n-gram occurs. A text is taken whole, with a space before and after it."""
    rows, width = len(off) - 1, 1 << BITS
    n = np.diff(off)
    out = np.zeros((rows, width), dtype=np.float32)
    if not rows:
        return out
    # each row moves right by two places per row before it and one more, so that spaces separate rows
    row_of = np.repeat(np.arange(rows), n)
    text = np.full(int(off[-1]) + 2 * rows, 32, dtype=np.uint8)
    text[np.arange(len(raw)) + 2 * row_of + 1] = _MAP[raw]
    row_of = np.repeat(np.arange(rows), n + 2)
    x = text.astype(np.uint64)
    for k in SIZES:
        m = len(x) - k + 1
        if m <= 0:
            continue
        code = np.full(m, k, dtype=np.uint64)
        for j in range(k):
            code = (code << np.uint64(8)) | x[j : j + m]
        own = row_of[:m] == row_of[k - 1 :]
        index = (mix(code) >> np.uint64(64 - BITS)).astype(np.int64)
        index = (index + row_of[:m] * width)[own]
        out += np.bincount(index, minlength=rows * width).reshape(rows, width)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from spread starts: each next start is the row least like those chosen."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = unit(np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


@dataclass
class Centroids:
    """Languages by centroid, unit centroid vectors, inverse document frequencies, and each centroid's reach as a cosine distance."""

    langs: list[str]
    vectors: np.ndarray
    idf: np.ndarray
    reach: np.ndarray

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Nearest centroid's language, cosine clipped to 0..1, and whether its distance is beyond the reach."""
        if not self.langs:
            n = len(off) - 1
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
        likeness = unit(np.log1p(counts(raw, off)) * self.idf) @ self.vectors.T
        best = np.argmax(likeness, axis=1)
        score = np.clip(likeness[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return [self.langs[b] for b in best], score, 1 - score > self.reach[best] * SLACK


def fit(docs: DataFrame, allowed) -> Centroids:
    """Centroids from rows with a lang and a non-empty text for which `allowed` holds; at most SAMPLE of them, chosen by hash.

    A language with few rows gives all of them. Without any row there is no language, and all texts are UNKNOWN.
    """
    rated = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & allowed)
    rows = rated.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    if not rows:
        return Centroids([], np.zeros((0, 1 << BITS)), np.ones(1 << BITS), np.zeros(0))
    share = SAMPLE // len(rows)
    part = F.lit(0.0)
    for r in rows:
        part = F.when(F.col("lang") == r.lang, min(1.0, share / r["count"])).otherwise(part)
    dice = F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 30)) / (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, off in slices(batch, "text"):
                found = counts(raw, off).astype("<f4")
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array([x.tobytes() for x in found], pa.binary()), chunk.column(2)], ["lang", "counts", "dice"])

    sample = rated.select("lang", F.col("text").cast("string").alias("text"), dice.alias("dice")).where(F.col("dice") < part)
    vectors = staged(sample.mapInArrow(run, "lang string, counts binary, dice double"), "lang-sample")
    got = vectors.orderBy("dice", "lang", "counts").limit(2 * SAMPLE).select("lang", "counts").toArrow()
    x = np.frombuffer(b"".join(got.column("counts").to_pylist()), dtype="<f4").reshape(-1, 1 << BITS)
    lang = np.array(got.column("lang").to_pylist())
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x = unit(np.log1p(x) * idf)
    langs, centres, reach = [], [], []
    for name in sorted(set(lang.tolist())):
        own = x[lang == name]
        made = _clusters(own, CENTROIDS)
        nearest = own @ made.T
        best = np.argmax(nearest, axis=1)
        langs += [name] * len(made)
        centres.append(made)
        reach += [float(np.max(1 - nearest[best == c, c], initial=0)) for c in range(len(made))]
    return Centroids(langs, np.concatenate(centres), idf, np.array(reach))


def predicted(docs: DataFrame, made: Centroids) -> DataFrame:
    """docs with lang_pred, score and rejected.

    lang_pred is UNKNOWN, with score 0 and rejected, for texts that are null or without a letter; else the nearest centroid's language, which a
    caller may drop where rejected says that the distance is larger than in training. Extra columns and repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(made)

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def run(text: pa.Array) -> pa.Array:
        lang: list[str] = []
        score, far = [np.zeros(0)], [np.zeros(0, dtype=bool)]
        raw, off = text_bytes(text)
        i, n = 0, len(off) - 1
        while i < n:  # a row has 2^BITS counts, so rows per step are few
            j = min(n, i + 256, max(i + 1, int(np.searchsorted(off, off[i] + (1 << 18), "right")) - 1))
            a, b, c = sent.value.predict(raw[off[i] : off[j]], off[i : j + 1] - off[i])
            lang += a
            score.append(b)
            far.append(c)
            i = j
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(far))], ["lang", "score", "rejected"])

    text = F.col("text").cast("string")
    letters = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    known = docs.withColumn("_found", run(F.when(letters, text).otherwise(F.lit(""))))
    return known.select(
        *docs.columns,
        F.when(letters, F.col("_found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col("_found.score")).otherwise(0.0).alias("score"),
        (~letters | F.col("_found.rejected")).alias("rejected"),
    )
