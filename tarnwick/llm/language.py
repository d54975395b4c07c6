"""Language by nearest centroid of normalised TF-IDF character n-grams.

A text's vector counts its byte n-grams (letters in lower case, all else a space) in
hashed buckets, damped by the logarithm, weighted by inverse document frequency and
scaled to length one. Each language has several centroids, the clusters of its
sample by spherical k-means. A text gets the language of the centroid with the
largest cosine; it is rejected where the distance, one minus that cosine, is beyond
the farthest that a text of the centroid's sample lies from the others of its
cluster, with some slack.

The sample is bounded: ``PER_LANGUAGE`` texts of each language, those with the
smallest hashes of id and text. Prediction reads the text alone.

Defined results: a null text and one without a letter give ``und`` with score 0, as
does any text if nothing was learned; repeated rows are predicted alike; rows whose
language is null teach nothing; extra columns are not read, so names cannot clash;
an empty table gives an empty result. Whole texts are counted, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.session import drop_stored, stored

from .common import bounded_sample, documents, text_batches
from .scan import LETTERS, column_bytes, pieces

BUCKET_BITS = 13
ORDERS = (1, 2, 3, 4)
#: Texts of each language that are learned from, at most.
PER_LANGUAGE = 400
#: Clusters of each language, rounds of k-means, slack of the rejection distance.
CLUSTERS, ROUNDS, SLACK = 3, 12, 1.15
NONE = "und"


def counts(column: pa.Array, bits: int = BUCKET_BITS) -> Iterator[tuple[int, np.ndarray]]:
    """First row and a matrix (rows, buckets) of n-gram counts, some rows at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = column_bytes(pc.utf8_lower(column))
    for row, to in pieces(offsets, 1 << 20):
        off = offsets[row : to + 1] - offsets[row]
        b = LETTERS[data[offsets[row] : offsets[to]]].astype(np.uint32)
        buckets, gram = [], None
        for n in range(1, max(ORDERS) + 1):
            gram = b if gram is None else (gram[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in ORDERS:
                h = (gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
                buckets.append((n, ((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)).astype(np.uint16)))
        for lo in range(0, to - row, 128):
            hi = min(lo + 128, to - row)
            out = np.zeros((hi - lo, 1 << bits), dtype=np.float32)
            for r in range(lo, hi):
                for n, x in buckets:
                    part = x[off[r] : max(off[r], off[r + 1] - n + 1)]
                    if len(part):
                        out[r - lo] += np.bincount(part, minlength=1 << bits)
            yield row + lo, out


def unit_rows(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Damped, weighted and scaled to length one; rows of zeros stay."""
    x = np.log1p(x) * idf
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


@dataclass
class Centroids:
    """The fitted classifier: some hundred kilobytes a language, whatever the corpus."""

    idf: np.ndarray
    langs: list[str]
    lang_of: np.ndarray
    vectors: np.ndarray
    far: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine, and whether the text is too far off, per row of counts."""
        cos = unit_rows(x, self.idf) @ self.vectors.T
        best = cos.argmax(axis=1)
        score = np.clip(cos[np.arange(len(x)), best].astype(np.float64), 0.0, 1.0)
        return self.lang_of[best], score, 1 - score > self.far[best]


def cluster(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: unit centroids and each row's."""
    rng, k = np.random.default_rng(seed), min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < k:
        gap = np.clip(1 - (x @ x[chosen].T).max(axis=1), 0, None)
        chosen.append(int(gap.argmax()))
    c = x[chosen]
    of = (x @ c.T).argmax(axis=1)
    for _ in range(rounds):
        c = np.stack([x[of == j].mean(axis=0) if (of == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        new = (x @ c.T).argmax(axis=1)
        if (new == of).all():
            break
        of = new
    return c, of


def _reach(rows: np.ndarray) -> float:
    """The largest distance of a row from the centroid of the others."""
    if len(rows) < 2:
        return 1.0
    rest = rows.sum(axis=0) - rows
    return float((1 - (rows * rest).sum(axis=1) / np.maximum(np.linalg.norm(rest, axis=1), 1e-12)).max())


def sample(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most ``per_language`` texts of each language among the rows that ``learn`` holds for."""
    rows = docs.filter(learn & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return bounded_sample(rows, "lang", ["doc_id", "text"], per_language).select("lang", "text")


def fit(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, slack: float = SLACK) -> Centroids:
    """Fit the centroids of a bounded sample (lang, text).

    Counts and clusters are made on the executors, one language's sample in a task; the
    driver gets ``clusters`` vectors of each language, 32 kB each.
    """

    def count(batches):
        for batch in batches:
            lang = batch.column("lang").to_pylist()
            for row, x in counts(batch.column("text")):
                at = [np.flatnonzero(r).astype(np.uint16) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang[row : row + len(x)], pa.string()), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([r[a].tobytes() for a, r in zip(at, x)], pa.binary())],
                    names=["lang", "at", "n"],
                )

    found = stored(rows.mapInArrow(count, "lang string, at binary, n binary"), "language-sample")

    def seen_in(batches):
        seen, n = np.zeros(1 << BUCKET_BITS, dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for at in batch.column("at").to_pylist():
                seen[np.frombuffer(at, dtype=np.uint16)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(seen)), -1)), pa.array(np.append(seen, n))], names=["bucket", "n"])

    total = {r["bucket"]: r["n"] for r in found.mapInArrow(seen_in, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a row per bucket
    seen = np.array([total.get(b, 0) for b in range(1 << BUCKET_BITS)])
    idf = np.log((1 + total.get(-1, 0)) / (1 + seen)).astype(np.float32) + np.float32(1)
    langs = sorted(r["lang"] for r in found.select("lang").distinct().collect())  # a name per language
    shared = rows.sparkSession.sparkContext.broadcast((idf, {lang: i for i, lang in enumerate(langs)}))

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        """The clusters of one language, from its sample."""
        idf, number = shared.value
        parts = sorted(zip(pdf["at"], pdf["n"]))  # however the rows arrive
        own = np.zeros((len(parts), 1 << BUCKET_BITS), dtype=np.float32)
        for row, (at, n) in zip(own, parts):
            row[np.frombuffer(at, dtype=np.uint16)] = np.frombuffer(n, dtype=np.float32)
        own, i = unit_rows(own, idf), number[pdf["lang"].iloc[0]]
        c, at = cluster(own, clusters, rounds, seed=i)
        far = [min(1.0, slack * _reach(own[at == j])) for j in range(len(c))]
        return pd.DataFrame({"i": i, "j": range(len(c)), "vector": [x.astype(np.float32).tobytes() for x in c], "far": far})

    made = sorted(found.groupBy("lang").applyInPandas(centroids, "i int, j int, vector binary, far double").collect(), key=lambda r: (r["i"], r["j"]))  # some rows a language
    shared.destroy()
    drop_stored(found)
    vectors = np.stack([np.frombuffer(r["vector"], dtype=np.float32) for r in made]) if made else np.zeros((0, 1 << BUCKET_BITS), dtype=np.float32)
    return Centroids(idf, langs, np.array([r["i"] for r in made], dtype=np.int64), vectors, np.array([r["far"] for r in made]))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang (``und`` if rejected or without letters), nearest_lang, score, rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for batch in batches:
            text = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            n = len(text)
            lang, score, off = np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=bool)
            known = len(m.langs) > 0
            for row, x in counts(text) if known else ():
                part = slice(row, row + len(x))
                lang[part], score[part], off[part] = m.predict(x)
            names = np.array([*m.langs, NONE], dtype=object)
            nearest = np.where(letters & known, names[lang] if known else NONE, NONE)
            score = np.where(nearest == NONE, 0.0, score)
            off = off | (nearest == NONE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.where(off, NONE, nearest), pa.string()), pa.array(nearest, pa.string()), pa.array(score), pa.array(off)],
                names=["doc_id", "lang", "nearest_lang", "score", "rejected"],
            )

    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, lang string, nearest_lang string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from; a null id is in neither fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the language of all documents, learned outside the held-out fold."""
    docs = documents(spark, sf_dir)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    out = identify(docs, fit(sample(docs, learn)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("nearest_lang").alias("lang_pred"), "score", "rejected")
