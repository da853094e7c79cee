"""Language identification: nearest centroid over TF-IDF vectors of byte n-grams.

A text becomes the counts of its hashed byte trigrams (ASCII letters in lower case, ASCII digits,
punctuation and runs of white space as one blank), damped by a logarithm, weighted by inverse document
frequency and scaled to length 1. Each language has several centroids, found by spherical k-means in a
bounded sample of its labelled rows, and a text gets the language of the centroid with the largest
cosine. A text is rejected if that cosine is below what texts of its length had in the sample: cosines
are compared within classes of distinct trigrams, and the bar is a fraction of the lowest one seen,
lower still for texts too short to tell.

The sample (`per_language` different rows of each language, those with the smallest hash of id and text)
bounds what is fitted: document frequencies, centroids and bars. The hash orders it, so the model does not
depend on the order or partitioning of rows. All texts are read whole when predicted.

Null texts and texts without a letter are `und`, with score 0, and rejected. If no row is labelled,
every text is. Ties between centroids go to the language first in order. Rows are judged one by one,
so repeated rows have equal results, and count once in the sample; an empty table gives an empty result.
Languages, sources and ids are no inputs of a prediction; other columns are kept, but for those that
have the name of a result, which it replaces (a prefix keeps both).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

#: Hashed trigrams; bounds the size of a centroid.
DIMENSIONS = 1 << 14
UNKNOWN = "und"
#: The class of distinct trigrams (2**(SURE - 1) or more) from which on a low cosine is no matter of length.
SURE = 8
#: Hashes of rows lie below this; a language's first rows are sought among WIDER times as many as are wanted.
HASHES, WIDER = 1 << 40, 4
ASCII_LETTER = re.compile("[A-Za-z]")
FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)).lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's trigrams and how often each occurs."""
    folded = b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split())
    b = np.frombuffer(b" " + folded + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    counts = np.bincount(code >> np.uint32(18), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    n = np.sqrt(v @ v)
    return v / n if n > 0 else v


def size_class(distinct: int) -> int:
    return int(max(distinct, 1)).bit_length()


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    matrix: np.ndarray  # a row for each centroid
    idf: np.ndarray
    bars: np.ndarray  # by class of distinct trigrams

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, counts = grams(text)
        cosines = self.matrix[:, at] @ vector(at, counts, self.idf)
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score < self.bars[min(size_class(len(at)), len(self.bars) - 1)])


def spherical_k_means(rows: list[tuple[np.ndarray, np.ndarray]], k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of sparse unit vectors, the first seeds being far apart; at most k."""
    dense = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (at, v) in enumerate(rows):
        dense[i, at] = v
    seeds = [0]
    for _ in range(min(k, len(rows)) - 1):
        seeds.append(int(np.argmin((dense @ dense[seeds].T).max(axis=1))))
    centers = dense[seeds]
    for _ in range(rounds):
        nearest = (dense @ centers.T).argmax(axis=1)
        sums = [dense[nearest == j].sum(axis=0) for j in range(len(centers)) if (nearest == j).any()]
        centers = np.array([s / max(np.linalg.norm(s), 1e-12) for s in sums], np.float32)
    return centers


def fit(labelled: DataFrame, *, id_col: str, text_col: str, lang_col: str, per_language: int, clusters: int, slack: float) -> Centroids:
    """From a sample of at most per_language rows of each language; what comes to the driver grows with the languages alone."""
    digest = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col), F.col(text_col)), F.lit(HASHES))
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), digest.alias("digest"))
    rows = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not rows:
        return Centroids([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS.bit_length() + 1))
    below = lambda bounds: F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    # Hashes spread evenly, so about WIDER * per_language rows of a language lie below its first bound.
    bounds = {lang: min(HASHES, WIDER * per_language * HASHES // n) for lang, n in rows.items()}
    first: dict[str, list[int]] = {lang: [] for lang in rows}
    for r in known.select("lang", "digest").where(F.col("digest") < below(bounds)).distinct().collect():
        first[r.lang].append(r.digest)
    bounds = {lang: sorted(own)[:per_language][-1] if own else -1 for lang, own in first.items()}
    texts = known.where(F.col("digest") <= below(bounds)).distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, digest, *grams(text)) for lang, text, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True) if has_letter(text)]
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["lang", "digest", "at", "counts"])

    sample = cut(texts.select("lang", "text", "digest").mapInArrow(count, "lang string, digest long, at array<int>, counts array<int>"))
    total = sample.count()
    idf = np.full(DIMENSIONS, np.log(total + 1) + 1)
    for row in sample.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # DIMENSIONS rows at most
        idf[row["at"]] = np.log((total + 1) / (row["count"] + 1)) + 1

    def cluster(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["digest"].to_pylist(), table["at"].to_pylist(), table["counts"].to_pylist(), strict=True))[:per_language]
        rows = [(np.asarray(a), np.asarray(c)) for _, a, c in rows]
        centers = spherical_k_means([(a, vector(a, c, idf)) for a, c in rows], clusters)
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centers), pa.string()), "center": pa.array(list(centers), pa.list_(pa.float32()))})

    centers = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, center array<float>").collect(), key=lambda r: (r.lang, r.center))
    matrix = np.array([r.center for r in centers], np.float32).reshape(-1, DIMENSIONS)
    found = Centroids([r.lang for r in centers], matrix, idf, np.zeros(DIMENSIONS.bit_length() + 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(np.asarray(a), np.asarray(c)) for a, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            best = [float((matrix[:, a] @ vector(a, c, idf)).max()) for a, c in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([size_class(len(a)) for a, _ in pairs], pa.int32()), pa.array(best, pa.float64())], names=["class", "cosine"])

    lowest = {r["class"]: r.low for r in sample.select("at", "counts").mapInArrow(nearest, "class int, cosine double").groupBy("class").agg(F.min("cosine").alias("low")).collect()} if centers else {}
    if lowest:
        shortest, low = min(lowest), 0.0
        for k in range(len(found.bars)):  # longer texts have larger cosines, so no bar is below that of shorter ones
            low = max(low, min([v for c, v in lowest.items() if c >= k], default=low))
            found.bars[k] = slack * low * 2 ** (min(0, k - max(shortest, SURE)) / 2)  # a cosine falls as the root of the length
    return found


def predict(docs: DataFrame, model: Centroids, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected, their names after a prefix."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([spread.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    names = {f"{prefix}{c}": c for c in ("lang_pred", "score", "rejected")}
    rows = docs.withColumn("__judged", judge(F.col(text_col)))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *[F.col(f"__judged.{c}").alias(name) for name, c in names.items()])


def held_out(doc_id: Column) -> Column:
    """Every fifth document by digest of its id is kept from the learner."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 4, slack: float = 0.2, prefix: str = "") -> DataFrame:
    """docs with held_out, lang_pred, score and rejected; learns from the labelled rows that aren't held out."""
    seen = docs.where(~held_out(F.col(id_col)))
    model = fit(seen, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language, clusters=clusters, slack=slack)
    return predict(docs.withColumn(f"{prefix}held_out", held_out(F.col(id_col))), model, text_col=text_col, prefix=prefix)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
