"""Substring deduplication: windows of words, partitioned as super-k-mers.

A window is `window` consecutive words of one document. Among the hashes of the m-word runs inside a
window the smallest is its minimiser; consecutive windows that share it form a super-k-mer. Equal
windows have equal minimisers, so a window can only repeat in another document where its minimiser
does. The work goes in steps:

1. One scan gives per document its word count, the digest of its words, and minimiser and first window
   of each super-k-mer (12 bytes each; no text moves).
2. Documents with equal words: all but the one with the smallest id lose every word, if they have a
   window at all. They take no further part, so exact copies, however many, weigh nothing.
3. Minimisers found in one document alone are dropped. The other super-k-mers travel, as one packed
   string each, to the bucket of their minimiser, where prefix doubling over sorted pairs gives equal
   windows equal numbers, exactly, and the smallest document of each.
4. A minimiser whose super-k-mers hold more than `hot` words in all would crowd one bucket. Its windows
   travel one by one, as SHA-256 of their words, and are counted by a grouped minimum with map-side
   combining.
5. Marked stretches go back to their documents, whose words outside them are kept.

Null and empty texts have no words. Null ids count as larger than any id, and not as smaller than one
another. Rows that repeat an id are one document to each other: neither removes words of the other;
each row gets its result. Ties between equal windows go to the smallest id. An empty table gives an
empty result. Columns beside id and text are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_or_last, last_to_null, partitions, read

#: Fixed values of a 64-bit mixing function.
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; equal in every process."""
    if not words:
        return np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    b = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(len(b), dtype=np.uint64) - np.repeat((ends - sizes).astype(np.uint64), sizes)
    part = mixed((b + np.uint64(1)) * MIX[2] + place * MIX[0])
    return mixed(np.add.reduceat(part, ends - sizes) + sizes.astype(np.uint64))


def minima(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    done, low = 1, x
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    return np.minimum(low[: len(x) - width + 1], low[width - done : width - done + len(x) - width + 1])


def super_kmers(words: list[bytes], window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimiser and first window of each super-k-mer."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = word_hashes(words)
    runs = np.zeros(len(h) - m + 1, np.uint64)
    for k in range(m):
        runs = runs * MIX[2] + h[k : len(h) - m + 1 + k]
    low = minima(mixed(runs), window - m + 1)
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    return low[first].view(np.int64), first.astype(np.int32)


def numbers(words: list[bytes], starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """A number for each window of packed strings, equal for equal windows.

    words: those of all strings in a row; starts: the first word of each string; counts: its windows.
    Doubling the length of numbered runs by sorting pairs of numbers keeps equality exact.
    """
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    length = 1
    while length * 2 <= window:
        pair = ids[:-length] * (len(words) + 1) + ids[length:]
        ids, length = np.unique(pair, return_inverse=True)[1], length * 2
    at = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
    if length < window:
        return np.unique(ids[at] * (len(words) + 1) + ids[at + window - length], return_inverse=True)[1]
    return np.unique(ids[at], return_inverse=True)[1]


def stretches(flags: np.ndarray, of: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked windows: the string of each, its first word and the word after its last."""
    hit = np.flatnonzero(flags)
    if len(hit) == 0:
        return hit, hit, hit
    new = np.r_[True, (np.diff(hit) != 1) | (np.diff(of[hit]) != 0)]
    begin, last = hit[new], hit[np.r_[new[1:], True]]
    return of[begin], first[begin], first[last] + window


def tag_of(digest: bytes) -> int:
    """Tells rows of one id apart."""
    return int.from_bytes(digest[:8], "little", signed=True)


def scan(docs: DataFrame, window: int, m: int) -> DataFrame:
    def read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, tags, sha, minis, firsts = [], [], [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                low, first = super_kmers(words, window, m)
                n.append(len(words))
                digest = hashlib.sha256(b" ".join(words)).digest()
                tags.append(tag_of(digest))
                sha.append(digest.hex())
                minis.append(low)
                firsts.append(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tags, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(minis, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32()))], names=["id", "tag", "n_words", "sha", "minis", "firsts"])

    return docs.select("id", "text").mapInArrow(read_words, "id long, tag long, n_words long, sha string, minis array<long>, firsts array<int>")


def packed(docs: DataFrame, window: int) -> DataFrame:
    """(id, tag, text, found: array of (mini, first, n, hot)) to packed super-k-mers, and digests of hot windows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, tag, text, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if tag_of(hashlib.sha256(b" ".join(words)).digest()) != tag:
                    continue  # another row of the same id
                for s in found:
                    first, n = s["first"], s["n"]
                    if s["hot"]:
                        rows += [(s["mini"], name, tag, i, 1, hashlib.sha256(b" ".join(words[i : i + window])).digest(), True) for i in range(first, first + n)]
                    else:
                        rows.append((s["mini"], name, tag, first, n, b" ".join(words[first : first + n + window - 1]), False))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000], strict=True), kinds, strict=True)], names=["mini", "id", "tag", "first", "n", "words", "hot"])

    return docs.select("id", "tag", "text", "found").mapInArrow(pack, "mini long, id long, tag long, first int, n int, words binary, hot boolean")


def judged(strings: DataFrame, window: int, chunk_words: int = 1 << 20) -> DataFrame:
    """Sorts the windows of whole buckets; gives the stretches whose windows start in a smaller document too."""

    def judge(rows: list[dict]) -> pa.RecordBatch:
        split = [r["words"].split() for r in rows]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        counts = sizes - window + 1
        starts = np.cumsum(sizes) - sizes
        same = numbers([w for s in split for w in s], starts, counts, window)
        of = np.repeat(np.arange(len(rows)), counts)
        owner = np.fromiter((r["id"] for r in rows), np.int64, len(rows))[of]
        least = np.full(same.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, same, owner)
        first = np.repeat(np.fromiter((r["first"] for r in rows), np.int64, len(rows)), counts) + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        which, begin, end = stretches(least[same] < owner, of, first, window)
        return pa.RecordBatch.from_arrays([pa.array([rows[k]["id"] for k in which], pa.int64()), pa.array([rows[k]["tag"] for k in which], pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["id", "tag", "begin", "end"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict] = []
        volume = 0
        for batch in batches:
            for row in batch.to_pylist():
                if volume >= chunk_words and row["mini"] != kept[-1]["mini"]:
                    yield judge(kept)
                    kept, volume = [], 0
                kept.append(row)
                volume += row["n"] + window - 1
        if kept:
            yield judge(kept)

    ordered = strings.select("mini", "id", "tag", "first", "n", "words").repartition(partitions(strings), "mini").sortWithinPartitions("mini", "id", "first")
    return ordered.mapInArrow(sort, "id long, tag long, begin int, end int")


def kept_words(docs: DataFrame) -> DataFrame:
    """(id, tag, text, gone: array of (begin, end)) to words removed and the digest and text of those kept."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, tag, text, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if tag_of(hashlib.sha256(b" ".join(words)).digest()) != tag:
                    continue
                out = np.zeros(len(words) + 1, np.int32)
                np.add.at(out, [g["begin"] for g in gone], 1)
                np.add.at(out, [g["end"] for g in gone], -1)
                keep = np.flatnonzero(np.cumsum(out[:-1]) == 0)
                text = b" ".join([words[k] for k in keep])
                rows.append((name, tag, len(words) - len(keep), hashlib.sha256(text).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "tag", "n_removed", "kept_sha256"])

    return docs.select("id", "tag", "text", "gone").mapInArrow(drop, "id long, tag long, n_removed long, kept_sha256 string")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, m: int = 8, hot: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 per row of docs."""
    m = min(m, window)
    rows = docs.select(id_or_last(F.col(id_col)).alias("id"), F.col(text_col).alias("text"))
    all_docs = cut(scan(rows, window, m))
    long = all_docs.where(F.col("n_words") >= window)
    first_of = long.groupBy("sha").agg(F.min("id").alias("first_id"))
    unique = long.join(first_of.select(F.col("first_id").alias("id"), "sha"), ["id", "sha"], "left_semi")
    kmers = unique.select("id", "tag", "n_words", "firsts", F.posexplode("minis").alias("k", "mini"))
    after = F.coalesce(F.try_element_at("firsts", F.col("k") + 2), (F.col("n_words") - window + 1).cast("int"))
    at = F.element_at("firsts", F.col("k") + 1)
    kmers = kmers.select("id", "tag", "mini", at.alias("first"), (after - at).alias("n"))
    shared = kmers.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(F.col("n") + F.lit(window - 1).cast("long")).alias("words")).where("low < high")
    spans = kmers.join(shared.select("mini", (F.col("words") > hot).alias("hot")), "mini")
    spans = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("mini", "first", "n", "hot")).alias("found"))
    # Only documents that share a minimiser are kept from here on; their texts moved once.
    suspects = cut(rows.join(spans.hint("shuffle_hash"), "id"))

    usual = judged(packed(suspects.withColumn("found", F.filter("found", lambda s: ~s["hot"])), window), window)
    windows = packed(suspects.withColumn("found", F.filter("found", lambda s: s["hot"])).where(F.size("found") > 0), window)
    least = windows.groupBy("words").agg(F.min("id").alias("low"))
    often = windows.join(least, "words").where("low < id").select("id", "tag", F.col("first").alias("begin"), (F.col("first") + window).alias("end"))
    gone = usual.unionByName(often).groupBy("id", "tag").agg(F.collect_set(F.struct("begin", "end")).alias("gone"))
    partly = kept_words(suspects.drop("found").join(gone.hint("shuffle_hash"), ["id", "tag"])).distinct()

    copies = all_docs.select("id", "tag", "n_words", "sha").join(first_of, "sha", "left")
    copy = F.col("first_id").isNotNull() & (F.col("first_id") < F.col("id"))
    result = copies.join(partly, ["id", "tag"], "left")
    removed = F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    digest = F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha"))
    return result.select(last_to_null(F.col("id")).alias("doc_id"), "n_words", removed.cast("long").alias("n_removed"), digest.alias("kept_sha256"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))
