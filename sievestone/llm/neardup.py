"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set holds the distinct runs of `shingle` words, letters A-Z lowered; a text with fewer
words is one run. Its signature has `hashes` minima, `bits` bits of each. Two signatures differ in some
number of places; for documents at the threshold that number is binomial, and `distance` is set so far
above its mean that about one such pair in 10**4 lies beyond (of pairs at the very threshold). The join is exact for that distance:
cutting the places into c chunks, of which (distance + 1) / 2 suffice, leaves some chunk with at most
one difference in every pair within it (pigeonhole), and enumerating which place of a chunk may differ
gives `hashes` keys per document, of which such a pair shares at least one.

What is asked for are components, so no group is expanded into its pairs:

1. Texts with equal words are one class with one signature, whose smallest id represents it.
2. Every class is compared with the smallest id it shares a key with, on full sets, and verified links
   are joined into components. That settles all pairs inside them: they count as linked already.
3. Keys that still hold several components are searched for pairs of signatures within the distance
   across components, in blocks of bounded size. A component that fills a block by itself never meets its
   own other blocks, so a large settled group costs its rows, not their square. This gives pairs of
   components, and their members are compared on full sets until a link is found; each comparison returns
   at most one link per document.
4. The links of both steps are joined.

Null and empty texts have no set and link with nothing. Rows that repeat an id are one document: they
share a component. Rows with a null id are told apart by their words and take part like others; their
component is named by null where it holds no row with an id. Ties go to the smallest id. An empty table gives an empty result. Columns beside id and text are
not read; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions, read
from .graphs import components
from .substrings import MIX, mixed, word_hashes

LOWER = bytes(range(256)).lower()
#: Ids from here on stand for rows without an id.
NAMELESS = 1 << 62


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of words."""
    h = word_hashes(words)
    if len(h) == 0:
        return h
    n = max(1, len(h) - width + 1)
    run = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        run = mixed(run + MIX[2]) + h[k : k + n]
    return np.unique(mixed(run))


def nameless(words: list[bytes]) -> int:
    """Stands for the id of a row that has none."""
    return NAMELESS + int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:7], "little")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id: the id, or what stands for it."""

    @F.pandas_udf("long")
    def name(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([nameless(words_of(t)) for t in batch], dtype="int64")

    known = docs.where(F.col(id_col).isNotNull()).withColumn("__id", F.col(id_col).cast("long"))
    return known.unionByName(docs.where(F.col(id_col).isNull()).withColumn("__id", name(F.col(text_col))))


def multipliers(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240101)
    return draw.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, hashes, np.uint64)


def signature(own: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Low bits of the smallest hash under each function; the high 32 bits of a product are hashed."""
    low = np.full(len(factors[0]), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(own), 4096):
        part = ((own[None, a : a + 4096] * factors[0][:, None] + factors[1][:, None]) >> np.uint64(32)).astype(np.uint32)
        low = np.minimum(low, part.min(axis=1))
    return (mixed(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def keys_of(signatures: np.ndarray, chunks: int) -> np.ndarray:
    """A key for each chunk and each of its places that may differ: rows by documents."""
    sizes = [len(c) for c in np.array_split(np.arange(signatures.shape[1]), chunks)]
    out, at = [], 0
    for c, size in enumerate(sizes):
        for left_out in range(size):
            key = np.full(len(signatures), c * 64 + left_out + 1, np.uint64)
            for k in range(size):
                if k != left_out:
                    key = mixed(key * MIX[2] + signatures[:, at + k].astype(np.uint64))
            out.append(key)
        at += size
    return np.stack(out, axis=1).view(np.int64)


def first_slot(differ: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the keys that a pair within the distance shares, the first; differ: places that differ, by pairs."""
    chunk = (np.add.reduceat(differ, starts, axis=1, dtype=np.int64) <= 1).argmax(axis=1)
    sizes = np.diff(np.r_[starts, differ.shape[1]])
    inside = (np.arange(differ.shape[1]) >= starts[chunk, None]) & (np.arange(differ.shape[1]) < (starts + sizes)[chunk, None])
    odd = differ & inside
    return np.where(odd.any(axis=1), odd.argmax(axis=1), starts[chunk])


def signatures_in(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def scan(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = multipliers(hashes)
        for batch in batches:
            ids, sha, n, signed = [], [], [], []
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                digest = hashlib.sha256(b" ".join(words)).digest()
                own = shingles(words, width)
                name = name.as_py()
                ids.append(nameless(words) if name is None else name)
                sha.append(digest)
                n.append(len(own))
                signed.append(signature(own, factors).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sha, pa.binary()), pa.array(n, pa.int64()), pa.array(signed, pa.binary())], names=["id", "sha", "n", "signature"])

    return docs.select("id", "text").mapInArrow(sign, "id long, sha binary, n long, signature binary")


def keyed(classes: DataFrame, chunks: int) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(signatures_in(batch.column(1)), chunks) if batch.num_rows else np.empty((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1])), pa.array(keys.ravel())], names=["rep", "key"])

    return classes.select("rep", "signature").mapInArrow(key, "rep long, key long")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, set) of the wanted classes, from the texts of their representatives."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py()), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    rows = named(docs, "id", "text").select(F.col("__id").alias("id"), "text")
    return rows.join(wanted.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id").select("id", "text").mapInArrow(gather, "rep long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.size("set_a") + F.size("set_b") - both)).select("a", "b")


def across(members: DataFrame, distance: int, percent: int, block_rows: int, chunks: int) -> DataFrame:
    """(low, high): components that hold signatures within the distance under one key.

    A pair of documents speaks under the first key that it shares only.

    A key's members are cut into blocks of bounded size, and every pair of blocks is one group: large
    components have blocks of their own (home: their label), small ones share some.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("rows"))
    large = F.col("rows") >= block_rows
    per_key = sizes.groupBy("key").agg(F.count("*").alias("labels"), F.sum(F.when(~large, F.col("rows"))).alias("small_rows"), F.collect_list(F.when(large, F.struct("label", "rows"))).alias("large")).where("labels > 1")
    blocks_of = lambda rows: F.ceil(rows / block_rows).cast("int")
    shared = F.coalesce(blocks_of(F.col("small_rows")), F.lit(0))
    none = F.array().cast("array<struct<home:bigint,k:int>>")
    pool = F.when(shared > 0, F.transform(F.sequence(F.lit(1), F.greatest(shared, F.lit(1))), lambda k: F.struct(F.lit(None).cast("long").alias("home"), (k - 1).alias("k")))).otherwise(none)
    own_blocks = lambda x: F.transform(F.sequence(F.lit(1), blocks_of(x["rows"])), lambda k: F.struct(x["label"].alias("home"), (k - 1).alias("k")))
    blocks = F.concat(pool, F.flatten(F.transform("large", own_blocks)))
    open_ = members.join(per_key.select("key", "large", shared.alias("shared"), blocks.alias("blocks")), "key").withColumn("rows", F.try_element_at(F.map_from_entries("large"), F.col("label")))
    home = F.when(F.col("rows").isNotNull(), F.col("label"))
    k = F.pmod(F.xxhash64("rep"), F.when(home.isNotNull(), blocks_of(F.col("rows"))).otherwise(F.col("shared"))).cast("int")
    open_ = open_.withColumn("home", home).withColumn("own", F.xxhash64(F.coalesce("home", F.lit(-1)), k))
    met = F.filter("blocks", lambda b: b["home"].isNull() | F.col("home").isNull() | (b["home"] != F.col("home")))
    open_ = open_.withColumn("other", F.explode(met)).withColumn("other", F.xxhash64(F.coalesce("other.home", F.lit(-1)), F.col("other.k")))
    open_ = open_.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "n", "signature")

    def compare(rows: pa.Table, slot: int, out: set[tuple[int, int]]) -> None:
        labels, sizes, block = rows["label"].to_numpy(), rows["n"].to_numpy(), rows["own"].to_numpy()
        signed = signatures_in(rows["signature"].combine_chunks())
        width = signed.shape[1]
        starts = np.array([c[0] for c in np.array_split(np.arange(width), chunks)])
        # Equal signatures of one component and size speak once.
        once = np.sort(np.unique(np.concatenate([labels[:, None], sizes[:, None], block[:, None], signed.view(np.int64)], axis=1), axis=0, return_index=True)[1])
        labels, sizes, block, signed = labels[once], sizes[once], block[once], signed[once]
        two_sides = rows["i"][0].as_py() != rows["j"][0].as_py()
        # All but the largest component's members ask, so those never ask each other.
        names, counts = np.unique(labels, return_counts=True)
        asks = labels != names[counts.argmax()]
        for k in np.flatnonzero(asks):
            rest = (labels != labels[k]) & ~(asks & (np.arange(len(labels)) < k)) & (np.minimum(sizes, sizes[k]) * 100 >= percent * np.maximum(sizes, sizes[k]))
            rest = np.flatnonzero(rest & (block != block[k]) if two_sides else rest)
            if len(rest):
                differ = signed[rest] != signed[k]
                close = np.flatnonzero(differ.sum(axis=1) <= distance)
                if len(close) == 0:
                    continue
                near = rest[close[first_slot(differ[close], starts) == slot]]
                out.update((int(min(labels[k], x)), int(max(labels[k], x))) for x in np.unique(labels[near]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        kept: list[pa.RecordBatch] = []

        def give() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["low", "high"])

        last, last_slot = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            slots = (keys_of(signatures_in(batch.column(6)), chunks) == batch.column(0).to_numpy()[:, None]).argmax(axis=1)
            code = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            edges = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                group = tuple(code[a])
                if group != last and kept:
                    compare(pa.Table.from_batches(kept), last_slot, found)
                    kept = []
                last, last_slot = group, int(slots[a])
                kept.append(batch.slice(a, b - a))
            if len(found) > 100_000:
                yield give()
        if kept:
            compare(pa.Table.from_batches(kept), last_slot, found)
        yield give()

    ordered = open_.repartition(partitions(open_), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(walk, "low long, high long").distinct()


def linked(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(a, b): links between the members of pairs of components; at most one for each member and block.

    The component with more members is the index, in blocks; the members of the other ask.
    """
    size = labels.groupBy("label").agg(F.count("*").alias("rows"))
    sided = pairs.join(size.select(F.col("label").alias("low"), F.col("rows").alias("low_rows")), "low").join(size.select(F.col("label").alias("high"), F.col("rows").alias("high_rows")), "high")
    first = F.col("low_rows") >= F.col("high_rows")
    sided = sided.select(F.when(first, F.col("low")).otherwise(F.col("high")).alias("index"), F.when(first, F.col("high")).otherwise(F.col("low")).alias("asker"), F.ceil(F.greatest("low_rows", "high_rows") / block_rows).cast("int").alias("blocks"))
    whole = labels.join(sets, "rep")
    held = whole.join(sided.select(F.col("index").alias("label"), "blocks").distinct(), "label").select(F.col("label").alias("index"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.col("rep").alias("a"), F.col("set").alias("held"))
    asks = whole.select(F.col("label").alias("asker"), F.col("rep").alias("b"), F.col("set").alias("asked")).join(sided, "asker").select("index", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "b", "asked")

    def compare(index: pa.Table, asking: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if index.num_rows and asking.num_rows:
            column = index["held"].combine_chunks()
            values, edges = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
            sizes, starts, ids = np.diff(edges), edges[:-1], index["a"].to_numpy()
            for name, own in zip(asking["b"].to_pylist(), asking["asked"], strict=True):
                own = own.values.to_numpy().view(np.uint64)  # sorted as such
                fits = np.minimum(sizes, len(own)) * 100 >= percent * np.maximum(sizes, len(own))
                if not fits.any():
                    continue
                at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                both = np.add.reduceat((own[at] == values).astype(np.int64), starts)
                good = np.flatnonzero(fits & (both * 100 >= percent * (sizes + len(own) - both)) & (ids != name))
                if len(good):
                    out_a.append(int(ids[good[0]]))
                    out_b.append(name)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    keys = ["index", "block"]
    return held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, hashes: int = 48, distance: int = 21, block_rows: int = 4096, row_id: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept per row of docs. Rows of one component are near-duplicates by links.

    row_id names a column for the id, or for what stands for it where there is none.
    """
    chunks = (distance + 2) // 2
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = cut(scan(rows, shingle, hashes))
    own = signed.where("n > 0").groupBy("sha").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = cut(own)
    keys = keyed(classes, chunks)
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last")).where("center < last").select("key", "center")
    members = cut(keys.join(shared, "key"))
    sets = cut(sets_of(rows, members.select("rep").distinct(), shingle))

    stars = members.where("rep <> center").groupBy("rep").agg(F.min("center").alias("b")).select(F.col("rep").alias("a"), "b")
    near = components(verified(stars, sets, percent))
    labels = cut(sets.select("rep").distinct().join(near, F.col("rep") == F.col("id"), "left").select("rep", F.coalesce("component", "rep").alias("label")))
    placed = members.select("key", "rep").join(labels, "rep")
    # Keys whose members are all in one component are settled and carry no signatures on.
    unsettled = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    placed = placed.join(unsettled, "key").join(classes.select("rep", "n", "signature"), "rep")
    pairs = cut(across(placed, distance, percent, block_rows, chunks))
    more = linked(pairs, labels, sets, percent, block_rows)
    member = labels.select(F.col("rep").alias("a"), F.col("label").alias("b"))
    joined = components(member.unionByName(more))

    class_of = classes.select("sha", "rep").join(joined, F.col("rep") == F.col("id"), "left").select("sha", F.coalesce("component", "rep").alias("component"))
    # Rows that repeat an id hang together, whatever their texts.
    result = signed.select("id", "sha", "n").join(class_of, "sha", "left")
    twice = signed.groupBy("id").agg(F.min("sha").alias("x"), F.max("sha").alias("y")).where("x <> y").select("id")
    ties = result.join(twice, "id").where(F.col("component").isNotNull() & (F.col("component") != F.col("id"))).select(F.col("id").alias("a"), F.col("component").alias("b")).distinct()
    if not ties.isEmpty():
        hung = components(ties).select(F.col("id").alias("component"), F.col("component").alias("whole"))
        result = result.withColumn("component", F.coalesce("component", "id")).join(hung, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    component = F.coalesce("component", "id")
    name = lambda c: F.when(c < NAMELESS, c)
    return result.select(name(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), name(component).alias("component_id"), (F.col("id") == component).alias("kept"), *([F.col("id").alias(row_id)] if row_id else []))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest id, and of rows that repeat an id the first text in order."""
    stay = groups(docs, id_col=id_col, text_col=text_col, row_id="__stays", **options).where("kept").select("__stays").distinct()
    rows = named(docs, id_col, text_col).join(stay, F.col("__id") == F.col("__stays"), "left_semi")
    first = F.row_number().over(W.partitionBy("__id").orderBy(F.col(text_col).asc_nulls_last()))
    return rows.withColumn("__nth", first).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"), shingle=3, percent=85, distance=17)
