"""Approximate nearest neighbours with a permutation index.

The largest inner product is turned into the least distance: vectors are parted into bands of like
length, and in a band with longest length M a vector gets one more component, sqrt(M^2 - |x|^2), so all
have length M and order by cosine to a query as they do by inner product. Each band has its own pivots, a
bounded share of its vectors drawn by a hash of their values. A vector's permutation holds its `prefix`
nearest pivots in order.

Every vector is posted once, in the inverted file of its nearest pivot, with its permutation. Files of
neighbouring pivots form shards. A query goes to the shards of the files of its nearest pivots only; there
the footrule distance (differences of places, a pivot that one side doesn't name counting as place
`prefix`) is summed through postings of the shard's permutations, what lies under the query's bar is
ranked on the original vectors, and the best are merged. The bar is the distance that a share of the
band's pivots stay under. Before that a query visits the few shards of the pivots it scores best with.
What k + 1 of their vectors reach is a floor for its answer, so from the other shards only better ones
return, and a band is left out where even its longest vector along the query would score less.

How many files are visited and how high the bar is, is one of the EFFORTS, the last of which leaves out
nothing. It is found by an audit: one pass compares a bounded sample of queries with all vectors and sees
at which effort each true neighbour would be found; the least effort that reaches `target` is taken.

Equal vectors are one class, indexed once, with the k + 1 smallest of its ids, and equal queries are asked
once, so no group of copies crowds a file or a task. A shard beyond rows_per_block is cut into blocks;
queries stream past a block, so memory is bounded by the block.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. Ties go to the smaller id. Rows that repeat an id and vector are one row; an id that comes with
several vectors is found once, by its best, and asked once for each, the best of all being its answer. No
query finds its own id. Fewer candidates than asked for give fewer rows; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions, read

#: (share of a band's files that is visited, share of the band that stays under the bar), from cheap to whole.
EFFORTS = ((0.01, 0.01), (0.03, 0.03), (0.06, 0.05), (0.12, 0.08), (0.25, 0.15), (0.4, 0.2), (0.6, 0.3), (0.7, 0.4), (0.8, 0.5), (0.9, 0.7), (1.0, 1.0))
#: Bands of fewer pivots have no bar, and this many of the nearest files are always visited.
FEW_PIVOTS, FEW_FILES = 20, 4
RATIO, LAST_BAND = 1.25, 40
RESULT = "query_id long, rank int, vec_id long, score double, audit_recall double"


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles from an Arrow list column without nulls."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def kind_of(df: DataFrame) -> str:
    return df.schema["v"].dataType.simpleString()


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row by inner product, nearest first."""
    out, step = np.empty((len(x), min(prefix, len(pivots))), np.int32), max(1, (1 << 22) // len(pivots))
    for a in range(0, len(x), step):
        far = -np.round(x[a : a + step] @ pivots.T, 12)
        if prefix < len(pivots):
            near = np.sort(np.argpartition(far, prefix - 1, axis=1)[:, :prefix], axis=1)
            out[a : a + step] = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        else:
            out[a : a + step] = np.argsort(far, axis=1, kind="stable")
    return out


class InvertedFiles:
    """Posting lists of pivots over some permutations."""

    def __init__(self, permutations: np.ndarray, pivots: int):
        rows, prefix = permutations.shape
        named, self.rows, self.prefix = permutations.ravel(), rows, prefix
        order = np.argsort(named, kind="stable")
        self.edges = np.searchsorted(named[order], np.arange(pivots + 1))
        self.posted, self.place = order // prefix, (order % prefix).astype(np.int32)

    def gains(self, asked: np.ndarray) -> np.ndarray:
        """Queries by rows: by how much each footrule distance falls short of that of disjoint lists, halved.

        Both name a pivot: |i - j|; one does: prefix - its place. So a pivot that both name saves 2 (prefix - max(i, j)).
        """
        out = np.zeros((len(asked), self.rows), np.int32)
        named, order = asked.ravel(), np.argsort(asked.ravel(), kind="stable")
        pivots, starts = np.unique(named[order], return_index=True)
        for pivot, a, b in zip(pivots, starts, np.r_[starts[1:], len(order)], strict=True):
            c, d = self.edges[pivot], self.edges[pivot + 1]
            if c < d:
                rows, i = order[a:b] // self.prefix, self.prefix - (order[a:b] % self.prefix)
                out[rows[:, None], self.posted[c:d]] += np.minimum(i[:, None], self.prefix - self.place[c:d]).astype(np.int32)
        return out


@dataclass
class Band:
    """Vectors of like length: the longest length, the pivots (unit, with the added component) with their own postings, the shard of each."""

    longest: float
    pivots: np.ndarray
    prefix: int
    shard_of: np.ndarray
    shards: int
    postings: InvertedFiles | None = None

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.concatenate([x, rest[:, None]], axis=1) / self.longest

    def permutations(self, x: np.ndarray) -> np.ndarray:
        return nearest_pivots(self.lifted(x), self.pivots, self.prefix)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All pivots from a query's view; its added component is 0."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        return nearest_pivots(unit, self.pivots[:, :-1], len(self.pivots))

    def bars(self, order: np.ndarray) -> np.ndarray:
        """Queries by efforts: the least gain that a row needs."""
        n = len(self.pivots)
        if n < FEW_PIVOTS:
            return np.zeros((len(order), len(EFFORTS)), np.int32)
        gains = np.sort(self.postings.gains(order[:, : self.prefix]), axis=1)
        at = [max(0, n - 1 - int(share * n)) for _, share in EFFORTS]
        return np.where([share >= 1 for _, share in EFFORTS], 0, gains[:, at])

    def files(self, effort: int) -> int:
        return min(len(self.pivots), max(FEW_FILES, int(np.ceil(EFFORTS[effort][0] * len(self.pivots)))))


@dataclass
class Index:
    bands: dict[int, Band]
    top: float  # length of the longest vector
    sample: np.ndarray  # the pivots as they are
    leads: np.ndarray  # their smallest ids
    band_at: np.ndarray  # their bands
    place_at: np.ndarray  # and their places there
    k: int

    def band_of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(LAST_BAND, np.floor(np.log(self.top / np.linalg.norm(x, axis=1)) / np.log(RATIO) + 1e-9)).astype(np.int32)

    def floors(self, q: np.ndarray) -> np.ndarray:
        """A score that k + 1 different ids reach for certain, for each query."""
        ids = np.unique(self.leads, return_inverse=True)[1]
        if len(ids) == 0 or ids.max() < self.k:
            return np.full(len(q), -np.inf)
        out = np.empty(len(q))
        for at, scores in enumerate(q @ self.sample.T):
            best = np.full(ids.max() + 1, -np.inf)
            np.maximum.at(best, ids, scores)
            low = np.partition(best, len(best) - self.k - 1)[len(best) - self.k - 1]
            out[at] = low - 1e-9 * (1 + abs(low))
        return out


def distinct_classes(rows: DataFrame, k: int) -> DataFrame:
    """(c, v, ids) per different vector: a number and its k + 1 smallest ids in order."""
    nth = F.row_number().over(W.partitionBy("v").orderBy("id"))  # with its bound each task passes on k + 1 rows a class
    few = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.monotonically_increasing_id().alias("c"), "v", "ids")


def fit(classes: DataFrame, *, k: int, pivots: int, rows_per_pivot: int, prefix: int, rows_per_shard: int) -> Index:
    """What comes to the driver: a row for each band, and the pivots, about `pivots` at most."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = classes.agg(F.count("*").alias("n"), F.max(length).alias("top")).first()
    n, top = found["n"], found["top"]
    share = min(1.0, max(64, min(pivots, n // rows_per_pivot)) / n)
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("pivot"), "v"), F.lit(1 << 40)) < int(share * (1 << 40))).select("v", F.col("ids")[0].alias("lead")).collect()
    drawn.sort(key=lambda r: (r.lead, list(r.v)))
    sample = np.array([list(r.v) for r in drawn], np.float64).reshape(len(drawn), -1)
    index = Index({}, top, sample, np.array([r.lead for r in drawn], np.int64), np.empty(0, np.int64), np.zeros(len(drawn), np.int64), k)
    number = F.least(F.lit(LAST_BAND), F.floor(F.log(F.lit(top) / length) / np.log(RATIO) + 1e-9)).cast("int")
    of = index.band_of(sample) if len(sample) else np.empty(0, np.int32)
    for row in classes.groupBy(number.alias("band")).agg(F.count("*").alias("rows"), F.max(length).alias("longest")).collect():
        for b in (row.band - 1, row.band, row.band + 1):  # a rounding apart, a vector may fall into the next
            known = index.bands.get(b)
            longest, size = max(row.longest, known.longest if known else 0.0), row.rows if b == row.band else 0
            index.bands[b] = Band(longest, np.empty((0, 0)), prefix, np.empty(0, np.int32), max(size, known.shards if known else 0))
    index.band_at = of
    for b, band in index.bands.items():
        own = sample[of == b]
        index.place_at[of == b] = np.arange(len(own))
        band.longest *= 1 + 1e-12
        if len(own) == 0:
            band.shards = 1
            continue
        band.pivots, band.prefix = band.lifted(own), min(prefix, len(own))
        band.shards = max(1, min(len(own), -(-band.shards // rows_per_shard)))
        band.shard_of = nearest_pivots(band.pivots, band.pivots[: band.shards], 1)[:, 0]
        band.postings = InvertedFiles(band.permutations(own), len(own))
    return index


def posted(classes: DataFrame, index: Index) -> DataFrame:
    """(shard, c, ids, v, file, perm): each class in the file of its nearest pivot."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x = matrix(batch.column(1))
            of = index.band_of(x) if len(x) else np.empty(0, np.int32)
            shard, file, perm = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int32), [b""] * len(x)
            for b in np.unique(of):
                rows, band = np.flatnonzero(of == b), index.bands[int(b)]
                shard[rows] = int(b) << 32
                if len(band.pivots):
                    own = band.permutations(x[rows])
                    file[rows] = own[:, 0]
                    shard[rows] += band.shard_of[own[:, 0]]
                    for r, p in zip(rows, own, strict=True):
                        perm[r] = p.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(2), batch.column(1), pa.array(file), pa.array(perm, pa.binary())], names=["shard", "c", "ids", "v", "file", "perm"])

    return classes.select("c", "v", "ids").mapInArrow(deal, f"shard long, c long, ids array<long>, v {kind_of(classes)}, file int, perm binary")


ROUTED = "shard long, q long, v {kind}, files array<int>, perm binary, bar int, floor double"


def packed(rows: list[tuple], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows (shard, place in the batch, files, perm, bar, floor) with the queries they are about."""
    for a in range(0, len(rows), 10_000):
        shard, i, files, perm, bar, floor = zip(*rows[a : a + 10_000], strict=True)
        at = pa.array(i, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(files, pa.list_(pa.int32())), pa.array(perm, pa.binary()), pa.array(bar, pa.int32()), pa.array(floor, pa.float64())], names=["shard", "q", "v", "files", "perm", "bar", "floor"])


def homeward(asked: DataFrame, index: Index, pivots: int = 4) -> DataFrame:
    """As routed: each query to the shards of the pivots that it scores best with, all of whose files it visits."""
    shared = asked.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            q = matrix(batch.column(1))
            if len(q) == 0 or len(index.sample) == 0:
                continue
            rows = []
            for i, scores in enumerate(q @ index.sample.T):
                best = np.argsort(-scores, kind="stable")[:pivots]
                for b, s in {(int(index.band_at[p]), int(index.bands[int(index.band_at[p])].shard_of[index.place_at[p]])) for p in best}:
                    band = index.bands[b]
                    rows.append(((b << 32) + s, i, np.flatnonzero(band.shard_of == s).astype(np.int32), bytes(4 * band.prefix), 0, -np.inf))
            yield from packed(rows, batch)

    return asked.select("q", "v").mapInArrow(deal, ROUTED.format(kind=kind_of(asked)))


def routed(asked: DataFrame, index: Index, effort: int) -> DataFrame:
    """(shard, q, v, files, perm, bar, floor): each query (q, v, floor) to the shards it asks, with the files it visits there."""
    shared = asked.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            q = matrix(batch.column(1))
            if len(q) == 0:
                continue
            known = batch.column(2).to_numpy(zero_copy_only=False)
            floor, reach = np.maximum(index.floors(q), known - 1e-9 * (1 + np.abs(known))), np.linalg.norm(q, axis=1)
            rows: list[tuple] = []
            for b, band in index.bands.items():
                part = np.flatnonzero(reach * band.longest >= floor)
                if len(part) == 0:
                    continue
                if len(band.pivots) == 0:
                    rows += [(b << 32, int(i), [-1], b"", 0, floor[i]) for i in part]
                    continue
                for a in range(0, len(part), 256):
                    some = part[a : a + 256]
                    order = band.order(q[some])
                    bars, visits = band.bars(order)[:, effort], order[:, : band.files(effort)]
                    for i, own, bar, files in zip(some, order, bars, visits, strict=True):
                        shards = band.shard_of[files]
                        by = np.argsort(shards, kind="stable")
                        cuts = np.flatnonzero(np.diff(shards[by])) + 1
                        perm = own[: band.prefix].tobytes()
                        rows += [((b << 32) + int(shards[g[0]]), int(i), files[g], perm, int(bar), floor[i]) for g in np.split(by, cuts)]
            yield from packed(rows, batch)

    return asked.select("q", "v", "floor").mapInArrow(deal, ROUTED.format(kind=kind_of(asked)))


def first_ids(scores: np.ndarray, members: list[np.ndarray], k: int) -> list[tuple[int, float]]:
    """The k best different ids of scored classes, ties to the smaller id."""
    lead = np.array([own[0] for own in members], np.int64)
    ids: dict[int, float] = {}
    for c in np.lexsort((lead, -scores)):
        if len(ids) >= k and scores[c] < min(ids.values()):
            break
        for i in members[c]:
            ids[int(i)] = max(ids.get(int(i), -np.inf), float(scores[c]))
    return sorted(ids.items(), key=lambda p: (-p[1], p[0]))[:k]


class Block:
    """Classes of one block of a shard, ready for queries."""

    def __init__(self, rows: pa.Table):
        ids = rows["ids"].combine_chunks()
        self.members = np.split(ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy())[:-1])
        self.x, self.file = matrix(rows["v"]), rows["file"].to_numpy()
        perms = np.frombuffer(b"".join(rows["perm"].to_pylist()), np.int32).reshape(len(self.x), -1)
        self.vocabulary = np.unique(perms)
        self.postings = InvertedFiles(np.searchsorted(self.vocabulary, perms), len(self.vocabulary) + 1) if perms.shape[1] else None

    def answer(self, asks: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, float]]:
        q, number = matrix(asks.column("v")), asks.column("q").to_numpy()
        scores = q @ self.x.T
        good = scores >= asks.column("floor").to_numpy()[:, None]
        files = asks.column("files")
        visited = np.zeros((len(q), self.file.max() + 2), bool)
        wanted, of = files.flatten().to_numpy() + 1, np.repeat(np.arange(len(q)), files.value_lengths().to_numpy())
        here = wanted < visited.shape[1]
        visited[of[here], wanted[here]] = True
        good &= visited[:, self.file + 1]
        if self.postings is not None:
            perms = np.frombuffer(b"".join(asks.column("perm").to_pylist()), np.int32).reshape(len(q), -1)
            at = np.minimum(np.searchsorted(self.vocabulary, perms), len(self.vocabulary) - 1)
            known = np.where(self.vocabulary[at] == perms, at, len(self.vocabulary))  # the last: in no permutation here
            good &= self.postings.gains(known) >= asks.column("bar").to_numpy()[:, None]
        for i in range(len(q)):
            chosen = np.flatnonzero(good[i])
            if len(chosen) > k:
                near = scores[i, chosen]
                chosen = chosen[near >= np.partition(near, len(near) - k)[len(near) - k] - 1e-9 * (1 + np.abs(near).max())]
            if len(chosen):
                exact = (self.x[chosen] * q[i]).sum(axis=1)
                for name, score in first_ids(exact, [self.members[c] for c in chosen], k):
                    yield int(number[i]), name, score


def answered(data: DataFrame, asks: DataFrame, k: int, rows_per_block: int) -> DataFrame:
    """(q, vec_id, score): the best of each block of a shard for each query that visits it."""
    size = data.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("blocks"))
    held = data.join(size, "shard").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    held = held.select("shard", "block", F.lit(0).alias("kind"), F.col("c").alias("q"), "v", "ids", "file", F.array().cast("array<int>").alias("files"), "perm", F.lit(0).alias("bar"), F.lit(0.0).alias("floor"))
    asking = asks.join(size, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.select("shard", "block", F.lit(1).alias("kind"), "q", "v", F.array().cast("array<long>").alias("ids"), F.lit(-1).alias("file"), "files", "perm", "bar", "floor")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, block = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            shard, part, kind = (batch.column(c).to_numpy() for c in range(3))
            edges = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                if (shard[a], part[a]) != key:
                    key, waiting, block = (shard[a], part[a]), [], None
                if kind[a] == 0:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if block is None and waiting:
                    block, waiting = Block(pa.Table.from_batches(waiting)), []
                for s in range(a, b, 512) if block else ():
                    found = list(block.answer(batch.slice(s, min(512, b - s)), k))
                    q, name, score = zip(*found, strict=True) if found else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(name, pa.int64()), pa.array(score, pa.float64())], names=["q", "vec_id", "score"])

    ordered = held.unionByName(asking).repartition(partitions(data), "shard", "block").sortWithinPartitions("shard", "block", "kind")
    return ordered.mapInArrow(walk, "q long, vec_id long, score double")


def audited(classes: DataFrame, asked: DataFrame, index: Index, k: int, rows: int, target: float) -> tuple[int, float]:
    """The least effort that finds `target` of the true neighbours of a bounded sample of queries, and its recall."""
    drawn = asked.orderBy(F.xxhash64(F.lit("audit"), "v"), "v").limit(rows).select("v").collect()
    if not drawn:
        return 0, 1.0
    q = np.array([list(r.v) for r in drawn], np.float64)
    shared = classes.sparkSession.sparkContext.broadcast((index, q))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, q = shared.value
        views: dict[int, tuple] = {}
        best: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for batch in batches:
            x = matrix(batch.column(1))
            if len(x) == 0:
                continue
            names, scores = batch.column(0).to_numpy(), q @ x.T
            near = min(k + 1, len(x))
            top = np.argpartition(-scores, near - 1, axis=1)[:, :near]
            apart = (x[top] != q[:, None, :]).any(axis=2)  # a query is no neighbour of itself
            wanted = np.unique(top)
            of, level = index.band_of(x[wanted]), np.zeros((len(q), len(wanted)), np.int32)
            for b in np.unique(of):
                cols, band = np.flatnonzero(of == b), index.bands[int(b)]
                if len(band.pivots) == 0:
                    continue
                if b not in views:
                    order = band.order(q)
                    views[b] = order[:, : band.prefix], np.argsort(order, axis=1), np.concatenate([band.bars(order[a : a + 256]) for a in range(0, len(q), 256)])
                prefix, rank, bars = views[b]
                perms = band.permutations(x[wanted[cols]])
                gains = InvertedFiles(perms, len(band.pivots)).gains(prefix)
                misses = np.zeros(gains.shape, np.int32)
                for e in range(len(EFFORTS)):
                    misses += ~((rank[:, perms[:, 0]] < band.files(e)) & (gains >= bars[:, e, None]))
                level[:, cols] = misses
            at = np.searchsorted(wanted, top)
            for i in range(len(q)):
                own = apart[i]
                best[i] += zip(scores[i, top[i, own]].tolist(), names[top[i, own]].tolist(), level[i, at[i, own]].tolist(), strict=True)
                best[i] = sorted(best[i], key=lambda p: (-p[0], p[1]))[:k]
        found = [(i, *p) for i, own in enumerate(best) for p in own]
        i, score, _, lev = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(score, pa.float64()), pa.array(lev, pa.int32())], names=["i", "score", "level"])

    nth = F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "level"))
    rows_ = classes.select("c", "v").mapInArrow(compare, "i int, score double, level int").withColumn("nth", nth).where(F.col("nth") <= k)
    counts = {r.level: r["count"] for r in rows_.groupBy("level").count().collect()}
    total, found = sum(counts.values()), 0
    for effort in range(len(EFFORTS)):
        found += counts.get(effort, 0)
        if found >= target * total:
            return effort, found / max(total, 1)
    return len(EFFORTS) - 1, found / max(total, 1)


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, pivots: int = 16_384, rows_per_pivot: int = 64, prefix: int = 32, rows_per_shard: int = 1024, rows_per_block: int = 8192, audit_queries: int = 128, target: float = 0.98, effort: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score, audit_recall: the k vectors of largest inner product found for each query.

    pivots bounds the sample that the index is fitted on; every different vector is posted. effort, if
    given, is taken in place of the one that the audit finds.
    """
    own = lambda df: df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows, asked = own(vectors), own(queries)
    if kind_of(rows) != kind_of(asked) or kind_of(rows) != "array<float>":
        rows, asked = (df.withColumn("v", F.col("v").cast("array<double>")) for df in (rows, asked))
    width = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not width:
        return rows.sparkSession.createDataFrame([], RESULT)
    width = width[0]["n"]
    classes = cut(distinct_classes(rows.where(F.size("v") == width), k))
    asked = asked.where(F.size("v") == width).distinct()
    different = cut(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("q"), "v"))
    index = fit(classes, k=k, pivots=pivots, rows_per_pivot=rows_per_pivot, prefix=prefix, rows_per_shard=rows_per_shard)
    if effort is None:
        effort, recall = audited(classes, different, index, k, audit_queries, target)
    else:
        recall = None
    files = cut(posted(classes, index))
    # An answer holds k ids beside the query's own, so k + 1 of each different query are enough.
    near = cut(answered(files, homeward(different, index), k + 1, rows_per_block))
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    floors = near.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    floors = floors.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") > k).select("q", "floor")
    wanted = different.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = answered(files, routed(wanted, index, effort), k + 1, rows_per_block).unionByName(near)
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    answers = asked.join(different, "v").select("id", "q").join(found, "q").where(F.col("id") != F.col("vec_id"))
    answers = answers.groupBy("id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    return answers.select(F.col("id").alias("query_id"), rank.alias("rank"), "vec_id", "score", F.lit(recall).cast("double").alias("audit_recall")).where(F.col("rank") <= k)


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
