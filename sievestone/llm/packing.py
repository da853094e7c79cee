"""Best-fit packing of token sequences into bins with several capacities.

Documents are tokenised in Arrow batches and cut only where they exceed a bin: the remainder comes
first and full bins follow, so a full piece is a sequence by itself and only one short piece per
document is left to place. Short pieces meet in groups of a bounded number of rows, dealt by row
number so that no document, length or source can crowd one group, and each group is packed by vector
best-fit decreasing: a bin has residual tokens, documents and attention cost (the sum of squared
lengths), a piece must fit under all three, and among the bins where it fits it goes to the one whose
weighted residual norm (or, by choice, weighted dot product of piece and residual) is best. Groups are
large enough that each wastes less than one bin in a thousand beyond what a global packing would.

Null and empty texts consist of the end token alone. Rows are packed one by one, so repeated rows and
ties each get a place of their own. An empty table gives an empty result. Columns beside id and text
are not read. Texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

END = 2
#: Characters on which two tokenizer libraries could hold different Unicode tables, and white space so long that
#: the faster one's pattern runs out of stack on it; such texts take the slower one.
UNUSUAL = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]|<\\||[\t\n\r ]{1000}")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CHUNK = 1 << 21


class Tokenizer:
    """Byte-level BPE ids as the tokenizers library gives them for a vocabulary file.

    The same vocabulary as ranks, where a file of that name lies beside it, is used for texts of usual
    characters: it gives equal ids in a quarter of the time. Other texts go to the tokenizers library.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Whole

        self.whole, self.fast = Whole.from_file(path), None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not UNUSUAL.search(text):
            try:
                return self.fast.encode_to_numpy(text)
            except ValueError:  # its pattern gave up; nothing was encoded
                pass
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, *, id_col: str, text_col: str, capacity: int, vocabulary: str | None) -> DataFrame:
    """One row per piece; a document's last token is END."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary or default_vocabulary())
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                tokens = np.append(tokenizer.ids(text) if text else np.empty(0, np.uint32), END).astype("<u4")
                first = (len(tokens) - 1) % capacity + 1
                edges = [0, *range(first, len(tokens) + 1, capacity)]
                name = ids[at].as_py()
                rows += [(name, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenise, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, documents: int, attention: int, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, by vector best-fit decreasing under the three capacities.

    Pieces of one length are alike, so they are placed together. Under the norm rule a bin that got one
    stays the best until it is full, since every residual shrank: filling the bins in the order of
    their norms is what placing the pieces one by one would do. Under the dot rule, which favours the
    emptiest aligned bin, each round gives one piece to each bin in the order of their products. A
    piece that exceeds a capacity by itself gets a bin of its own.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    full = np.array([capacity, documents, attention], float)
    w = np.asarray(weights) / full**2
    residual, used, opened = np.empty((1024, 3)), np.zeros(1024, np.int64), 0
    order = np.argsort(-lengths, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0]) if n else np.empty(0, int)
    for a, b in zip(starts, np.r_[starts[1:], n], strict=True):
        waiting, size = order[a:b], int(lengths[order[a]])
        demand = np.array([size, 1, size * size], float)
        while len(waiting):
            left = residual[:opened]
            fits = np.flatnonzero((left >= demand).all(axis=1))
            if len(fits) == 0:
                break
            if rule == "norm":
                best = fits[np.argsort(((left[fits] - demand) ** 2 * w).sum(axis=1), kind="stable")]
                room = np.floor((left[best] / demand).min(axis=1)).astype(np.int64)
            else:
                best = fits[np.argsort(-(left[fits] * demand * w).sum(axis=1), kind="stable")]
                room = np.ones(len(best), np.int64)
            ends = np.cumsum(room)
            take = int(np.searchsorted(ends, len(waiting))) + 1
            best, room = best[:take], room[:take].copy()
            if take <= len(ends) and ends[take - 1] > len(waiting):
                room[-1] -= ends[take - 1] - len(waiting)
            now = int(room.sum())
            which = np.repeat(best, room)
            nth = np.arange(now) - np.repeat(np.cumsum(room) - room, room)
            bins[waiting[:now]], offsets[waiting[:now]] = which, used[which] + nth * size
            residual[best] -= room[:, None] * demand
            used[best] += room * size
            waiting = waiting[now:]
        if len(waiting):
            each = max(1, int(np.floor((full / demand).min())))
            new = -(-len(waiting) // each)
            while opened + new > len(residual):
                residual, used = np.concatenate([residual, np.empty_like(residual)]), np.concatenate([used, np.zeros_like(used)])
            at = np.arange(len(waiting))
            bins[waiting], offsets[waiting] = opened + at // each, (at % each) * size
            count = np.bincount(at // each, minlength=new)
            residual[opened : opened + new] = full - count[:, None] * demand
            used[opened : opened + new] = count * size
            opened += new
    return bins, offsets


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", vocabulary: str | None = None, rows_per_group: int = 100_000) -> DataFrame:
    """A row per piece with its sequence and its place there; capacities that are not given do not bind.

    Pieces that fill a sequence alone have negative sequence ids, packed ones the group's number times
    2**32 plus the bin.
    """
    documents, attention = documents or capacity, attention or capacity * capacity
    cut_up = cut(pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, vocabulary=vocabulary))
    alone = F.col("length") >= capacity
    whole = cut_up.where(alone).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut_up.where(~alone).withColumn("row", F.monotonically_increasing_id())
    groups = max(1, -(-short.count() // rows_per_group))
    short = short.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        bins, offsets = best_fit(table["length"].to_numpy(), capacity, documents, attention, weights, rule)
        group = table["group"][0].as_py() << 32
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(bins + group)).append_column("offset", pa.array(offsets))

    packed = short.groupBy("group").applyInArrow(place, f"{PIECES}, sequence_id long, offset long")
    return packed.unionByName(whole)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
