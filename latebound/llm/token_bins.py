"""Token ids as packed binary matrices.

Texts become ids with an end id; documents longer than a row are cut into
pieces, so that the pieces joined give the document's ids again. Pieces are
dealt evenly into shards of about ``shard_tokens`` ids by a hash of document id, piece
and checksum, so shards do not depend on how the input is split. Only rows that repeat
id and text more than ``many`` times (and more than once in a million rows) are dealt by their row number, lest a group
of copies meet in one shard. Ids travel as 2 bytes where the vocabulary allows. Inside a shard they are
packed best-fit-decreasing: the longest piece first, into the fullest row that
still has room. A segment tree over the free room of rows (one leaf per value
up to ``capacity``) finds that row in log(capacity) steps.

A result row is a row of the id matrix: ``ids`` (little-endian unsigned 32-bit,
padded to ``capacity``), ``cu_seqlens`` (0 and the ends of the segments, for
kernels that take packed batches), ``resets`` (where position ids start again
at 0), and per segment ``doc_ids``, ``pieces`` and ``starts`` (place in the
document). ``write_packed`` stores them; ``positions`` and ``unpack`` read them.

Cases: a null or empty text is one piece of one id; equal ids and repeated rows
are pieces of their own; very long texts are cut into
many pieces, which may lie in different shards; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import byte_ids, vocabulary_size

#: How the byte-level vocabulary splits text into words (fixed value of that public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class RoomTree:
    """Counts of rows by free room; finds the least room that is at least a given one."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.sums = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.sums[at] += n
            at >>= 1

    def least_at_least(self, room: int) -> int:
        """-1 if no row has that much room."""
        at = room + self.size
        if self.sums[at]:
            return room
        while at > 1:  # up to the first subtree on the right that has rows, then down its left side
            if not at & 1 and self.sums[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_rows(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of item numbers, by best-fit-decreasing."""
    tree, open_rows, rows = RoomTree(capacity), {}, []
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        room = tree.least_at_least(n)
        if room < 0:
            room, row = capacity, len(rows)
            rows.append([])
        else:
            row = open_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(item)
        if room > n:
            open_rows.setdefault(room - n, []).append(row)
            tree.add(room - n, 1)
    return rows


def _pack_shard(pdf: pd.DataFrame, capacity: int, pad_id: int, dtype: str) -> pd.DataFrame:
    order = pdf[["id", "piece", "ids_crc32"]].sort_values(["id", "piece", "ids_crc32"], kind="stable").index.to_numpy()
    lengths, pieces, starts = (pdf[c].to_numpy()[order] for c in ("length", "piece", "start"))
    raw, ids, shard = pdf["ids"].to_numpy()[order], pdf["id"].to_numpy()[order], int(pdf["shard"].iloc[0])
    out = []
    for k, row in enumerate(best_fit_rows(lengths, capacity)):
        at = np.array(row)
        ends = np.cumsum(lengths[at])
        matrix = np.full(capacity, pad_id, dtype="<u4")
        matrix[:ends[-1]] = np.frombuffer(b"".join([raw[i] for i in row]), dtype=dtype)
        out.append((shard, k, int(ends[-1]), matrix.tobytes(), [0, *ends.tolist()], [0, *ends[:-1].tolist()],
                    ids[at].tolist(), pieces[at].tolist(), starts[at].tolist()))
    return pd.DataFrame(out, columns=["shard", "row", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "pieces", "starts"])


def _pieces(make, end_id: int, capacity: int, dtype: str):
    """Rows ``id, salt, piece, start, length, ids_crc32, ids`` of the documents ``id, text, salt``, in bounded frames."""
    cols = ["id", "salt", "piece", "start", "length", "ids_crc32", "ids"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            rows, held = [], 0
            for ident, text, salt in zip(pdf["id"], pdf["text"], pdf["salt"]):
                ids = np.append(encode(text), np.uint32(end_id)).astype(dtype)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    raw = ids[at:at + capacity].tobytes()
                    rows.append((ident, salt, k, at, len(raw) // ids.itemsize, zlib.crc32(raw), raw))
                    held += len(raw) + 64
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=cols)

    return run


def pack_token_rows(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int = 50256, pad_id: int = 50256, capacity: int = 2048,
                    shard_tokens: int = 1_000_000, many: int = 100) -> DataFrame:
    """Rows of the packed matrices, see above."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    own = F.xxhash64("id", "text")
    groups = source.groupBy(own.alias("own")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"))
    # A token has a byte at least: counting bytes gives enough shards for any text, and needs no tokens.
    total = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("bytes")).first()
    shards = max(1, math.ceil((total["bytes"] or 1) / shard_tokens / 2))
    # At most a million of them: each is more than a millionth of all rows.
    hot = groups.filter(F.col("n") > max(many, (total["n"] or 0) // 1_000_000)).select("own", F.lit(True).alias("hot"))
    salted = source.withColumn("own", own).join(F.broadcast(hot), "own", "left").select(
        "id", "text", F.when(F.col("hot"), F.monotonically_increasing_id() + 1).otherwise(F.lit(0)).alias("salt"))
    kind = source.schema["id"].dataType.simpleString()
    dtype = "<u2" if max(vocabulary_size(ranks_path), end_id + 1) <= 1 << 16 else "<u4"
    pieces = salted.mapInPandas(
        _pieces(partial(byte_ids, ranks_path, PATTERN), end_id, capacity, dtype),
        f"id {kind}, salt long, piece int, start long, length long, ids_crc32 long, ids binary").withColumn(
        "shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "salt"), F.lit(shards)))
    return pieces.groupBy("shard").applyInPandas(
        lambda pdf: _pack_shard(pdf, capacity, pad_id, dtype),
        f"shard long, row int, n_tokens long, ids binary, cu_seqlens array<int>, resets array<int>, "
        f"doc_ids array<{kind}>, pieces array<int>, starts array<long>")


def write_packed(rows: DataFrame, path: str) -> None:
    """The matrix rows as Parquet under ``path``, each shard's rows in order."""
    rows.sortWithinPartitions("shard", "row").write.mode("overwrite").parquet(path)


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a row's segments: each starts at 0."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def unpack(ids: bytes, cu_seqlens: list[int]) -> list[np.ndarray]:
    """The segments' ids of a row."""
    row = np.frombuffer(ids, dtype="<u4")
    return [row[a:b] for a, b in zip(cu_seqlens, cu_seqlens[1:])]
