"""Packing token pieces into sequences by bin completion branch and bound.

What can be packed depends only on how many pieces there are of each length,
at most ``capacity`` numbers whatever the size of the corpus. Spark counts the
lengths; the search on these counts yields fillings (lengths that share a
sequence) with multiplicities; Spark ranks the pieces of each length and the
fillings tell each rank its sequence and offset. Every step of the search uses
up at least one length, so there are at most ``capacity`` fillings.

The search (``pack_lengths``): the incumbent is best-fit-decreasing. At a node
the largest length left must be in some sequence; the undominated fillings of
the room beside it are tried, those with the least waste first. A first pass
tries few of them, each as often as the counts allow, and so gets to the end of
many packings; a second pass tries all of them, as often and less often. A branch is cut when the waste so far
exceeds what a better solution may waste. It ends with proof of the optimum
(the incumbent meets the lower bound, or nothing is left to try) or at the one
limit of work, ``node_limit`` nodes a pass, with the incumbent. That has no more
sequences than best-fit-decreasing, so at most 11/9 of the least number and one.

Cases: a null or empty text is one piece of one id; documents longer than
``capacity`` are cut into pieces of ``capacity``, the last may be shorter; equal
ids and repeated rows are pieces of their own; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize
from .tokens import Encoder, piece_schema, pieces_of, word_bpe

Filling = tuple[int, ...]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit-decreasing on counts: sequences with the same lengths move together."""
    rooms: dict[int, list[tuple[Filling, int]]] = {}

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            rooms.setdefault(room, []).append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in rooms if r >= length), default=capacity)
            fits = room // length
            if room in rooms:
                filling, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            else:
                filling, n = (), -(-left // fits)
            full = min(n, left // fits)
            put(room - fits * length, filling + (length,) * fits, full)
            left -= full * fits
            if full < n and left:  # the last of these sequences takes what is left of this length
                put(room - left * length, filling + (length,) * left, 1)
                left, full = 0, full + 1
            put(room, filling, n - full)
    return [f for r in rooms.values() for f in r]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: the larger of the volume bound and,
    for thresholds k, pieces over half plus what the middle ones need beside them."""
    n = np.array(sorted(counts), dtype=np.int64)
    c = np.array([counts[x] for x in n.tolist()], dtype=np.int64)
    best = -(-int((n * c).sum()) // capacity)
    middle = 2 * n > capacity
    for k in [0, *n[~middle].tolist()]:
        mid = middle & (n <= capacity - k)
        low = int((n * c)[~middle & (n >= k)].sum())
        room = int(((capacity - n) * c)[mid].sum())
        best = max(best, int(c[middle].sum()) + max(0, -(-(low - room) // capacity)))
    return best


def _exact(lengths: list[int], most: list[int], sums: list[int], total: int) -> Iterator[Filling]:
    """Every choice of lengths with the sum ``total``, large lengths first. Only choices that can be completed are
    followed, and one level holds all pieces of a length."""
    def choices(i: int, left: int) -> Iterator[tuple[int, int, int, int]]:
        for j in range(i, len(lengths)):
            if not sums[j] >> left & 1:
                return
            n = lengths[j]
            for k in range(min(most[j], left // n), 0, -1):
                if sums[j + 1] >> (left - k * n) & 1:
                    yield j + 1, left - k * n, n, k

    if not total:
        yield ()
        return
    stack, chosen = [choices(0, total)], []
    while stack:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if chosen:
                chosen.pop()
            continue
        at, left, n, k = step
        if left:
            stack.append(choices(at, left))
            chosen.append((n,) * k)
        else:
            yield tuple(x for part in [*chosen, (n,) * k] for x in part)


def fillings(counts: dict[int, int], room: int) -> Iterator[Filling | None]:
    """All undominated fillings of ``room``, the least waste first, and None for each dominated one passed over. A
    filling is dominated if a length that is left still fits, in place of a smaller one or beside all: a single
    length that fills the room exactly dominates all others."""
    if counts.get(room):
        yield (room,)
        return
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    most = [min(counts[n], room // n) for n in lengths]
    # Bit s of sums[i]: lengths[i:] can fill exactly s.
    sums, mask = [1], (1 << room + 1) - 1
    for n, m in zip(lengths[::-1], most[::-1]):
        reach, step = sums[-1], 1
        while m:
            k = min(step, m)
            reach |= (reach << k * n) & mask
            m, step = m - k, 2 * step
        sums.append(reach)
    sums.reverse()
    for waste in range(room + 1):
        if sums[0] >> (room - waste) & 1:
            for f in _exact(lengths, most, sums, room - waste):
                used = Counter(f)
                spare = [n for n in lengths if counts[n] > used[n]] if waste else []
                yield None if any(x < n <= x + waste for x in [0, *used] for n in spare) else f


def completions(counts: dict[int, int], room: int, limit: int) -> list[Filling]:
    """The first ``limit`` undominated fillings of ``room``, the least waste first, among ``8 * limit`` looked at.
    If all of these are dominated, the greedy one, which never is."""
    first = [f for f in islice(fillings(counts, room), 8 * limit) if f is not None]
    if first:
        return first[:limit]
    greedy: Filling = ()
    for n in sorted(counts, reverse=True):
        k = min(counts[n], room // n)
        greedy, room = (*greedy, *(n,) * k), room - k * n
    return [greedy]


#: So many dominated fillings passed over are as much work as one node.
PASSED = 32
#: Fillings of a node in the first pass.
FIRST = 4


def search(counts: dict[int, int], capacity: int, node_limit: int = 3000) -> tuple[list[tuple[Filling, int]], bool]:
    """Fillings with multiplicities that use every piece exactly once, in as few sequences as found, and whether
    there is proof that no packing has fewer."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return [], True
    best = best_fit_decreasing(counts, capacity)
    used = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    left, path = dict(counts), []

    def put(filling: Filling, times: int) -> None:
        for n, k in Counter(filling).items():
            left[n] -= k * times
            if not left[n]:
                del left[n]

    def take_back(filling: Filling, times: int) -> None:
        for n, k in Counter(filling).items():
            left[n] = left.get(n, 0) + k * times

    def options(whole: bool) -> Iterator[tuple[Filling, int] | None]:
        """The first fillings as often as the counts allow; or all, as often and then less often."""
        big = max(left)
        rest = dict(left)
        rest[big] -= 1
        for fewer in (False, True) if whole else (False,):
            for f in fillings(rest, capacity - big) if whole else completions(rest, capacity - big, FIRST):
                if f is None:
                    yield None
                    continue
                most = min(left[n] // k for n, k in Counter((big, *f)).items())
                for times in range(most - 1, 0, -1) if fewer else (most,):
                    yield (big, *f), times

    for whole in (False, True):
        while path:
            take_back(*path.pop())
        stack, work, wasted = [options(whole)] if used > bound else [], 0, 0
        while stack and used > bound and work < node_limit * PASSED:
            option = next(stack[-1], ())
            if option is None:
                work += 1
                continue
            if not option:
                stack.pop()
                if path:
                    filling, times = path.pop()
                    wasted -= times * (capacity - sum(filling))
                    take_back(filling, times)
                continue
            filling, times = option
            work += PASSED
            waste = times * (capacity - sum(filling))
            # A better solution has at most used - 1 sequences, so it wastes at most this much.
            if wasted + waste > (used - 1) * capacity - total:
                continue
            put(filling, times)
            path.append((filling, times))
            wasted += waste
            if left:
                stack.append(options(whole))
                continue
            if sum(n for _, n in path) < used:
                best, used = list(path), sum(n for _, n in path)
            stack.append(iter(()))
    return best, used <= bound or not stack


def pack_lengths(counts: dict[int, int], capacity: int, *, node_limit: int = 3000) -> list[tuple[Filling, int]]:
    """The fillings of :func:`search`."""
    return search(counts, capacity, node_limit)[0]


def slots(packed: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank of each run of slots, the sequence of that rank, and the offset. Within a
    run, the next rank has the next sequence and the same offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: Counter = Counter()
    base = 0
    for filling, times in packed:
        offset = 0
        for n in filling:
            runs.setdefault(n, []).append((taken[n], base, offset))
            taken[n] += times
            offset += n
        base += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}


def place_pieces(pieces: DataFrame, capacity: int, *, node_limit: int = 3000, salt_rows: int = 100_000) -> DataFrame:
    """``pieces`` (written, with ``id, piece, length, row``) plus ``sequence_id``, ``offset``, ``sequences`` (how many
    there are), ``lower_bound`` (no packing has fewer than that) and ``proven`` (no packing has fewer than this one)."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packed, proven = search(counts, capacity, node_limit)
    table = slots(packed)
    # Ranks per length: a frequent length is dealt over salts, whose counts give each salt its first rank.
    salts = max(1, max(counts.values(), default=0) // salt_rows)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    place = Window.partitionBy("length", "_salt").orderBy("id", "piece", "ids_crc32")
    ranked = (salted.withColumn("_row", F.row_number().over(place)).join(sizes, ["length", "_salt"])
              .withColumn("_rank", F.col("_first") + F.col("_row") - 1))

    @pandas_udf("sequence_id long, offset long")
    def slot(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        seq = np.empty(len(lengths), dtype=np.int64)
        off = np.empty(len(lengths), dtype=np.int64)
        n, r = lengths.to_numpy(), ranks.to_numpy()
        for length in np.unique(n):
            at = n == length
            first, base, offset = table[int(length)]
            run = np.searchsorted(first, r[at], side="right") - 1
            seq[at], off[at] = base[run] + r[at] - first[run], offset[run]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return (ranked.withColumn("_slot", slot("length", "_rank"))
            .select(*[c for c in pieces.columns if c != "row"], "_slot.sequence_id", "_slot.offset",
                    F.lit(sum(n for _, n in packed)).cast("long").alias("sequences"),
                    F.lit(lower_bound(counts, capacity) if counts else 0).cast("long").alias("lower_bound"),
                    F.lit(proven).alias("proven")))


def _word_encoder(path: str) -> Encoder:
    return Encoder(*word_bpe(path))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = 0, capacity: int = 2048, node_limit: int = 3000) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, lower_bound, proven``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cut = pieces_of(partial(_word_encoder, tokenizer_path), end_id, capacity)
    pieces = materialize(
        source.mapInPandas(cut, piece_schema(source.schema["id"].dataType.simpleString()))
        .withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place_pieces(pieces, capacity, node_limit=node_limit).withColumnRenamed("id", "doc_id")

