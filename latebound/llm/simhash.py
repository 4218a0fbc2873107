"""SimHash near-duplicates by a generalised pigeonhole search.

Two fingerprints within ``max_bits`` differing bits are found like this. The
64 bits are grouped into a few parts, correlated bits together. Part i gets a
threshold t_i such that the sum of (t_i + 1) is ``max_bits + 1``; then a pair
within ``max_bits`` agrees within t_i bits in at least one part (-1 means that
a part is not searched). The number of parts and the thresholds come from a
dynamic program that minimises estimated candidates plus probe rows; the
estimates use the share of ones of every bit over all distinct fingerprints.

Every distinct fingerprint is filed under its value in each part and, where
t_i > 0, probes all values within t_i bits. Pairs are verified by the whole 64
bits. A bucket with many members is cut into tiles; every pair of tiles is a
group of its own, so no task holds more than two tiles, and a group returns a
spanning forest of its links, not all of them. Links between different
fingerprints are never lost; documents with equal fingerprints share a node.

Cases: null, empty and blank texts have fingerprint 0 and link like any other;
texts are hashed whole, in bounded chunks; a null id never becomes a
component id unless no other id is in the component; repeated rows and ids are
documents of their own; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize
from .components import connected_components

BITS = 64
SEED = 42


def text_fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned fingerprint of one text: bit i is 1 if set in over half of the shingles' hashes."""
    import xxhash

    words = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only
    if not words:
        return 0
    line = b" ".join(words)
    stops, at = [], -1
    for w in words:
        at += len(w) + 1
        stops.append(at)
    n = max(1, len(words) - shingle + 1)
    ends = stops[min(shingle, len(words)) - 1:]
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in stops[: n - 1]]]
    for lo in range(0, n, 1 << 16):
        part = [digest(line[s:e], SEED) for s, e in zip(starts[lo:lo + (1 << 16)], ends[lo:lo + (1 << 16)])]
        raw = np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(shingle: int = 4):
    """A column function: text to fingerprint, as a long with the same 64 bits."""
    @pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return udf


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct fingerprints, and for each two bits how many have both set."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in batches:
            raw = pdf["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": [*both.ravel(), float(n)]})

    sums = prints.select("fp").mapInPandas(partial, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = dict(sums.collect())  # 4,097 rows at any size
    both = np.array([cells.get(i, 0.0) for i in range(BITS * BITS)]).reshape(BITS, BITS)
    return int(cells.get(BITS * BITS, 0)), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size. Each group starts from
    the bit with the strongest correlations left and takes the bits most
    correlated with what it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        idx = sorted(left)
        group = [idx[int(np.argmax(corr[np.ix_(idx, idx)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < size:
            idx = sorted(left)
            take = idx[int(np.argmax(corr[np.ix_(idx, group)].sum(axis=1)))]
            group.append(take)
            left.discard(take)
        out.append(sorted(group))
    return out


def allocate(n: int, p: np.ndarray, groups: list[list[int]], max_bits: int, probe_cost: float,
             max_radius: int = 2) -> tuple[float, list[int]]:
    """Thresholds per group with sum(t + 1) = max_bits + 1 at least cost, by
    dynamic programming. The cost of a group is its expected candidate pairs
    (bits taken as independent, two fingerprints differ in bit b with
    probability 2 p (1 - p)) plus ``probe_cost`` per row filed or probed."""
    def cost(group: list[int], e: int) -> float:
        if e == 0:
            return 0.0
        if e - 1 > max_radius:
            return math.inf
        dist = np.zeros(e)  # probability of 0 .. e-1 differing bits
        dist[0] = 1.0
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            dist = dist * (1 - q) + np.concatenate([[0.0], dist[:-1]]) * q
        rows = n * (1 + sum(math.comb(len(group), r) for r in range(1, e)))
        return n * n / 2 * float(dist.sum()) + probe_cost * rows

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for e in range(max_bits + 2 - used):
                total = c + cost(group, e)
                if used + e not in nxt or total < nxt[used + e][0]:
                    nxt[used + e] = (total, [*ts, e - 1])
        best = nxt
    return best[max_bits + 1]


def plan_parts(n: int, both: np.ndarray, max_bits: int, probe_cost: float = 20.0) -> list[tuple[list[int], int]]:
    """The cheapest grouping into 2 .. max_bits + 1 parts, as (bits, threshold) of the parts that are searched."""
    p = np.diag(both) / max(n, 1)
    options = []
    for m in range(min(2, max_bits + 1), max_bits + 2):
        groups = group_bits(n, both, m)
        c, ts = allocate(n, p, groups, max_bits, probe_cost)
        options.append((c, m, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda o: (o[0], o[1]))[2]


def _ball(width: int, radius: int) -> list[int]:
    """Non-zero masks of up to ``radius`` of ``width`` bits."""
    from itertools import combinations

    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(width), r)]


def _filed(parts: list[tuple[list[int], int]]):
    """Rows ``part, value, fp, probe`` for each fingerprint."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                fps = pdf["fp"].to_numpy()[lo:lo + 4096]
                bits = fps.view(np.uint64)
                for i, (group, t) in enumerate(parts):
                    value = np.zeros(len(fps), dtype=np.int64)
                    for k, b in enumerate(group):
                        value |= (((bits >> np.uint64(b)) & np.uint64(1)).astype(np.int64)) << k
                    yield pd.DataFrame({"part": i, "value": value, "fp": fps, "probe": False})
                    masks = _ball(len(group), t)
                    step = max(1, 100_000 // max(1, len(fps)))
                    for at in range(0, len(masks), step):
                        m = np.array(masks[at:at + step], dtype=np.int64)
                        yield pd.DataFrame({"part": i, "value": (value[:, None] ^ m[None, :]).ravel(),
                                            "fp": np.repeat(fps, len(m)), "probe": True})

    return run


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a group as (member, its root): each linked set hangs on one member."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def link_fingerprints(prints: DataFrame, max_bits: int = 4, tile: int = 512) -> DataFrame:
    """``prints`` has distinct longs ``fp``. Returns ``node, root`` of every fingerprint linked to another one."""
    n, both = bit_counts(prints)
    parts = plan_parts(n, both, max_bits)
    rows = prints.select("fp").mapInPandas(_filed(parts), "part int, value long, fp long, probe boolean")
    sizes = (rows.groupBy("part", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("filed"))
        .filter("n > 1 and filed > 0"))
    tiles = F.ceil(F.col("n") / tile)
    dealt = (rows.join(sizes, ["part", "value"])
             .withColumn("t", F.pmod(F.xxhash64("fp"), tiles))
             .withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
             .groupBy("part", "value", F.least("t", "u").alias("t"), F.greatest("t", "u").alias("u"))
             .agg(F.collect_set("fp").alias("fps"))
             .filter(F.size("fps") > 1))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = [], []
            for fps in pdf["fps"]:
                x, y = _forest(np.asarray(fps, dtype=np.int64), max_bits)
                a.append(x)
                b.append(y)
            yield pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}, dtype="int64")

    return connected_components(dealt.select("fps").mapInPandas(links, "a long, b long"))


def fingerprint_components(prints: DataFrame, key: str, max_bits: int = 4) -> DataFrame:
    """``prints`` has a fingerprint ``fp`` and an orderable ``key`` per
    document. Returns ``fp, least`` for each distinct fingerprint: the least
    key (nulls last) of its component."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "simhash_nodes")
    roots = materialize(link_fingerprints(nodes, max_bits), "simhash_roots")
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("_best"))
    best = linked.join(best, "root").select("fp", "_best")
    return nodes.join(best, "fp", "left").select("fp", F.coalesce("_best", "least").alias("least"))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                   max_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links."""
    prints = materialize(docs.select(F.col(id_col).alias("_id"), simhash(shingle)(F.col(text_col)).alias("fp")),
                         "simhash_prints")
    comps = fingerprint_components(prints, "_id", max_bits)
    return prints.join(comps, "fp").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"))


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                  max_bits: int = 4) -> DataFrame:
    """``docs`` with one document of each linked group, the one with the smallest id (null last)."""
    cols = docs.columns
    # Written once: the texts are hashed once, and the row number stays the same however often the rows are read.
    kept = materialize(docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)],
                                   simhash(shingle)(F.col(text_col)).alias("fp"),
                                   F.monotonically_increasing_id().alias("row")), "simhash_docs")
    ident = F.col(f"c{cols.index(id_col)}")
    key = F.struct(ident.isNull().alias("no"), ident.alias("id"), F.col("row"))
    prints = kept.select("fp", key.alias("key"))
    first = fingerprint_components(prints, "key", max_bits).select(F.col("least.row").alias("row")).distinct()
    return kept.join(first, "row", "left_semi").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
