"""Near-duplicate embeddings by NN-descent.

Equal vectors are one node with a count. Every node keeps a list of neighbours.

1. Start: the nodes are sorted by codes of random hyperplanes, ``orders`` times
   with other planes, more often if there are many nodes (``orders_for``); near
   vectors share long code prefixes. In each order, blocks of ``block``
   consecutive nodes, overlapping by half, are compared, and each node's best
   are listed.
2. Descent: around each node, its neighbours and those that list it (cut into
   random blocks if there are many) are compared with each other; who finds
   better neighbours lists them. A list in which all are over the threshold is
   saturated and may grow to ``most``, then to twice its length in each round.
   Rounds go on until one joins no more components.
3. Lists are cut, links are not: every comparison also gives a spanning forest
   of all its links, and the components are those of the forests.
4. Audit: nodes, chosen by hash, are compared with all nodes, ``audit`` first
   and then more until ``audit_linked`` of them had links or all were compared.
   Links that it finds join components too. If less than ``recall`` of the nodes
   with links had them all inside their component, the descent starts again with
   more orders; after the last attempt the audit goes on over all nodes, which
   is the exact comparison.
5. Components hold what links with what; links are counted exactly inside each
   component, in tiles of ``tile`` by ``tile`` nodes, so that a group of very
   many near copies neither lands in one task nor becomes a table of all its
   pairs.

Cosines are computed in double precision. Only edges of at least ``reach`` are
followed: two vectors that link with the same one are that near to each other.

Cases: null and zero vectors, and vectors with null, infinite or NaN components
or another number of components than most link with nothing and are their own
component; repeated rows and ids are vectors of their own (equal ids are one in
the component's least id); an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .stages import written


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that ``near`` says: fewer edges than nodes, the same components."""
    free = near.any(axis=1)
    u, v = [], []
    for start in np.flatnonzero(free):
        if free[start]:
            free[start], todo = False, [start]
            while todo:
                at = todo.pop()
                new = np.flatnonzero(near[at] & free)
                free[new] = False
                u += [at] * len(new)
                v += new.tolist()
                todo += new.tolist()
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _best(ids: np.ndarray, x: np.ndarray, keep: int, reach: float, threshold: float) -> list[np.ndarray]:
    """For each of ``ids`` the ``keep`` nearest others of at least ``reach``, and a forest of all that link."""
    sims = x @ x.T
    sims[ids[:, None] == ids[None, :]] = -2
    k = min(keep, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    best = np.take_along_axis(sims, top, axis=1)
    ok = best >= reach
    a, b = _forest(sims >= threshold)
    return [np.concatenate([np.repeat(ids, ok.sum(axis=1)), ids[a]]), np.concatenate([ids[top][ok], ids[b]]),
            np.concatenate([best[ok], sims[a, b]]), np.arange(ok.sum() + len(a)) >= ok.sum()]


def _frame(parts: list[list[np.ndarray]]) -> pd.DataFrame:
    if not parts:
        return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64), "sim": np.empty(0),
                             "tree": np.empty(0, bool)})
    u, v, sim, tree = (np.concatenate(p) for p in zip(*parts))
    return pd.DataFrame({"u": u, "v": v, "sim": sim, "tree": tree})


#: Edges of lists, which are cut, and edges of forests (``tree``), which are not.
EDGES = "u long, v long, sim double, tree boolean"


def _blocks(block: int, keep: int, reach: float, threshold: float):
    """Edges inside blocks of consecutive rows; each block starts with the second half of the one before."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            parts = []
            while len(held) >= block:
                head = held.iloc[:block]
                ids, x = head["id"].to_numpy(), _unit(head["vec"])
                parts.append(_best(ids, x, keep, reach, threshold))
                held = held.iloc[block // 2:]
            yield _frame(parts)
        if held is not None and len(held):
            ids, x = held["id"].to_numpy(), _unit(held["vec"])
            yield _frame([_best(ids, x, keep, reach, threshold)])

    return run


def _codes(planes: np.ndarray):
    """Rows ``turn, code`` for each node: the signs of 62 hyperplanes as a number."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = (1 << np.arange(planes.shape[1], dtype=np.int64))[::-1]
        for pdf in batches:
            if pdf.empty:
                continue
            x = _unit(pdf["vec"])
            for turn in range(len(planes)):
                code = ((x @ planes[turn].T) > 0).astype(np.int64) @ weights
                yield pd.DataFrame({"turn": turn, "code": code, "id": pdf["id"].to_numpy(), "vec": pdf["vec"].to_numpy()})

    return run


def start_lists(nodes: DataFrame, dim: int, orders: int, block: int, keep: int, reach: float,
                threshold: float, seed: int) -> DataFrame:
    """Edges among near rows of each random order."""
    planes = np.random.default_rng(seed).standard_normal((orders, 62, dim))
    coded = written(nodes.select("id", "vec").mapInPandas(
        _codes(planes), f"turn int, code long, id long, vec {nodes.schema['vec'].dataType.simpleString()}"), "nn_codes")
    return coded.repartitionByRange("turn", "code", "id").sortWithinPartitions("turn", "code", "id").mapInPandas(
        _blocks(block, keep, reach, threshold), EDGES)


def _local_joins(keep: int, reach: float, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for members in pdf["members"]:
                ids = np.array([m["id"] for m in members], dtype=np.int64)
                x = _unit(pd.Series([m["vec"] for m in members]))
                parts.append(_best(ids, x, keep, reach, threshold))
            yield _frame(parts)

    return run


def best_lists(edges: DataFrame, keep: int, grown: int, threshold: float) -> DataFrame:
    """Each node's ``keep`` best neighbours; up to ``grown`` where all of them are over the threshold."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return (edges.filter("not tree").dropDuplicates(["u", "v"]).withColumn("place", place)
            .filter((F.col("place") <= keep) | ((F.col("place") <= grown) & (F.col("sim") >= threshold))).drop("place"))


def compare_around(nodes: DataFrame, edges: DataFrame, grown: int, reach: float, threshold: float,
                   block: int) -> DataFrame:
    """One round: neighbours and reverse neighbours of each node are compared with each other."""
    around = edges.select(F.col("u").alias("w"), F.col("v").alias("id")).union(
        edges.select(F.col("v").alias("w"), F.col("u").alias("id"))).distinct()
    salts = around.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / block).alias("salts")).filter("salts > 1")
    joins = (around.join(salts, "w", "left")
             .withColumn("salt", F.pmod(F.xxhash64("w", "id", F.lit(grown)), F.coalesce("salts", F.lit(1))))
             .join(nodes.select("id", "vec"), "id")
             .groupBy("w", "salt").agg(F.collect_list(F.struct("id", "vec")).alias("members"))
             .filter(F.size("members") > 1).select("members"))
    return joins.mapInPandas(_local_joins(grown, reach, threshold), EDGES)


def count_links(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``members`` has ``id, root, vec, n``. Returns ``id, links``: nodes of the
    same component over the threshold, each counted ``n`` times."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = (members.join(sizes, "root").withColumn("t", F.pmod(F.xxhash64("id"), "tiles"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
             .groupBy("root", F.least("t", "other").alias("a"), F.greatest("t", "other").alias("b"))
             .agg(F.collect_list(F.struct("id", "vec", "n", "t")).alias("members")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids_out, links_out = [], []
            for a, b, group in zip(pdf["a"], pdf["b"], pdf["members"]):
                # Where a tile meets itself, the group holds it once; else both tiles, compared with each other only.
                ids = np.array([m["id"] for m in group], dtype=np.int64)
                n = np.array([m["n"] for m in group], dtype=np.int64)
                t = np.array([m["t"] for m in group], dtype=np.int64)
                x = _unit(pd.Series([m["vec"] for m in group]))
                near = (x @ x.T >= threshold) & (ids[:, None] != ids[None, :])
                if a != b:
                    near &= t[:, None] != t[None, :]
                ids_out.append(ids)
                links_out.append(near @ n)
            yield pd.DataFrame({"id": np.concatenate(ids_out) if ids_out else [],
                                "links": np.concatenate(links_out) if links_out else []}, dtype="int64")

    return dealt.mapInPandas(run, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def orders_for(n: int, block: int, threshold: float, recall: float) -> int:
    """Orders after which two vectors at the threshold have met in a block with a chance of ``recall``, if ``n`` nodes
    spread evenly over the codes: a block then is as wide as the codes that share log2(n / block) leading signs."""
    same = 1 - np.arccos(min(threshold, 1.0)) / np.pi
    meet = same ** max(0.0, np.log2(max(n, 1) / max(1, block // 2)))
    return 1 if meet >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))


def join_components(roots: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """The components with ``links`` added, and how many nodes are not the root of theirs."""
    roots = written(connected_components(roots.toDF("u", "v").union(links.select("u", "v"))), "nn_roots")
    return roots, roots.filter("node != root").count()


#: Nodes have places by hash, which the audit walks through.
PLACES = 1 << 40


def audit_links(placed: DataFrame, threshold: float, low: int, high: int) -> DataFrame:
    """The nodes of ``placed`` (``id, vec, root``) with places from ``low`` to ``high``, compared with all. Rows
    ``u, seen, inside, v``: links of ``u`` in a task, those inside its component, or a link to another component."""
    place = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    picked = placed.filter((place >= low) & (place < high)).collect()
    ids = np.array([r["id"] for r in picked], dtype=np.int64)
    roots = np.array([r["root"] for r in picked], dtype=np.int64)
    x = _unit(pd.Series([r["vec"] for r in picked])) if picked else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, inside = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
        for pdf in batches if len(ids) else ():
            for lo in range(0, len(pdf), 1024):
                part = pdf.iloc[lo:lo + 1024]
                own, own_roots = part["id"].to_numpy(), part["root"].to_numpy()
                near = (x @ _unit(part["vec"]).T >= threshold) & (ids[:, None] != own[None, :])
                seen += near.sum(axis=1)
                a, b = np.nonzero(near)
                same = roots[a] == own_roots[b]
                inside += np.bincount(a[same], minlength=len(ids))
                a, b = a[~same], b[~same]
                # One link to each other component is enough to join it.
                missed = pd.DataFrame({"u": ids[a], "seen": 0, "inside": 0, "v": own[b], "root": own_roots[b]})
                yield missed.drop_duplicates(["u", "root"]).drop(columns="root")
        at = seen > 0
        yield pd.DataFrame({"u": ids[at], "seen": seen[at], "inside": inside[at], "v": pd.array([None] * at.sum(), "Int64")})

    return written(placed.mapInPandas(run, "u long, seen long, inside long, v long"), "nn_audit")


def audit_components(nodes: DataFrame, roots: DataFrame, total: int, threshold: float, audit: int, audit_linked: int,
                     recall: float, last: bool) -> tuple[DataFrame, bool]:
    """The components with the links that the audit finds, and whether they need no other attempt."""
    placed = written(nodes.select("id", "vec").join(roots, F.col("id") == F.col("node"), "left")
                     .select("id", "vec", F.coalesce("root", "id").alias("root")), "nn_placed")
    low, linked, whole, size, passes = 0, 0, 0, audit, []
    while low < PLACES and (linked < audit_linked or (last and whole < recall * linked)):
        high = min(PLACES, low + -(-PLACES * size // max(total, 1)))
        passes.append(audit_links(placed, threshold, low, high))
        sums = passes[-1].groupBy("u").agg(F.sum("seen").alias("seen"), F.sum("inside").alias("inside")).agg(
            F.count(F.lit(1)), F.count_if(F.col("seen") == F.col("inside"))).first()
        linked, whole = linked + sums[0], whole + sums[1]
        low, size = high, min(4 * size, 8192)
    if whole < linked:
        roots, _ = join_components(roots, reduce(DataFrame.union, passes).filter("v is not null"))
    return roots, low >= PLACES or whole >= recall * linked


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                 reach: float = 0.8, keep: int = 12, most: int = 48, orders: int = 12, block: int = 128,
                 audit: int = 400, audit_linked: int = 1000, recall: float = 0.999, attempts: int = 3, tile: int = 512,
                 seed: int = 42) -> DataFrame:
    """Per vector: ``vec_id, n_links, component_id, kept``."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sound = F.coalesce((F.size("vec") > 0) & finite & (norm > 0), F.lit(False))
    common = base.filter(sound).groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    base = written(base.withColumn("sound", sound & (F.size("vec") == dim)), "nn_vectors")
    # A node per different vector; ids of nodes are numbers of their own, as the vectors' ids may be null or repeat.
    nodes = written(base.filter("sound").groupBy("vec").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
                    .withColumn("id", F.monotonically_increasing_id()), "nn_nodes")
    total = nodes.count()
    orders = max(orders, orders_for(total, block, threshold, recall))
    roots = nodes.select("id", "id").limit(0).toDF("node", "root")
    for attempt in range(attempts):
        found = written(start_lists(nodes, max(dim, 1), orders << attempt, block, keep, reach, threshold, seed + attempt),
                        "nn_found")
        roots, joined = join_components(roots, found.filter("tree"))
        lists, grown = written(best_lists(found, keep, 2 * keep, threshold), "nn_lists"), max(most, 2 * keep)
        while True:
            found = written(compare_around(nodes, lists, grown, reach, threshold, block), "nn_found")
            before = joined
            roots, joined = join_components(roots, found.filter("tree"))
            if joined == before:
                break
            lists, grown = written(best_lists(lists.union(found), keep, grown, threshold), "nn_lists"), 2 * grown
        roots, done = audit_components(nodes, roots, total, threshold, audit, audit_linked, recall, attempt == attempts - 1)
        if done:
            break
    members = nodes.join(roots, nodes["id"] == roots["node"]).select("id", "root", "vec", "n", "least")
    links = count_links(members.drop("least"), threshold, tile)
    comps = members.groupBy("root").agg(F.min("least").alias("comp"))
    linked = members.join(comps, "root").join(links, "id", "left").select("id", "comp", "links")
    known = nodes.join(linked, "id", "left").select(
        "vec", F.coalesce("comp", "least").alias("comp"),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    own = base.filter("sound").select("id", "vec").join(known, "vec").select("id", "links", "comp")
    alone = base.filter("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("comp"))
    return own.union(alone).select(
        F.col("id").alias("vec_id"), F.col("links").cast("long").alias("n_links"), F.col("comp").alias("component_id"),
        F.coalesce(F.col("id") == F.col("comp"), F.lit(False)).alias("kept"))
