"""Near copies among embeddings by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors of a label form one class, so copies cost one row. Each label's classes are dealt to shards by
   centroids that were fitted on a bounded sample; every class lies in its ``overlap`` nearest shards.
2. Each shard's graph: of every node its nearest and some random nodes of the shard, pruned robustly (a node that is
   nearer to one already taken, by a factor, is left out), with the reverse edges. A node's lists of all its shards
   are united, so an edge that one shard found helps in the others.
3. Every class searches its shards' graphs: greedily from the medoids to its own region, and then the range is
   expanded: every node within reach is expanded until no new one comes up. Links are verified in double precision.
4. A bounded set of queries is compared with all vectors of their labels, in blocks. If recall is below ``recall``, the
   search is made anew with twice the overlap and steps; if that doesn't do either, it is an error.

A shard of more than ``PART`` classes is parted by hash; its queries, in blocks, visit every part. So no task holds
more than ``PART`` nodes and as many queries, and no link is lost by parting. Work in a task is numpy over these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.shared import written

SHARD, PART = 500, 2000
CENTROIDS, SAMPLE_EACH = 4096, 16  # most centroids of a label, and rows of its sample for each
NEAR, FAR, KEPT_NEAR, KEPT_FAR, SLACK = 48, 24, 16, 6, 1.2
AUDITED, BLOCK = 1000, 20_000
_KEY = ["label", "shard", "part", "block"]


def unit(embedding: Column) -> Column:
    """The vector at length 1 in double precision; null for a null or zero vector or one with a null or non-finite component."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    let = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  worked out once, not for each component
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, c: a + c * c))
    over = lambda v, by: let(by, lambda d: F.transform(v, lambda c: c / d))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sized = over(x, F.array_max(F.transform(x, F.abs)))  # first to size 1, so that squares stay in range
    return F.when(finite & F.exists(x, lambda c: c != 0), let(sized, lambda v: over(v, norm(v))))


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_list()) if len(v) else np.zeros((0, 1))


def _fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Spherical k-means over a label's sample: ``label``, ``k`` and ``c``."""
    rows = rows.sort_values("node")
    x, k = _matrix(rows["v"]), min(int(rows["k"].iloc[0]), len(rows))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(6):
        nearest = np.concatenate([(x[i : i + 1000] @ c.T).argmax(axis=1) for i in range(0, len(x), 1000)])
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        length = np.linalg.norm(sums, axis=1)
        c[length > 0] = sums[length > 0] / length[length > 0, None]
    return pd.DataFrame({"label": key[0], "k": np.arange(k), "c": list(c)})


def _assigned(overlap: int):
    def run(_, rows: pd.DataFrame, centroids: pd.DataFrame) -> pd.DataFrame:
        if not len(centroids):
            return pd.DataFrame({"node": rows["node"], "shards": [[0]] * len(rows)})
        c, v = _matrix(centroids.sort_values("k")["c"]), rows["v"]
        n, shards = min(overlap, len(c)), []
        for i in range(0, len(v), 1000):
            near = _matrix(v.iloc[i : i + 1000]) @ c.T
            shards += np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1).tolist()
        return pd.DataFrame({"node": rows["node"], "shards": shards})

    return run


def _pruned(s: np.ndarray, own: np.ndarray, candidates: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates, nearest first, up to ``keep`` that aren't much nearer to one taken before; -1 for none.

    ``own`` has the row's similarity to each candidate and ``s`` all similarities; distances are 1 - similarity.
    """
    order = np.argsort(-own, axis=1)
    candidates, far = np.take_along_axis(candidates, order, 1), 1 - np.take_along_axis(own, order, 1)
    row, open_ = np.arange(len(own)), np.ones(own.shape, bool)
    out = np.full((len(own), keep), -1)
    for i in range(keep):
        first = open_.argmax(axis=1)
        some = open_[row, first]
        if not some.any():
            break
        taken = candidates[row, first]
        out[some, i] = taken[some]
        between = 1 - s[taken[:, None], candidates]
        open_ &= (SLACK * between > far) & (candidates != taken[:, None])
        open_ &= some[:, None]
    return out


def _graph(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """``node`` and ``near`` of a part: its neighbours by nearness and at random, pruned, and those it is a neighbour of."""
    rows = rows.sort_values("node")
    node, x = rows["node"].to_numpy(), _matrix(rows["v"])
    n = len(x)
    if n < 2:
        return pd.DataFrame({"node": node, "near": [[]] * n})
    s = x @ x.T
    itself = np.arange(n)
    masked = s.copy()
    masked[itself, itself] = -2
    k = min(NEAR, n - 1)
    near = np.argpartition(-masked, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(n).integers(1, n, (n, FAR)) + itself[:, None]
    far %= n
    edges = [_pruned(s, np.take_along_axis(masked, c, 1), c, keep) for c, keep in ((near, KEPT_NEAR), (far, KEPT_FAR))]
    to = np.concatenate(edges, axis=1)
    a, b = np.repeat(itself, to.shape[1])[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    ends = np.searchsorted(pairs // n, np.arange(1, n))
    return pd.DataFrame({"node": node, "near": np.split(node[pairs % n], ends)})


def _adjacency(node: np.ndarray, near: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and neighbours, as positions; those outside of the part are left out."""
    size = near.map(len).to_numpy()
    to = np.concatenate([np.asarray(x, np.int64) for x in near]) if size.sum() else np.zeros(0, np.int64)
    order = np.argsort(node)
    place = np.minimum(np.searchsorted(node[order], to), len(node) - 1)
    here = node[order][place] == to
    source = np.repeat(np.arange(len(node)), size)[here]
    return np.concatenate([[0], np.cumsum(np.bincount(source, minlength=len(node)))]), order[place[here]]


def _neighbours(offsets: np.ndarray, to: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) for each neighbour of each (query, node)."""
    size = offsets[at + 1] - offsets[at]
    ends = np.cumsum(size)
    return np.repeat(q, size), to[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[at] - ends + size, size)]


def _reached(queries: np.ndarray, x: np.ndarray, offsets: np.ndarray, to: np.ndarray, least: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) of all items that a search finds at ``least`` or more."""
    nq, n = len(queries), len(x)
    seen = np.full((nq, n), -2.0, np.float32)
    expanded = np.zeros((nq, n), bool)
    q32, x32 = queries.astype(np.float32), x.astype(np.float32)

    def look(q: np.ndarray, at: np.ndarray) -> None:
        key = q * n + at
        key = np.unique(key[seen.ravel()[key] == -2])
        for i in range(0, len(key), 50_000):
            some = key[i : i + 50_000]
            seen.ravel()[some] = np.einsum("ij,ij->i", q32[some // n], x32[some % n])

    # medoids: the nodes nearest to the mean, and to the mean of each random share of the part
    share = np.random.default_rng(n).permutation(n)[: max(1, int(np.sqrt(n)) ** 2)].reshape(max(1, int(np.sqrt(n))), -1)
    means = np.concatenate([x32.mean(axis=0)[None], x32[share].mean(axis=1)])
    medoids = np.unique((means @ x32.T).argmax(axis=1))
    seen[:, medoids] = q32 @ x32[medoids].T
    every = np.arange(nq)
    for _ in range(min(steps, n)):
        best = np.where(expanded, np.float32(-3), seen).argmax(axis=1)
        fresh = ~expanded[every, best] & (seen[every, best] > -2)
        if not fresh.any():
            break
        expanded[every[fresh], best[fresh]] = True
        look(*_neighbours(offsets, to, every[fresh], best[fresh]))
    reach = np.cos(min(np.pi, 1.25 * np.arccos(least)))
    while True:
        q, at = np.nonzero((seen >= reach) & ~expanded)
        if not len(q):
            break
        expanded[q, at] = True
        look(*_neighbours(offsets, to, q, at))
    q, at = np.nonzero(seen >= least - 1e-4)
    found = np.einsum("ij,ij->i", queries[q], x[at]) >= least
    return q[found], at[found]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node and the least one that it reaches by pairs (a, b), where that is another."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    least = np.arange(len(names))
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        least = least[least]
        if (least == before).all():
            break
    other = least != np.arange(len(names))
    return names[other], names[least[other]]


def _search(least: float, steps: int):
    """Links between a block of queries and a part: ``a`` with ``n`` rows that it links with (``b`` null), for both sides,
    and ``a``, ``b`` that hold the linked together."""
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": pd.array([], "Int64"), "n": np.zeros(0, np.int64)})

    def run(key: tuple, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return none
        items, queries = items.sort_values("node"), queries.sort_values("node")
        x, node, asks = _matrix(items["v"]), items["node"].to_numpy(), queries["node"].to_numpy()
        offsets, to = _adjacency(node, items["near"])
        width = max(items["shards"].map(len).max(), queries["shards"].map(len).max())
        padded = lambda s, fill: np.array([[*r, *[fill] * (width - len(r))] for r in s])
        own, theirs, pairs = padded(queries["shards"], -2), padded(items["shards"], -1), []
        for i in range(0, len(queries), 250):
            q, at = _reached(_matrix(queries["v"].iloc[i : i + 250]), x, offsets, to, least, steps)
            q += i
            # two classes may share several shards: they count in the first
            common = np.where((own[q][:, :, None] == theirs[at][:, None, :]).any(axis=2), own[q], 1 << 30).min(axis=1)
            keep = (common == key[1]) & (asks[q] != node[at])
            pairs.append(q[keep] * len(node) + at[keep])
        pair = np.concatenate(pairs)
        q, at = pair // len(node), pair % len(node)
        if key[2] == key[3]:  # the part with itself: found from either side
            pair = np.unique(np.minimum(q, at) * len(node) + np.maximum(q, at))
            q, at = pair // len(node), pair % len(node)
        a = np.concatenate([asks[q], node[at]])
        name, which = np.unique(a, return_inverse=True)
        n = np.bincount(which, np.concatenate([items["size"].to_numpy()[at], queries["size"].to_numpy()[q]]), len(name)).astype(np.int64)
        low, root = _forest(asks[q], node[at])
        told = pd.DataFrame({"a": name, "b": pd.array([None] * len(name), "Int64"), "n": n})
        return pd.concat([told, pd.DataFrame({"a": low, "b": pd.array(root, "Int64"), "n": 0})])

    return run


def _true_links(least: float):
    def run(_, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        met = _matrix(queries["v"]) @ _matrix(items["v"]).T >= least
        met &= queries["node"].to_numpy()[:, None] != items["node"].to_numpy()
        return pd.DataFrame({"a": queries["node"], "n": met @ items["size"].to_numpy()})

    return run


def _audit(classes: DataFrame, links: DataFrame, least: float) -> tuple[int, int]:
    """How many links about ``AUDITED`` classes have by comparison with all of their labels, and how many were found."""
    asked = classes.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(max(1, classes.count() // AUDITED))) == 0)
    blocks = F.ceil(F.col("of_label") / BLOCK).cast("int")
    items = classes.select("label", "node", "v", "size", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    queries = asked.select("label", "node", "v", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    true = queries.groupBy("label", "block").cogroup(items.groupBy("label", "block")).applyInPandas(_true_links(least), "a long, n long")
    true = true.groupBy("a").agg(F.sum("n").alias("true"))
    both = true.join(links.groupBy("a").agg(F.sum("n").alias("found")), "a", "left")
    row = both.agg(F.sum("true"), F.sum(F.least("found", "true"))).first()
    return row[0] or 0, row[1] or 0


def _links(classes: DataFrame, least: float, overlap: int, steps: int) -> DataFrame:
    """``a``, ``b``, ``n``: as ``_search`` tells them, from all shards."""
    k = F.least(F.lit(CENTROIDS), F.ceil(F.col("of_label") / SHARD)).cast("int")
    sampled = classes.where((k > 2) & (F.pmod(F.xxhash64("node", F.lit("fit")), F.col("of_label")) < k * SAMPLE_EACH))
    centroids = sampled.select("label", "node", "v", k.alias("k")).groupBy("label").applyInPandas(_fitted, f"label {_kind(classes)}, k int, c array<double>")
    blocks = F.ceil(F.col("of_label") / BLOCK).cast("int")
    centroids = written(centroids, "centroids")
    per_label = classes.select("label", "of_label").distinct()
    there = centroids.join(per_label, "label").select("label", "k", "c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    rows = classes.select("label", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", "v")
    shards = rows.groupBy("label", "block").cogroup(there.groupBy("label", "block")).applyInPandas(_assigned(overlap), "node long, shards array<int>")
    placed = written(classes.drop("of_label").join(shards, "node"), "placed").withColumn("shard", F.explode("shards"))
    parts = placed.groupBy("label", "shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = placed.join(parts, ["label", "shard"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    graph = dealt.select("label", "shard", "part", "node", "v").groupBy("label", "shard", "part").applyInPandas(_graph, "node long, near array<long>")
    united = written(graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    # each two parts meet once
    items = dealt.join(united, "node").select("label", "shard", "part", F.explode(F.expr("sequence(0, part)")).alias("block"), "node", "v", "near", "size", "shards")
    blocks = dealt.select("label", "shard", F.col("part").alias("block"), "parts", "node", "v", "size", "shards")
    items = items.select(*(F.col(c).alias(c) for c in items.columns))  # else columns of both sides would be the same
    queries = blocks.select("label", "shard", F.explode(F.expr("sequence(block, parts - 1)")).alias("part"), "block", "node", "v", "size", "shards")
    return written(queries.groupBy(*_KEY).cogroup(items.groupBy(*_KEY)).applyInPandas(_search(least, steps), "a long, b long, n long"), "vector-links")


def _kind(df: DataFrame) -> str:
    return df.schema["label"].dataType.simpleString()


def near_vectors(
    vectors: DataFrame, least: float = 0.93, overlap: int = 3, steps: int = 24, recall: float = 0.95,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row.

    Rows link at a cosine of ``least`` or more if their labels are equal and not null and their vectors equally long.
    Vectors that are null, zero, or hold null or non-finite components link with nothing. ``component_id`` is the
    smallest id reachable; null ids name none, unless all of a component are null. Repeated rows are rows of their
    own and link with each other; an empty table gives no rows; other columns are ignored.
    """
    label = F.concat_ws(":", F.size(vector_col), F.col(label_col).cast("string"))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.col(label_col).isNotNull(), label).alias("label"), unit(F.col(vector_col)).alias("v"))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull()
    rows = rows.withColumn("rep", F.when(usable, F.md5(F.concat_ws("|", "label", F.array_join(F.col("v").cast("array<string>"), ",")))))
    rows = written(rows, "vectors")
    classes = rows.where("rep is not null").groupBy("rep").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("size"), F.min("id").alias("least"))
    classes = classes.withColumn("node", F.xxhash64("rep"))
    per_label = classes.groupBy("label").agg(F.count("*").alias("of_label"))
    classes = written(classes.join(per_label, "label"), "classes")
    asked = classes.select("label", "node", "v", "size", "of_label")
    for _ in range(3):
        links = _links(asked, least, overlap, steps)
        true, found = _audit(asked, links, least)
        if found >= recall * true:
            break
        overlap, steps = 2 * overlap, 2 * steps
    else:
        raise RuntimeError(f"found {found} of {true} links")
    root = components(links.where("b is not null").select("a", "b"))
    degree = links.groupBy("a").agg(F.sum("n").alias("n"))
    labelled = classes.select("rep", "node", "size", "least").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    told = labelled.join(smallest, "root").join(degree.withColumnRenamed("a", "node"), "node", "left")
    told = told.select("rep", "component_id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("id", "rep").join(told, "rep", "left")
    component = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
