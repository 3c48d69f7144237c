"""Approximate nearest neighbours: a robust-pruned directed graph in every shard.

Distinct vectors are dealt to shards of a bounded size by a hash of their content. A shard's graph
is grown in batches: greedy beam searches over the graph so far propose neighbours, and relaxed
distance pruning keeps a diverse few. Every query searches every shard of its dimension.

The largest inner product is the smallest distance once each vector gets one more component,
sqrt(M^2 - |x|^2) with M the largest norm, and each query a zero there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bazaarflow.session import materialise

SHARD_ROWS = 8192
DEGREE = 28
BEAM = 56
QUERY_BEAM = 96
RELAX = 1.2
BATCH = 256
WIDTH = 4
QUERIES_PER_BLOCK = 8192


def distances(
    points: np.ndarray, norms: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray,
) -> np.ndarray:
    """Squared distances of queries[b] to points[ids[b]]; own holds the queries' squared norms."""
    dots = np.matmul(points[ids], queries[:, :, None])[:, :, 0]
    return np.maximum(norms[ids] + own[:, None] - 2 * dots, 0)


def beam_search(
    points: np.ndarray, norms: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int,
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first: ids (-1 for none) and distances.

    Every step expands each query's WIDTH nearest nodes that are not expanded yet.
    """
    b, n = len(queries), len(points)
    own = (queries * queries).sum(axis=1)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True  # stands for "no neighbour"
    rows = np.arange(b)[:, None]
    start = np.broadcast_to(entries, (b, len(entries)))
    seen[rows, start] = True
    ids = np.full((b, beam), n)
    far = np.full((b, beam), np.inf, np.float32)
    found = distances(points, norms, start, queries, own)
    order = np.argsort(found, axis=1, kind="stable")[:, :beam]
    ids[:, :order.shape[1]] = np.take_along_axis(start, order, 1)
    far[:, :order.shape[1]] = np.take_along_axis(found, order, 1)
    expanded = ids == n
    live = np.arange(b)
    while live.size:
        rank = np.cumsum(~expanded[live], axis=1)
        choose = ~expanded[live] & (rank <= WIDTH)
        some = choose.any(axis=1)
        live, choose = live[some], choose[some]
        if not live.size:
            break
        take = np.argsort(~choose, axis=1, kind="stable")[:, :WIDTH]
        picked = np.where(np.take_along_axis(choose, take, 1), ids[live[:, None], take], n)
        expanded[live] |= choose
        nodes = graph[picked].reshape(len(live), -1)
        nodes = np.sort(nodes, axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = n
        nodes[seen[live[:, None], nodes]] = n
        seen[live[:, None], nodes] = True
        width = max(1, int((nodes < n).sum(axis=1).max()))
        nodes = np.sort(nodes, axis=1)[:, :width]
        near = distances(points, norms, np.minimum(nodes, n - 1), queries[live], own[live]).astype(np.float32)
        near[nodes == n] = np.inf
        all_far = np.concatenate([far[live], near], axis=1)
        all_ids = np.concatenate([ids[live], nodes], axis=1)
        all_done = np.concatenate([expanded[live], nodes == n], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        far[live] = np.take_along_axis(all_far, order, 1)
        ids[live] = np.take_along_axis(all_ids, order, 1)
        expanded[live] = np.take_along_axis(all_done, order, 1)
    return np.where(ids == n, -1, ids), far


def robust_prune(
    points: np.ndarray, norms: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, relax: float,
) -> np.ndarray:
    """At most ``degree`` of each node's candidates (-1 for none), padded with len(points).

    The nearest candidate is kept, and every other one goes whose distance to it, times ``relax``,
    is not more than its distance to the node; and so on.
    """
    n = len(points)
    candidates = np.sort(candidates, axis=1)
    gone = (candidates < 0) | (candidates == nodes[:, None])
    gone[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    safe = np.maximum(candidates, 0)
    vectors = points[safe]
    far = np.maximum(norms[safe] + norms[nodes][:, None] - 2 * np.matmul(vectors, points[nodes][:, :, None])[:, :, 0], 0)
    far[gone] = np.inf
    kept = np.full((len(nodes), degree), n)
    rows = np.arange(len(nodes))
    open_far = far.copy()
    for k in range(degree):
        best = open_far.argmin(axis=1)
        alive = np.isfinite(open_far[rows, best])
        if not alive.any():
            break
        chosen = safe[rows, best]
        kept[alive, k] = chosen[alive]
        between = norms[safe] + norms[chosen][:, None] - 2 * np.matmul(vectors, points[chosen][:, :, None])[:, :, 0]
        open_far[relax * relax * between <= far] = np.inf
        open_far[rows, best] = np.inf
    return kept


def build_graph(
    points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, relax: float = RELAX,
) -> tuple[np.ndarray, np.ndarray]:
    """The graph (len(points) + 1 rows, the last one empty) and the nodes where searches start."""
    n = len(points)
    norms = (points * points).sum(axis=1)
    order = np.random.default_rng(11).permutation(n)
    slack = degree + degree // 2
    graph = np.full((n + 1, slack), n)
    count = np.zeros(n + 1, int)
    entries = order[:8]
    done = min(n, 32)
    seedling = np.broadcast_to(order[:done], (done, done))
    graph[order[:done], :degree] = robust_prune(points, norms, order[:done], seedling, degree, relax)
    count[order[:done]] = (graph[order[:done]] < n).sum(axis=1)
    while done < n:
        batch = order[done:done + min(BATCH, done)]
        done += len(batch)
        ids, _ = beam_search(points, norms, graph, entries, points[batch], beam)
        chosen = robust_prune(points, norms, batch, ids, degree, relax)
        graph[batch, :degree] = chosen
        count[batch] = (chosen < n).sum(axis=1)
        target = chosen.ravel()
        source = np.repeat(batch, degree)
        source, target = source[target < n], target[target < n]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        while target.size:  # a node takes the new edges it has room for, and is pruned when full
            nodes, first, size = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, size)
            fits = place < np.repeat(slack - count[nodes], size)
            graph[target[fits], count[target[fits]] + place[fits]] = source[fits]
            count[nodes] = np.minimum(count[nodes] + size, slack)
            full = nodes[count[nodes] == slack]
            if full.size:
                kept = robust_prune(points, norms, full, graph[full], degree, relax)
                graph[full] = n
                graph[full, :degree] = kept
                count[full] = (kept < n).sum(axis=1)
            source, target = source[~fits], target[~fits]
    return graph, entries


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    infinite = F.array(F.lit(float("inf")), F.lit(float("-inf")), F.lit(float("nan"))).cast("array<double>")
    doubles = vector.cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull()) & ~F.arrays_overlap(doubles, infinite)
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: (dim, shard, points, ids, graph, entries), from rows (vector, ids).

    ``ids`` are those of the rows that hold the vector. A shard's row holds about ``shard_rows``
    vectors, so its size is bounded; the number of shards of a dimension grows with its vectors.
    """
    sized = vectors.withColumn("dim", F.size("vector"))
    shards = sized.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"),
        F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).alias("longest"))
    placed = sized.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("first", kind="stable")
        points = np.stack(frame["vector"].to_numpy()).astype(np.float32)
        graph, entries = build_graph(_raised(points, float(frame["longest"].iloc[0])))
        ids = np.concatenate(frame["ids"].to_numpy())
        sizes = frame["ids"].map(len).to_numpy(np.int32)
        return pd.DataFrame([{
            "dim": int(frame["dim"].iloc[0]), "shard": int(frame["shard"].iloc[0]),
            "longest": float(frame["longest"].iloc[0]),
            "points": np.stack(frame["vector"].to_numpy()).astype(np.float64).tobytes(),
            "ids": ids.astype(np.int64).tobytes(), "sizes": sizes.tobytes(), "graph": graph.astype(np.int32).tobytes(),
            "entries": entries.astype(np.int32).tobytes()}])

    # A fixed number of partitions: a shard is little data but much work, so small ones must not be merged.
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.withColumn("first", F.element_at("ids", 1)).repartition(partitions, "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, longest double, points binary, ids binary, sizes binary, graph binary, entries binary")


def _raised(points: np.ndarray, longest: float) -> np.ndarray:
    norms = (points.astype(np.float64) ** 2).sum(axis=1)
    more = np.sqrt(np.maximum(longest * longest - norms, 0))
    return np.concatenate([points, more[:, None].astype(np.float32)], axis=1)


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = QUERY_BEAM) -> DataFrame:
    """(query, vec_id, score): for each row (query, vector), every shard's ``k`` best.

    Queries go to each shard of their dimension in blocks of about QUERIES_PER_BLOCK; a task loads
    one shard and one block.
    """
    sized = queries.withColumn("dim", F.size("vector"))
    blocks = sized.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_BLOCK).cast("int").alias("blocks"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    asked = sized.join(blocks, "dim").join(shards, "dim").withColumn(
        "block", F.pmod(F.xxhash64("query", F.lit(3)), F.col("blocks")).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), "last"))).select("dim", "shard", "block", "query", "vector")
    served = index.join(blocks, "dim").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key, shard: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(block):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        row = shard.iloc[0]
        exact = np.frombuffer(row["points"], np.float64).reshape(-1, row["dim"])
        points = _raised(exact.astype(np.float32), row["longest"])
        norms = (points * points).sum(axis=1)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(points) + 1, -1)
        entries = np.frombuffer(row["entries"], np.int32)
        sizes = np.frombuffer(row["sizes"], np.int32)
        ids = np.frombuffer(row["ids"], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        block = block.sort_values("query", kind="stable")
        out = []
        for start in range(0, len(block), BATCH):
            some = block.iloc[start:start + BATCH]
            wanted = np.stack(some["vector"].to_numpy()).astype(np.float64)
            flat = np.concatenate([wanted, np.zeros((len(wanted), 1))], axis=1).astype(np.float32)
            found, _ = beam_search(points, norms, graph, entries, flat, max(beam, k))
            for q, vector, nodes in zip(some["query"], wanted, found):
                nodes = nodes[nodes >= 0]
                scores = exact[nodes] @ vector
                top = np.argsort(-scores, kind="stable")
                top = top[scores[top] >= scores[top[min(k, len(top)) - 1]]]
                members = [ids[first[v]:first[v + 1]] for v in nodes[top]]
                vec = np.concatenate(members)
                score = np.repeat(scores[top], [len(m) for m in members])
                best = np.lexsort((vec, -score))[:k]
                out.append(pd.DataFrame({"query": q, "vec_id": vec[best], "score": score[best]}))
        return pd.concat(out)

    return served.groupBy("dim", "shard", "block").cogroup(asked.groupBy("dim", "shard", "block")).applyInPandas(
        search, "query long, vec_id long, score double")


def nearest_neighbours(
    rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` nearest rows by inner product.

    Columns: query_id, rank from 1, vec_id, score (in double on the given vectors). Ties go to the
    smaller id; a row is no neighbour of itself. Of equal vectors only the k + 1 smallest ids can
    be among the k nearest, so only those are indexed. Rows with a null id, and vectors that are
    null or zero or have null or non-finite components, take no part; vectors of different length
    do not compare; repeated rows count once; other columns are ignored; an empty table gives no
    rows.
    """
    valid = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    same = W.partitionBy("vector").orderBy("id")
    smallest = valid.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= k + 1)
    distinct = smallest.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    index = materialise(build_index(distinct), "nearest-index")

    asking = valid.where(F.col("id") % every == 0).distinct()
    asked = materialise(asking.groupBy("vector").agg(F.min("id").alias("query")), "nearest-queries")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = search_index(index, asked, k + 1).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(
        F.col("r"), "vec_id", "score"))).alias("near"))  # at most k + 1 entries
    answers = asked.join(lists, "query").select("vector", "near")
    own = asking.join(answers, "vector").select("id", F.posexplode(F.slice(
        F.filter("near", lambda n: n["vec_id"] != F.col("id")), 1, k)).alias("at", "n"))
    return own.select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"),
        F.col("n.score").alias("score"))
