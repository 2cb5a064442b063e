"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Equal vectors count once, with their k + 1 smallest ids, which is all that can rank, so that copies never crowd a
shortlist. Training (k-means of the centroids, then of each part of the residuals) takes a bounded sample, the rows
whose ids have the smallest hashes, 32 for each list. Every row is indexed: its list is the nearest centroid's, its code the
nearest residual centroids, one byte a part. A query looks into its `probes` nearest lists; how many that are is measured
on the sample, so that a share `reach` of the sample's true neighbours lies in them: few if vectors have clusters.

With centroid c, residual code r and query q the squared distance is |q - c|^2 + (|r|^2 + 2 c.r) - 2 q.r. The bracket is a number
stored with a row; the last term is a sum over a table of the query's parts against all part centroids (asymmetric distances),
the same for every list. Of all the lists it looks into, a query keeps the `shortlist` least, over all cells; only for
those are vectors fetched, and reranked by exact Euclidean distance in double precision.

Lists are packed into groups of bounded size, and one with more rows is cut; a query goes once to each group that has
a list of its own, and a group's rows are sent once for each `CELL_QUERIES` queries that it has. What is shuffled for the search
are codes and queries.

Recall is measured on the finished index: `TRIALS` rows are searched exactly over all rows (one pass, a bounded top a task)
and through the index; while it found less than `recall` of their neighbours, probes and shortlist are doubled.

A recall that holds on average says nothing about one query, so an exact check follows. A query's k-th distance found is
a bound; each list's least and greatest distance from its centroid tell which lists can hold a row within it (triangle inequality).
The query goes to these lists once more, where distances are exact, and the least k are kept: what codes, shortlist or probes
missed comes in, ties too. Vectors with clusters rule out most lists, noise rules out none: its work grows with queries times rows.

Nulls and edge cases: vectors that are null, zero, of another length than most (ties: the shorter), or hold null or
non-finite components take no part, nor do null ids; repeated rows of an id count once (the least vector);
extra columns stay out; with fewer candidates all found are returned, and lists are added for a query until its
probes hold `shortlist` rows or there are no more; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import heavy, join_spread, save, shuffle_partitions

PER_LIST, CELL_ROWS, CELL_QUERIES, TRIALS = 32, 1 << 16, 1 << 13, 64


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centers = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        for empty in np.flatnonzero(counts == 0):
            centers[empty] = x[rng.integers(len(x))]
    return centers


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, all to all."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], centers).argmin(axis=1) for i in range(0, len(x), 4096)])


@dataclass
class Model:
    centers: np.ndarray  # lists x dimensions
    parts: list[np.ndarray]  # for each part: up to 256 x its dimensions
    bounds: np.ndarray

    def spans(self):
        return zip(self.parts, self.bounds[:-1], self.bounds[1:])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, code, number stored with it) of each row."""
        lists = nearest(x, self.centers)
        rest = x - self.centers[lists]
        codes = np.stack([nearest(rest[:, a:b], p) for p, a, b in self.spans()], 1)
        bias = np.zeros(len(x))
        for m, (p, a, b) in enumerate(self.spans()):
            r = p[codes[:, m]]
            bias += (r * r).sum(1) + 2 * (self.centers[lists, a:b] * r).sum(1)
        return lists.astype(np.int32), codes.astype(np.uint8), bias

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x 256: what each part centroid takes off or adds."""
        out = np.zeros((len(q), len(self.parts), 256), np.float32)
        for m, (p, a, b) in enumerate(self.spans()):
            out[:, m, : len(p)] = -2 * q[:, a:b] @ p.T
        return out

    def reaching(self, sample: np.ndarray, share: float, k: int = 10, asked: int = 256) -> int:
        """How many lists hold a share of the k nearest in the sample of its first rows."""
        far = distances(sample[:asked], sample)
        far[np.arange(len(far)), np.arange(len(far))] = np.inf
        near = np.argpartition(far, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)]
        own = nearest(sample, self.centers)
        rank = distances(sample[:asked], self.centers).argsort(axis=1).argsort(axis=1)
        ranks = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(share * len(ranks))) - 1)]) + 1 if len(ranks) else len(self.centers)


def train(x: np.ndarray, lists: int, parts: int) -> Model:
    centers = kmeans(x, lists)
    rest = x - centers[nearest(x, centers)]
    bounds = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    return Model(centers, [kmeans(rest[:, a:b], 256, 8) for a, b in zip(bounds[:-1], bounds[1:])], bounds)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): one row an id, v the vector, of floats if it is one, else of doubles."""
    v = F.col(vec_col) if dict(df.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("v", lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).select("d").collect()
    return rows.where(F.size("v") == (size[0].d if size else 0)).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def collapsed(vectors: DataFrame, k: int) -> DataFrame:
    """(id, v, ids): a row for each distinct vector, its least id, and its k + 1 least ids."""
    order = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.withColumn("place", order).where(F.col("place") <= k + 1)
    return few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")).select("id", "v", "ids")


def search_cell(model: Model, lists: np.ndarray, ids: np.ndarray, codes: np.ndarray, bias: np.ndarray, query_ids: np.ndarray, q: np.ndarray, probes: np.ndarray, shortlist: int):
    """(query, id, approximate squared distance) of each query's least in a cell; probes: each query's lists as bits."""
    out = []
    step = max(1, (1 << 21) // max(len(ids), 1))
    for i in range(0, len(q), step):
        tables = model.tables(q[i : i + step])
        sums = np.repeat(bias.astype(np.float32)[None, :], len(tables), 0)
        for m in range(tables.shape[1]):
            sums += tables[:, m, :][:, codes[:, m]]
        sums += distances(q[i : i + step], model.centers).astype(np.float32)[:, lists]
        sums[~np.unpackbits(probes[i : i + step], axis=1, bitorder="little")[:, : len(model.centers)].astype(bool)[:, lists]] = np.inf
        near = np.argpartition(sums, shortlist - 1, axis=1)[:, :shortlist] if len(ids) > shortlist else np.repeat(np.arange(len(ids))[None, :], len(sums), 0)
        got = np.take_along_axis(sums, near, 1)
        row, col = np.nonzero(np.isfinite(got))
        out.append((query_ids[i + row], ids[near[row, col]], got[row, col].astype(float)))
    return tuple(np.concatenate(c) for c in zip(*out))


@dataclass
class Index:
    """Stored rows (list, id, code, bias, gap, v; gap: distance from the centroid) of distinct vectors (id, v, ids), and how lists are packed into groups."""

    distinct: DataFrame
    stored: DataFrame
    model: Model
    probes: int
    shortlist: int
    sizes: np.ndarray  # rows of each list
    least: np.ndarray  # distances of its nearest and farthest row from its centroid
    most: np.ndarray
    first: np.ndarray  # each list's first group, and how many it takes
    pieces: np.ndarray


def build(vectors: DataFrame, k: int, lists: int | None = None, probes: int | None = None, parts: int = 16, shortlist: int = 200, reach: float = 0.97) -> Index | None:
    """The index of (id, v) rows from `usable`; None without any."""
    spark = vectors.sparkSession
    distinct = save(collapsed(vectors, k), "distinct")
    n = distinct.count()
    if not n:
        return None
    lists = lists or int(np.clip(np.sqrt(n), 8, 4096))

    def packed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in matrix(b.column(0))], pa.binary())], names=["v"])

    # At most PER_LIST * 4,096 vectors.
    sample = distinct.orderBy(F.xxhash64("id"), "id").limit(PER_LIST * max(lists, 128)).select("v").mapInArrow(packed, "v binary").toPandas()["v"]
    fit_on = np.frombuffer(b"".join(map(bytes, sample)), float).reshape(len(sample), -1)
    model = train(fit_on, lists, parts)
    probes = min(probes or model.reaching(fit_on, reach, k), len(model.centers))
    held = spark.sparkContext.broadcast(model)

    def to_lists(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                at, codes, bias = held.value.encode(x)
                gap = np.sqrt(((x - held.value.centers[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(bias), pa.array(gap), b.column(1)], names=["list", "id", "code", "bias", "gap", "v"])

    stored = save(distinct.select("id", "v").mapInArrow(to_lists, f"list int, id long, code binary, bias double, gap double, v {dict(distinct.dtypes)['v']}"), "ivf")
    # One row a list, at most 4,096: lists are packed into groups, side by side; one that is larger than a group is cut.
    sizes, least, most = np.zeros(len(model.centers), np.int64), np.zeros(len(model.centers)), np.zeros(len(model.centers))
    for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most")).collect():
        sizes[r.list], least[r.list], most[r.list] = r.n, r.least, r.most
    room = int(np.clip(n // shuffle_partitions(spark), 1024, CELL_ROWS))
    pieces = np.maximum(1, -(-sizes // room))
    first = np.zeros(len(sizes), np.int64)
    group, used = 0, 0
    for at, (size, cut) in enumerate(zip(sizes.tolist(), pieces.tolist())):
        if cut > 1 or used + size > room:
            group, used = group + (used > 0), 0
        first[at] = group
        group, used = (group + cut, 0) if cut > 1 else (group, used + size)
    return Index(distinct, stored, model, probes, shortlist, sizes, least, most, first, pieces)


def to_groups(index: Index, queries: DataFrame, choose: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]]) -> DataFrame:
    """(g, id, q, far, probes): a query (id, v, far) for each group that has one of the lists that `choose` gives it; probes: its lists as bits."""
    deal = queries.sparkSession.sparkContext.broadcast((index.sizes, index.first, index.pieces))

    def work(batches):
        size, begin, cut = deal.value
        for b in batches:
            if not b.num_rows:
                continue
            for i, own in enumerate(choose(matrix(b.column(1)), b.column(2).to_numpy())):
                own = own[size[own] > 0]
                if not len(own):
                    continue
                mask = np.zeros(len(size), bool)
                mask[own] = True
                groups = np.unique(np.concatenate([np.arange(begin[a], begin[a] + cut[a]) for a in own]))
                blob = np.packbits(mask, bitorder="little").tobytes()
                part = b.slice(i, 1).take(pa.array(np.zeros(len(groups), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(groups), *part.columns, pa.array([blob] * len(groups), pa.binary())], names=["g", "id", "q", "far", "probes"])

    return save(queries.select("id", F.col("v").cast("array<double>"), "far").mapInArrow(work, "g long, id long, q array<double>, far double, probes binary"), "asked")


def in_cells(index: Index, asked: DataFrame, columns: list[str], search: Callable, out: str) -> DataFrame:
    """What `search` gives for a cell's stored rows (list, id and the columns) and its queries (id, q, far, bits of lists)."""
    spark = asked.sparkSession
    # A group has as many chunks as its own queries fill; groups without any aren't sent at all.
    chunks = asked.groupBy("g").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("chunks"))
    salt = F.abs(F.xxhash64("id"))
    table = F.broadcast(spark.createDataFrame([(k_, int(a), int(c)) for k_, (a, c) in enumerate(zip(index.first, index.pieces))], "list int, first long, pieces long"))
    dealt = index.stored.join(table, "list").select((F.col("first") + salt % F.col("pieces")).alias("g"), "id", "list", *columns)
    rows = dealt.join(chunks, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), "id", "list", *columns)
    asks = asked.join(chunks, "g").select("g", (salt % F.col("chunks")).cast("int").alias("j"), "id", "q", "far", "probes")

    def cell(t: pa.Table) -> pa.Table:
        is_row = np.asarray(t.column("list").is_valid())
        rows, asks = t.filter(pa.array(is_row)), t.filter(pa.array(~is_row))
        if not len(rows) or not len(asks):
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), out: pa.array([], pa.float64())})
        bits = np.frombuffer(b"".join(asks.column("probes").to_pylist()), np.uint8).reshape(len(asks), -1)
        found = search(rows, asks.column("id").to_numpy(), matrix(asks.column("q")), asks.column("far").to_numpy(), bits)
        return pa.table({"query_id": found[0], "id": found[1], out: found[2]})

    return rows.unionByName(asks, allowMissingColumns=True).groupBy("g", "j").applyInArrow(cell, f"query_id long, id long, {out} double")


def least(found: DataFrame, by: str, n: int) -> DataFrame:
    """(query_id, id): each query's n least."""
    order = Window.partitionBy("query_id").orderBy(by, "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("query_id", "id")


def shortlists(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, id): for each query (id, v), the least of all its lists by their codes, the index's `shortlist` of them."""
    probes, shortlist, size = index.probes, index.shortlist, index.sizes
    held = queries.sparkSession.sparkContext.broadcast(index.model)

    def nearest_lists(q, far):
        order = np.argsort(distances(q, held.value.centers), axis=1, kind="stable")
        enough = (np.cumsum(size[order], axis=1) < shortlist).sum(axis=1) + 1  # lists until they hold a shortlist
        return (own[:m] for own, m in zip(order, np.maximum(enough, probes)))

    def by_codes(rows, query_ids, q, far, bits):
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
        return search_cell(held.value, rows.column("list").to_numpy(), rows.column("id").to_numpy(), codes, rows.column("bias").to_numpy(), query_ids, q, bits, shortlist)

    asked = to_groups(index, queries.select("id", "v", F.lit(float("inf")).alias("far")), nearest_lists)
    return save(least(in_cells(index, asked, ["code", "bias"], by_codes, "near"), "near", shortlist), "shortlists")


def ranked(index: Index, chosen: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k exactly nearest of each query's chosen vectors, copies told apart; a query's own id is no candidate."""
    hot = heavy(chosen.groupBy("id").agg(F.count("*").alias("n")), "id")
    fetched = join_spread(chosen, index.distinct, "id", hot, ["query_id"]).join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    gap = F.zip_with("v", "q", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
    exact = fetched.select("query_id", F.explode("ids").alias("id"), F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)).alias("score")).where("id <> query_id")
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def reranked(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k exactly nearest of each query's shortlist."""
    return ranked(index, shortlists(index, queries), queries, k)


def check_cell(centers: np.ndarray, lists: np.ndarray, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, far: np.ndarray, probes: np.ndarray, n: int):
    """(query, id, distance) of each query's n exactly nearest rows of a cell that are no farther than `far`."""
    wanted = np.unpackbits(probes, axis=1, bitorder="little")[:, : len(centers)].astype(bool)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    order = np.argsort(lists, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
        at = lists[own[0]]
        rest = x[own] - centers[at]  # small numbers, so products lose little
        norms = (rest * rest).sum(axis=1)
        asks, step = np.flatnonzero(wanted[:, at]), max(1, (1 << 20) // len(own))
        for i in range(0, len(asks), step):
            a = asks[i : i + step]
            shift = q[a] - centers[at]
            both = (shift * shift).sum(axis=1)[:, None] + norms[None, :]
            row, col = np.nonzero(~(both - 2 * shift @ rest.T > far[a, None] ** 2 * (1 + 1e-9) + 1e-9 * both))
            d = np.zeros(len(row))
            for k in range(x.shape[1]):  # in the order that Spark adds in, so that ties are the same ones
                d += (x[own[col], k] - q[a[row], k]) ** 2
            d = np.sqrt(d)
            near = ~(d > far[a[row]])
            out.append(first_of(a[row[near]], ids[own[col[near]]], d[near], n))
    at, found, d = first_of(*(np.concatenate(c) for c in zip(*out)), n)
    return query_ids[at], found, d


def first_of(group: np.ndarray, ids: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n rows of each group that are least by (d, id)."""
    order = np.lexsort((ids, d, group))
    group, ids, d = group[order], ids[order], d[order]
    kept = np.arange(len(group)) - np.searchsorted(group, group) < n
    return group[kept], ids[kept], d[kept]


def completed(index: Index, found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The exact k nearest of each query, as `ranked`: all lists that can hold a vector as near as the k-th of `found` are looked into."""
    centers = queries.sparkSession.sparkContext.broadcast(index.model.centers)
    least_gap, most_gap = index.least, index.most

    def near_lists(q, far):
        for one, bound in zip(q, far):
            gap = np.sqrt(((centers.value - one) ** 2).sum(axis=1))
            yield np.flatnonzero(~(np.maximum(gap - most_gap, least_gap - gap) > bound + 1e-9 * (gap + most_gap)))

    def by_vectors(rows, query_ids, q, far, bits):
        return check_cell(centers.value, rows.column("list").to_numpy(), rows.column("id").to_numpy(), matrix(rows.column("v")), query_ids, q, far, bits, k + 1)

    bounds = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score")).alias("far"))
    bounded = queries.join(bounds, "id", "left").select("id", "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
    checked = in_cells(index, to_groups(index, bounded, near_lists), ["v"], by_vectors, "d")
    return ranked(index, save(least(checked, "d", k + 1), "checked"), queries, k)  # one more: its own vector


def exact_distances(index: Index, queries: DataFrame, k: int) -> dict[int, float]:
    """query id -> the distance of its k-th nearest distinct vector (of the last, if there are fewer), by a pass over all; queries: a bounded few."""
    asked = [(r.id, r.v) for r in queries.collect()]
    held = index.distinct.sparkSession.sparkContext.broadcast((np.array([i for i, _ in asked]), np.array([v for _, v in asked], float)))

    def least(batches):
        ids, q = held.value
        best = np.full((len(q), k), np.inf)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                d = np.stack([((x - one) ** 2).sum(axis=1) for one in q])
                d[b.column(0).to_numpy()[None, :] == ids[:, None]] = np.inf
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        where = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, where.sum(axis=1))), pa.array(np.sqrt(best[where]))], names=["id", "d"])

    found = index.distinct.select("id", "v").mapInArrow(least, "id long, d double")
    w = Window.partitionBy("id").orderBy("d")
    return {r.id: r.d for r in found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("id").agg(F.max("d").alias("d")).collect()}


def measured(index: Index, k: int, recall: float) -> Index:
    """The index with enough probes and shortlist for a recall of its trial rows' k nearest distinct vectors."""
    rows, lists = int(index.sizes.sum()), len(index.sizes)
    if rows <= index.shortlist:  # every row is reranked
        return index
    trial = save(index.distinct.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TRIALS).select("id", "v"), "trial")
    far = exact_distances(index, trial, k)
    while True:
        found = shortlists(index, trial).where("id <> query_id").join(index.distinct.select("id", "v"), "id").join(trial.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        gap = F.zip_with("v", "q", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))
        near = found.select("query_id", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)).alias("d"))
        bounds = F.broadcast(near.sparkSession.createDataFrame(list(far.items()), "query_id long, far double"))
        hits = {r.query_id: min(r.n, k) for r in near.join(bounds, "query_id").where("d <= far * (1 + 1e-12)").groupBy("query_id").agg(F.count("*").alias("n")).collect()}
        whole = min(k, rows - 1) * len(far)
        if sum(hits.values()) >= recall * whole or (index.probes >= lists and index.shortlist >= rows):
            return index
        index = replace(index, probes=min(2 * index.probes, lists), shortlist=2 * index.shortlist)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, probes: int | None = None, parts: int = 16, shortlist: int = 200, reach: float = 0.97, recall: float = 0.92) -> DataFrame:
    """(query_id, rank, id, score) for (id, v) tables from `usable`, exactly the k nearest; a query's own id is no candidate."""
    index = build(vectors, k, lists, probes, parts, shortlist, reach)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    index = measured(index, k, recall)
    return completed(index, reranked(index, queries, k), queries, k)


def op1_ann(spark, sf_dir: str) -> DataFrame:
    vectors = save(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return search(vectors, vectors.where(F.col("id") % 100 == 0)).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: Exact search, for measuring recall only: it is no oracle of an approximate result.
EXACT_SQL = """
SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score, e.vec_id) <= 10
"""
