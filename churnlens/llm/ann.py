"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first (operator 13).

Index.  A tree is fitted on the driver on at most ``SAMPLE`` vectors (and at most a quarter of
the rows), chosen by a hash: each node is cut into up to ``BRANCH`` cells by k-means until a cell stands
for about ``LEAF_ROWS`` rows, or ``SAMPLE / LEAF_SAMPLE`` leaves are reached.  Every row of the
table is then put into its leaf by descending the tree.  Largest inner product is turned into smallest distance by one more
dimension, ``sqrt(M^2 - |x|^2)`` for a row and 0 for a query.

Search.  A query goes through the tree by a priority queue of nodes, nearest centre first;
leaves come out in the order in which they are worth a visit.  How many are visited is calibrated: for
``CALIBRATION`` queries the true neighbours are found over all rows in blocks, and visits are
widened one by one until the mean recall reaches ``TARGET``.  The visited leaves are read
completely, in double precision on the original vectors.

Widening.  A query's shards are visited in waves, the best one first, then the next ``WIDEN`` times as many.  A wave
returns only what can still be among the query's best: the last of the ``k + 1`` best so far is known.  So a
query sends about ``k`` rows a wave, however many shards it visits, and the number of waves is the
logarithm of the number of shards.

Layout.  Neighbouring leaves make a shard of about ``SHARD_ROWS`` rows.  A shard that has more is
dealt into blocks, and so are the queries that visit it, each block of rows meeting each block of
queries; a task holds one block of each.  So a region that a third of all rows fall into is spread.

Copies.  Equal vectors are one class.  Results need at most the ``k + 1`` smallest ids of a class
(equal scores go by id, and a query's own row is left out), which a window with a
limit keeps map-side; each class is searched once, and its results are given to all its queries.

Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows with a null id, or whose
vector has another length than most (ties: the longer).  Rows that repeat an id and a
vector count once; rows of one id with other vectors are rows of their own, candidates for every other
id, and that id has its ``k`` results for each of them.  A table without rows or queries gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import checkpoint_dir

SAMPLE, LEAF_SAMPLE = 16384, 8
BRANCH, ROUNDS = 16, 8
LEAF_ROWS, SHARD_ROWS, QUERY_ROWS = 100, 4096, 4096
CALIBRATION, TARGET = 256, 0.95
WIDEN = 4
SLACK = 1e-9


class Tree:
    """Centres of a hierarchical k-means tree; leaves are numbered from left to right."""

    def __init__(self, sample: np.ndarray, leaf_size: int, branch: int = BRANCH, seed: int = 7):
        self.reach = float(np.sqrt((sample ** 2).sum(1).max())) if len(sample) else 0.0
        self.dim = sample.shape[1]
        rng = np.random.default_rng(seed)
        centres, children, leaves = [], [], 0
        leaf_of: list[int] = []

        def add(points: np.ndarray) -> int:
            centres.append(points.mean(0) if len(points) else np.zeros(self.dim + 1))
            children.append(())
            leaf_of.append(-1)
            return len(centres) - 1

        points = self.lifted(sample)
        open_ = [(add(points), points)]
        while open_:  # depth first, so that the leaves of a subtree have neighbouring numbers
            node, points = open_.pop()
            cells = _cells(points, min(branch, -(-len(points) // leaf_size)), rng) if len(points) > leaf_size else [points]
            if len(cells) < 2:
                leaf_of[node] = leaves
                leaves += 1
                continue
            kids = [add(c) for c in cells]
            children[node] = tuple(kids)
            open_ += [(kid, c) for kid, c in zip(reversed(kids), reversed(cells), strict=True)]
        self.centres, self.children, self.leaf_of, self.leaves = np.array(centres), children, np.array(leaf_of), leaves
        self.squares = (self.centres ** 2).sum(1)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The rows with the dimension that makes them equally long (rows longer than the sample's longest: 0 there)."""
        more = np.sqrt(np.maximum(self.reach ** 2 - (x ** 2).sum(1), 0))
        return np.hstack([x, more[:, None]])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        x = self.lifted(x)
        out = np.zeros(len(x), np.int32)
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if not len(rows):
                continue
            if not (kids := np.array(self.children[node], np.int64)).size:
                out[rows] = self.leaf_of[node]
                continue
            near = (self.squares[kids] - 2 * x[rows] @ self.centres[kids].T).argmin(1)
            open_ += [(int(kid), rows[near == j]) for j, kid in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray, limit: int) -> Iterator[list[int]]:
        """For each query its first ``limit`` leaves, best bin first."""
        for lo in range(0, len(q), 256):
            keys = self.squares - 2 * q[lo:lo + 256] @ self.centres[:, :self.dim].T
            for key in keys.tolist():
                queue, found = [(key[0], 0)], []
                while queue and len(found) < limit:
                    _, node = heappop(queue)
                    if self.children[node]:
                        for kid in self.children[node]:
                            heappush(queue, (key[kid], kid))
                    else:
                        found.append(int(self.leaf_of[node]))
                yield found


def _cells(points: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The non-empty cells of k-means; one if all points are equal."""
    centres = np.unique(points[rng.choice(len(points), k, replace=False)], axis=0)
    near = np.zeros(len(points), np.int64)
    for _ in range(ROUNDS):
        near = ((centres ** 2).sum(1) - 2 * points @ centres.T).argmin(1)
        used = np.unique(near)
        centres = np.array([points[near == j].mean(0) for j in used])
        near = np.searchsorted(used, near)
    return [points[near == j] for j in range(len(centres))]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, vec: rows that can be searched, but for their vector's length."""
    kind = vectors.schema[vec_col].dataType
    vec = F.col(vec_col)
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        vec = vec.cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where("vec_id is not null and size(vec) > 0")
    most, least, inf = F.array_max("vec"), F.array_min("vec"), F.lit(float("inf"))
    # NaN is the largest value; a list of nulls alone has no largest one
    return rows.where((most < inf) & (least > -inf) & ((most != 0) | (least != 0)) & (F.size(F.array_compact("vec")) == F.size("vec")))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: h, vec, first (its smallest id), ids (its ``keep`` smallest)."""
    order = Window.partitionBy("h", "vec").orderBy("vec_id")
    few = rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= keep)
    return few.groupBy("h", "vec").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def _best(scores: np.ndarray, keep: int, least: np.ndarray | float = -np.inf) -> list[np.ndarray]:
    """For each row of scores the columns that can be among the ``keep`` best and reach ``least``; more where scores are equal but for rounding."""
    edge = np.partition(scores, -keep, axis=1)[:, -keep] if scores.shape[1] > keep else np.full(len(scores), -np.inf)
    edge = np.maximum(edge, least) - SLACK * (1 + np.abs(scores).max(1, initial=0))
    return [np.flatnonzero(s >= e) for s, e in zip(scores, edge, strict=True)]


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of one vector with rows, summed in the same order for every row."""
    return np.einsum("j,ij->i", q, rows)


def _order(score: np.ndarray, first: np.ndarray, keep: int) -> np.ndarray:
    return np.lexsort((first, -score))[:keep]


def _calibrate(indexed: DataFrame, tree: Tree, searched: DataFrame, k: int, queries: int, target: float) -> int:
    """The least number of leaves at which the mean recall of a sample of queries is ``target``."""
    some = searched.orderBy(F.xxhash64("first", "h"), "first", "h").limit(queries).select("first", "h", "vec").toArrow()
    q, own = _matrix(some["vec"]), some["first"].to_numpy()
    schema = pa.schema([("query", pa.int32()), ("score", pa.float64()), ("first", pa.int64()), ("leaf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of one task's rows for each query."""
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(q)
        for b in batches:
            first, leaf, rows = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2))
            for lo in range(0, len(rows), 4096):
                part = slice(lo, lo + 4096)
                f, lf, x = first[part], leaf[part], rows[part]
                for i, at in enumerate(_best(q @ x.T, k + 1)):
                    at = at[f[at] != own[i]]
                    s, g, v = (np.concatenate(z) for z in zip(best[i], (_exact(q[i], x[at]), f[at], lf[at]), strict=True))
                    top = _order(s, g, k)
                    best[i] = (s[top], g[top], v[top])
        for i, (s, g, v) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), pa.int32()), pa.array(s), pa.array(g), pa.array(v)], schema=schema)

    top = indexed.select("first", "leaf", "vec").mapInArrow(run, "query int, score double, first long, leaf int")
    near = Window.partitionBy("query").orderBy(F.desc("score"), "first")
    true = top.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k).select("query", "leaf").collect()
    ranks = [{leaf: n for n, leaf in enumerate(order, 1)} for order in tree.visits(q, tree.leaves)]
    needed = np.sort([ranks[r.query][r.leaf] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1


def _search_block(k: int):
    schema = pa.schema([("q_first", pa.int64()), ("q_h", pa.int64()), ("score", pa.float64()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The k + 1 best classes of one block of rows for one block of queries, leaf by leaf."""
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _matrix(rows["vec"]), _matrix(queries["vec"])
        first, leaf = rows["first"].to_numpy(), rows["leaf"].to_numpy()
        by_leaf = np.argsort(leaf, kind="stable")
        names, starts = np.unique(leaf[by_leaf], return_index=True)
        of_leaf = dict(zip(names.tolist(), np.split(by_leaf, starts[1:]), strict=True))
        visitors: dict[int, list[int]] = {}
        for i, leaves in enumerate(queries["leaves"].to_pylist()):
            for v in leaves:
                visitors.setdefault(v, []).append(i)
        least = queries["least"].to_numpy()
        found: list[list[np.ndarray]] = [[] for _ in range(len(q))]
        for v, who in visitors.items():
            at = of_leaf.get(v)
            for lo in range(0, len(who) if at is not None else 0, 512):
                part = who[lo:lo + 512]
                for i, best in zip(part, _best(q[part] @ x[at].T, k + 1, least[part]), strict=True):
                    found[i].append(at[best])
        who, which, scores = [], [], []
        for i, parts in enumerate(found):
            if parts:
                at = np.concatenate(parts)
                s = _exact(q[i], x[at])
                top = _order(s, first[at], k + 1)
                top = top[s[top] >= least[i]]
                who.append(np.full(len(top), i))
                which.append(at[top])
                scores.append(s[top])
        if not who:
            return schema.empty_table()
        who, which = pa.array(np.concatenate(who)), pa.array(np.concatenate(which))
        return pa.table([queries["first"].take(who), queries["h"].take(who), pa.array(np.concatenate(scores)),
                         rows["first"].take(which), rows["ids"].take(which)], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, target: float = TARGET, shard_rows: int = SHARD_ROWS,
            query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row that ``is_query`` (of column vec_id) picks."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return empty
    rows = rows.where(F.size("vec") == lengths[0].dim).withColumn("h", F.xxhash64("vec"))
    classes = _classes(rows, k + 1).checkpoint()
    n = classes.count()

    queries = rows.where(is_query).distinct()
    searched = classes.join(queries.select("h", "vec").distinct(), ["h", "vec"], "left_semi").checkpoint()
    if searched.isEmpty():
        return empty

    size = max(1, min(sample, max(256, n // 4)))
    fitted = classes.orderBy(F.xxhash64("h", "first"), "first", "h").limit(size).select("vec").toArrow()
    points = _matrix(fitted["vec"])
    tree = Tree(points, max(LEAF_SAMPLE, len(points) * leaf_rows // n))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaf(_matrix(b.column(3)))), *b.columns], ["leaf", "first", "h", "ids", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    indexed = (classes.select("first", "h", "ids", "vec")
               .mapInArrow(place, f"leaf int, first long, h long, ids array<long>, vec {kind}").checkpoint())
    limit = _calibrate(indexed, tree, searched, k, CALIBRATION, target)

    # at most as many leaves as the sample's bound allows; their row counts and shards are small
    counts = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    shard_of, blocks, filled = {}, [0], 0
    for v in range(tree.leaves):
        shard_of[v] = len(blocks) - 1
        filled += counts.get(v, 0)
        blocks[-1] = max(1, -(-filled // shard_rows))
        if filled >= shard_rows:
            blocks.append(1)
            filled = 0

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and shard that it visits, the shard of its best leaf first."""
        for b in batches:
            row, turn, shard, leaves = [], [], [], []
            for i, order in enumerate(tree.visits(_matrix(b.column(2)), limit)):
                per: dict[int, list[int]] = {}
                for v in order:
                    per.setdefault(shard_of[v], []).append(v)
                row += [i] * len(per)
                turn += range(len(per))
                shard += per
                leaves += per.values()
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(turn, pa.int32()), pa.array(shard, pa.int32()), pa.array(leaves, pa.list_(pa.int32())),
                                              *(c.take(at) for c in b.columns)], ["turn", "shard", "leaves", "first", "h", "vec"])

    visits = (searched.select("first", "h", "vec")
              .mapInArrow(visit, f"turn int, shard int, leaves array<int>, first long, h long, vec {kind}").checkpoint())
    asked, turns = {}, 0
    for r in visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last")).collect():
        asked[r.shard], turns = r.n, max(turns, r.last + 1)
    plan = [(s, b, max(1, -(-asked.get(s, 0) // query_rows))) for s, b in enumerate(blocks)]
    shards = spark.createDataFrame(plan, "shard int, row_blocks int, query_blocks int")
    leaves = spark.createDataFrame([(v, *plan[s]) for v, s in shard_of.items()], "leaf int, shard int, row_blocks int, query_blocks int")

    own, every = F.xxhash64("h", "first"), lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = (indexed.join(F.broadcast(leaves), "leaf")
            .select("shard", F.pmod(own, F.col("row_blocks")).cast("int").alias("row_block"), every("query_blocks").alias("query_block"),
                    "leaf", "first", "ids", "vec"))
    key, best = ["shard", "row_block", "query_block"], Window.partitionBy("q_first", "q_h").orderBy(F.desc("score"), "first")
    nearest_so_far, turn, width = None, 0, 1
    while turn < turns:
        wave = visits.where((F.col("turn") >= turn) & (F.col("turn") < turn + width))
        if nearest_so_far is None:
            wave = wave.withColumn("least", F.lit(float("-inf")))
        else:
            least = (nearest_so_far.groupBy(F.col("q_first").alias("first"), F.col("q_h").alias("h"))
                     .agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least")))
            wave = wave.join(least, ["first", "h"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        right = (wave.join(F.broadcast(shards), "shard")
                 .select("shard", every("row_blocks").alias("row_block"), F.pmod(own, F.col("query_blocks")).cast("int").alias("query_block"),
                         "leaves", "first", "h", "vec", "least"))
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            _search_block(k), "q_first long, q_h long, score double, first long, ids array<long>")
        every_found = found if nearest_so_far is None else nearest_so_far.unionByName(found)
        nearest_so_far = every_found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth").checkpoint()
        turn, width = turn + width, width * WIDEN

    lists = nearest_so_far.groupBy("q_first", "q_h").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    named = queries.join(searched.select("h", "vec", F.col("first").alias("q_first")), ["h", "vec"]).select(
        F.col("vec_id").alias("query_id"), F.col("h").alias("q_h"), "q_first")
    flat = F.flatten(F.transform("near", lambda c: F.transform(c["ids"], lambda i: F.struct((-c["score"]).alias("order"), i.alias("vec_id")))))
    others = F.filter(flat, lambda r: r["vec_id"] != F.col("query_id"))
    return (named.join(lists, ["q_first", "q_h"])
            .select("query_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("at", "r"))
            .select("query_id", (F.col("at") + 1).alias("rank"), "r.vec_id", (F.col("r.order") * -1).alias("score")))
