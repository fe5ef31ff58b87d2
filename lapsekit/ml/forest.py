"""Random forest (L2) whose trees grow side by side, each in one task.

Spark's own forest adds up a histogram of every open node of every tree in every partition and shuffles all of them in
each pass, and keeps a bag count and a node number for every row and tree. Here rows are binned once, a byte a feature,
and written; a task reads the binned rows in order into its own temp file and grows its share of the trees from
there, so nothing but finished trees leaves it. The rules are those of Spark's learner: candidate splits from
a sample of max(bins^2, 10,000) rows, a Poisson bag of all training rows for each tree, a new random subset of the features at every
node, weighted Gini gain, ordered categories, at least ``minInstancesPerNode`` bagged rows a child, leaves of one
parent with the same class merged.

A node of more than ``most_rows`` rows is split by reading the file; when its parts are smaller their rows are
brought together, in further temp files if there are several, and the subtrees are finished one after the
other, so the matrix in memory is bounded. Besides it a task holds six bytes a training row.
"""

from __future__ import annotations

import math
import tempfile
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapsekit.session import cut_lineage

#: Rows of which a subtree is grown in memory; rows and nodes worked on at once; bytes of temp file kept in memory.
ROWS, BLOCK, NODES, SPOOL = 1 << 20, 1 << 14, 256, 16 << 20
#: Tasks per core that trees are dealt to, so that slow ones don't hold up the end.
TASKS = 4
#: While trees grow: written batches of binned rows (10,000 rows each, as Arrow brings them) that a Python worker gets at
#: a time, and that a union of one-partition frames keeps a partition, thus a task, for each of them.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.unionOutputPartitioning": "false"}


@dataclass
class Rules:
    """What all trees share. ``categories``: number of categories of each feature, 0 for a number; ``rows``: those of which a
    subtree is grown in memory."""

    trees: int
    depth: int
    least: int
    subset: int
    seed: int
    bootstrap: bool
    weight: float
    edges: list[np.ndarray]
    categories: np.ndarray
    rows: int = ROWS

    def __post_init__(self):
        self.bins = int(max([2, *self.categories, *(len(e) + 1 for e in self.edges)]))
        self.words = -(-self.bins // 64)
        self.width = len(self.edges)
        self.code = np.dtype(np.uint8 if self.bins <= 256 else np.uint16)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bin of every value; a number's bin counts the thresholds below it, so a missing one is above all of them."""
        out = np.empty(x.shape, self.code)
        for f, edges in enumerate(self.edges):
            out[:, f] = x[:, f] if self.categories[f] else np.searchsorted(edges, x[:, f])
        return out


def thresholds(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Spark's candidate thresholds of a number: all midpoints if there are at most ``most``, else those nearest to even weights."""
    known = ~np.isnan(values)
    distinct, own = np.unique(values[known], return_inverse=True)
    middles = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middles) <= most:
        return middles
    up_to = np.cumsum(np.bincount(own, weights[known]))
    stride, out = up_to[-1] / (most + 1), []
    target = stride
    for i, middle in enumerate(middles):
        if abs(up_to[i] - target) < abs(up_to[i + 1] - target):
            out.append(middle)
            target += stride
    return np.array(out)


def _histogram(x, y, count, slot, feats, p: Rules):
    """Bagged rows by (node, feature of its subset, class, bin)."""
    k, m = feats.shape
    hist, flat = np.zeros(k * m * 2 * p.bins), x.reshape(-1)
    # where the bins of (node, class) begin for each of its features; take() is many times as fast as indexing rows
    place = (np.arange(k * m).reshape(k, 1, m) * 2 + np.arange(2)[:, None]).reshape(2 * k, m) * p.bins
    for s in range(0, len(x), BLOCK):
        own = slot[s:s + BLOCK]
        low = own.min()  # rows of sorted nodes fill a part of the histogram
        at = feats.take(own, 0)
        at += (np.arange(s, s + len(own)) * p.width)[:, None]
        key = place.take((own - low) * 2 + y[s:s + BLOCK], 0)
        key += flat.take(at)
        found = np.bincount(key.ravel(), np.repeat(count[s:s + BLOCK].astype(float), m))
        hist[low * 2 * m * p.bins:][:len(found)] += found
    return hist.reshape(k, m, 2, p.bins)


def _best(hist, feats, p: Rules):
    """Of each node: whether a split gains, its feature, the bins that go right, and the rows by class on either side."""
    k, m, _, bins = hist.shape
    i, j = np.nonzero(p.categories[feats])
    order = None
    if len(i):  # categories in the order of their positive rows, as Spark's learner has them, absent ones last
        h = hist[i, j]
        order = np.argsort(np.where(h.sum(axis=1) > 0, h[:, 1], np.inf), axis=1, kind="stable")
        hist[i, j] = np.take_along_axis(h, order[:, None], 2)
    left = hist.cumsum(axis=3)
    whole = left[:, 0, :, -1].copy()
    l0, l1 = left[:, :, 0, :-1], left[:, :, 1, :-1]
    r0, r1 = whole[:, 0, None, None] - l0, whole[:, 1, None, None] - l1
    fits = (l0 + l1 >= p.least) & (r0 + r1 >= p.least)
    with np.errstate(invalid="ignore", divide="ignore"):
        cost = np.where(fits, l0 * l1 / (l0 + p.weight * l1) + r0 * r1 / (r0 + p.weight * r1), np.inf).reshape(k, -1)
        before = whole[:, 0] * whole[:, 1] / (whole[:, 0] + p.weight * whole[:, 1])
    at, rows = cost.argmin(axis=1), np.arange(k)
    feature, cut = np.divmod(at, bins - 1)
    right = np.arange(bins) > cut[:, None]
    if order is not None:
        number = np.full((k, m), -1)
        number[i, j] = np.arange(len(i))
        number = number[rows, feature]
        named = np.flatnonzero(number >= 0)
        turned = np.zeros((len(named), bins), bool)
        np.put_along_axis(turned, order[number[named]], right[named], 1)
        right[named] = turned
    below = left[rows, feature, :, cut]
    return cost[rows, at] < before * (1 - 1e-12), feats[rows, feature], right, below, whole - below


class Tree:
    """Nodes of a growing tree; siblings have numbers that follow each other."""

    def __init__(self, p: Rules, whole: np.ndarray):
        self.p, self.counts, self.size, self.splits = p, [whole[None]], 1, []

    def opens(self, counts: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return (counts.sum(axis=1) >= 2 * self.p.least) & (counts > 0).all(axis=1) & (depth < self.p.depth)

    def split(self, nodes, depth, hist, feats):
        """Split ``nodes`` where that gains. Of each node: feature, bins that go right; of its two children, side by side: number, open or not."""
        gains, feature, right, below, above = _best(hist, feats, self.p)
        at = np.flatnonzero(gains)
        counts = np.stack([below[at], above[at]], axis=1).reshape(-1, 2)
        ids = np.full((len(nodes), 2), -1)
        ids[at] = (self.size + np.arange(2 * len(at))).reshape(-1, 2)
        goes_on = np.zeros((len(nodes), 2), bool)
        goes_on[at] = self.opens(counts, np.repeat(depth[at] + 1, 2)).reshape(-1, 2)
        self.counts.append(counts)
        self.size += 2 * len(at)
        self.splits.append((nodes[at], feature[at], right[at], ids[at, 0]))
        return feature, right, ids.ravel(), goes_on.ravel()

    def arrays(self):
        """feature, words of bits of the bins that go right, left child (a leaf: itself, no bits), probability."""
        p, counts, own = self.p, np.concatenate(self.counts), np.arange(self.size)
        feature, left, right = np.zeros(self.size, np.int32), own.copy(), np.zeros((self.size, 64 * p.words), bool)
        for nodes, f, goes_right, child in self.splits:
            feature[nodes], left[nodes], right[nodes, :p.bins] = f, child, goes_right
        positive = counts[:, 1] * p.weight
        churns, inner = positive > counts[:, 0], np.flatnonzero(left != own)
        while len(inner):  # leaves of one parent that say the same become one
            a = left[inner]
            same = (left[a] == a) & (left[a + 1] == a + 1) & (churns[a] == churns[a + 1])
            if not same.any():
                break
            left[inner[same]] = inner[same]
            inner = inner[~same]
        kept, found = np.zeros(self.size, bool), np.zeros(1, np.int64)
        while len(found):
            kept[found] = True
            a = left[found[left[found] != found]]
            found = np.concatenate([a, a + 1])
        right[left == own] = False
        bits = np.packbits(right[kept], axis=1, bitorder="little").view("<i8")
        return feature[kept], bits.ravel(), (np.cumsum(kept) - 1)[left[kept]].astype(np.int32), (positive / (counts[:, 0] + positive))[kept]


def _child(x, slot, feature, right, p: Rules):
    """Which child, counted over the nodes, each row goes to."""
    seen = x.reshape(-1).take(np.arange(len(x)) * p.width + feature.take(slot))
    return slot * 2 + right.reshape(-1).take(slot * p.bins + seen)


def _subsets(rng, k: int, p: Rules):
    if p.subset == p.width:
        return np.tile(np.arange(p.width), (k, 1))
    return np.sort(np.argpartition(rng.random((k, p.width)), p.subset, axis=1)[:, :p.subset], axis=1)


def _finish(tree: Tree, p: Rules, x, y, count, nodes, sizes, depth, rng) -> None:
    """Grow the subtrees under ``nodes`` to their ends; the rows of a node lie together, in the order of ``nodes``."""
    spare = np.empty_like(x)  # rows move from one matrix to the other and back, level by level
    while len(nodes):
        feats, ends, rest, n = _subsets(rng, len(nodes), p), np.cumsum(sizes), [], 0
        for a in range(0, len(nodes), NODES):
            part = slice(a, a + NODES)
            rows = slice(ends[a] - sizes[a], ends[part][-1])
            own, mine, slot = x[rows], y[rows], np.repeat(np.arange(len(nodes[part])), sizes[part])
            hist = _histogram(own, mine, count[rows], slot, feats[part], p)
            feature, right, ids, goes_on = tree.split(nodes[part], depth[part], hist, feats[part])
            child = _child(own, slot, feature, right, p).astype(np.uint16)
            at = np.flatnonzero(goes_on.take(child))
            child = child.take(at)
            at = at.take(np.argsort(child, kind="stable"))
            own.take(at, 0, spare[n:n + len(at)], "clip")
            n += len(at)
            rest.append((mine.take(at), count[rows].take(at), ids[goes_on], np.bincount(child, minlength=len(ids))[goes_on],
                         np.repeat(depth[part] + 1, 2)[goes_on]))
        x, spare = spare[:n], x
        y, count, nodes, sizes, depth = (np.concatenate(c) for c in zip(*rest))


class Store:
    """Binned training rows in a temp file of the task, and their labels."""

    def __init__(self, batches, p: Rules):
        self.p, self.file, labels, self.chunks = p, tempfile.SpooledTemporaryFile(SPOOL), [], []
        for batch in batches:
            for name, x, y in zip(*(batch.column(n) for n in ("chunk", "x", "y"))):
                self.file.write(x.as_buffer())
                labels.append(np.frombuffer(y.as_buffer(), np.uint8))
                self.chunks.append((name.as_py(), len(labels[-1])))
        self.y = np.concatenate(labels)

    def blocks(self, step: int = 4 * BLOCK):
        """Runs of rows in the file, with their places."""
        size = self.p.width * self.p.code.itemsize
        for s in range(0, len(self.y), step):
            self.file.seek(s * size)
            rows = slice(s, min(s + step, len(self.y)))
            yield rows, np.frombuffer(self.file.read((rows.stop - s) * size), self.p.code).reshape(-1, self.p.width)

    def bag(self, tree: int) -> np.ndarray:
        """How often each row is drawn for a tree."""
        if not self.p.bootstrap:
            return np.ones(len(self.y), np.uint8)
        return np.concatenate([np.random.default_rng([self.p.seed % (1 << 63), tree, name]).poisson(1.0, n).astype(np.uint8) for name, n in self.chunks])

    def grow(self, number: int):
        p, y, count = self.p, self.y, self.bag(number)
        tree = Tree(p, np.bincount(y, count, 2))
        at = np.where(count > 0, 0, -1).astype(np.int32)  # the open node of every row
        nodes, depth = np.zeros(1, np.int64), np.zeros(1, np.int64)
        nodes = nodes[tree.opens(tree.counts[0], depth)]
        depth, sizes, small = depth[:len(nodes)], np.full(len(nodes), np.count_nonzero(count)), []
        while len(nodes):
            big = sizes > p.rows
            small.append((nodes[~big], sizes[~big], depth[~big]))
            nodes, depth = nodes[big], depth[big]
            if len(nodes):
                nodes, sizes, depth = self._level(tree, number, at, count, nodes, depth)
        if any(len(c[0]) for c in small):
            self._rest(tree, number, at, count, *(np.concatenate(c) for c in zip(*small)))
        return tree.arrays()

    def _level(self, tree: Tree, number: int, at, count, nodes, depth):
        """Split large nodes by reading the file, and move their rows on."""
        p, slots = self.p, np.full(tree.size, -1)
        slots[nodes] = np.arange(len(nodes))
        feats, hist = _subsets(np.random.default_rng([p.seed % (1 << 63), number, 1, int(nodes[0])]), len(nodes), p), 0

        def mine():
            for rows, x in self.blocks():
                slot = np.where(at[rows] < 0, -1, slots[at[rows]])
                own = np.flatnonzero(slot >= 0)
                yield rows.start + own, x.take(own, 0), slot[own]

        for rows, x, slot in mine():
            hist = hist + _histogram(x, self.y[rows], count[rows], slot, feats, p)
        feature, right, ids, goes_on = tree.split(nodes, depth, hist, feats)
        sizes, to = np.zeros(len(ids), np.int64), np.where(goes_on, ids, -1)
        for rows, x, slot in mine():
            child = _child(x, slot, feature, right, p)
            at[rows] = to[child]
            sizes += np.bincount(child, minlength=len(ids))
        return ids[goes_on], sizes[goes_on], np.repeat(depth + 1, 2)[goes_on]

    def _rest(self, tree: Tree, number: int, at, count, nodes, sizes, depth):
        """Finish small nodes, as many at once as have ``rows`` rows; their rows are brought together in a file for each such group."""
        p, group, held = self.p, [], self.p.rows + 1
        for n in sizes:
            held += n
            if held > p.rows:
                group.append(0 if not group else group[-1] + 1)
                held = n
            else:
                group.append(group[-1])
        group, place = np.array(group), np.full(tree.size + 1, -1, np.int32)
        place[nodes] = group
        slots = np.full(tree.size, -1)
        slots[nodes] = np.arange(len(nodes))
        files = [tempfile.SpooledTemporaryFile(SPOOL) for _ in range(group[-1] + 1)]
        for rows, x in self.blocks():
            to = place[at[rows]]  # rows that are done have -1, the last place
            for g in np.unique(to[to >= 0]):
                files[g].write(x.take(np.flatnonzero(to == g), 0))
        for g, file in enumerate(files):
            file.seek(0)
            x = np.frombuffer(file.read(), p.code).reshape(-1, p.width)
            file.close()
            rows, own = np.flatnonzero(place[at] == g), group == g
            order = np.argsort(slots[at[rows]], kind="stable")
            rng = np.random.default_rng([p.seed % (1 << 63), number, 2, int(nodes[own][0])])
            _finish(tree, p, x.take(order, 0), self.y[rows[order]], count[rows[order]], nodes[own], sizes[own], depth[own], rng)


@dataclass
class Forest:
    """Grown trees: of each its feature numbers, bits of the bins that go right, left children and probabilities."""

    rules: Rules
    trees: list[tuple]

    @property
    def n_nodes(self) -> int:
        return sum(len(t[0]) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the probability at the leaf that a row comes to."""
        p, total = self.rules, np.zeros(len(x))
        flat = p.binned(x).reshape(-1)
        start = np.arange(0, len(flat), p.width)
        for feature, bits, left, value in self.trees:
            feature, left, at = feature.astype(np.int64), left.astype(np.int64), np.zeros(len(x), np.int64)
            while True:
                seen = feature.take(at)
                seen += start
                seen = flat.take(seen)
                to = bits.take(at if p.words == 1 else at * p.words + (seen >> 6))
                to >>= seen & 63
                to &= 1
                to += left.take(at)
                if np.array_equal(to, at):
                    break
                at = to
            total += value.take(at)
        return total / len(self.trees)

    def score(self, df: DataFrame, features: str = "features_raw", out: str = "churn_probability") -> DataFrame:
        """``df`` with the probability of the positive class, computed in the tasks that hold the rows."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def probability(x):
            import pyarrow as pa

            forest = shared.value
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, forest.rules.width))
            return pa.array(forest.probability(rows), pa.float64())

        return df.withColumn(out, probability(vector_to_array(features)))


def rules(df: DataFrame, clf: RandomForestClassifier, pos_weight: float, most_rows: int = ROWS) -> Rules:
    """The learner's parameters, and candidate splits from a sample of as many rows as Spark's learner takes for them."""
    subset, attrs = clf.getFeatureSubsetStrategy(), df.schema[clf.getFeaturesCol()].metadata["ml_attr"]
    width = attrs["num_attrs"]
    named = {a["idx"]: len(a["vals"]) for a in attrs.get("attrs", {}).get("nominal", [])}
    n = df.count()
    if not n:
        raise ValueError("no rows to train on")
    if subset not in ("auto", "sqrt", "all"):
        raise ValueError(f"unknown feature subset {subset}")
    share = max(clf.getMaxBins() ** 2, 10_000) / n
    drawn = df.sample(False, share, clf.getSeed()) if share < 1 else df
    got = drawn.select(vector_to_array(clf.getFeaturesCol()).alias("x"), (F.col(clf.getLabelCol()) > 0).alias("y")).toArrow()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    w = np.where(got.column("y").to_numpy(), pos_weight, 1.0)
    most = min(clf.getMaxBins(), n) - 1
    edges = [np.zeros(0) if f in named else thresholds(x[:, f], w, most) for f in range(width)]
    one = subset == "all" or subset == "auto" and clf.getNumTrees() == 1
    return Rules(clf.getNumTrees(), clf.getMaxDepth(), clf.getMinInstancesPerNode(), width if one else math.ceil(math.sqrt(width)), clf.getSeed(),
                 clf.getBootstrap(), float(pos_weight), edges, np.array([named.get(f, 0) for f in range(width)]), most_rows)


def fit_forest(df: DataFrame, clf: RandomForestClassifier, pos_weight: float = 1.0, most_rows: int = ROWS) -> Forest:
    """``clf``'s forest on all rows of ``df``, whose label is 0 or 1; a positive row weighs ``pos_weight``. Subtrees of up to ``most_rows``
    rows are grown in memory."""
    spark, p = df.sparkSession, rules(df, clf, pos_weight, most_rows)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels other than 0 and 1")
            x = p.binned(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([(part << 32) + number], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()),
                                              "y": pa.array([y.astype(np.uint8).tobytes()], pa.binary())})
            number += 1

    def grow(batches):
        import itertools

        import pyarrow as pa

        first = next(batches)
        store, share = Store(itertools.chain([first], batches), p), first.column("share")[0].as_py()
        for tree in range(share, p.trees, shares):
            arrays = store.grow(tree)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), **{n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(NAMES, arrays)}})

    rows = df.select(vector_to_array(clf.getFeaturesCol()).alias("x"), F.col(clf.getLabelCol()).cast("double").alias("y"))
    chunks = cut_lineage(rows.mapInArrow(write, "chunk long, x binary, y binary"))
    shares = min(p.trees, TASKS * spark.sparkContext.defaultParallelism)
    reads = None  # every task reads all of the binned rows
    for share in range(shares):
        one = chunks.coalesce(1).withColumn("share", F.lit(share))
        reads = one if reads is None else reads.union(one)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        grown = reads.mapInArrow(grow, "tree int, " + ", ".join(f"{n} binary" for n in NAMES)).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    trees = {r["tree"]: tuple(np.frombuffer(r[n], t) for n, t in NAMES.items()) for r in grown}
    return Forest(p, [trees[t] for t in range(p.trees)])


#: Columns of a grown tree and the type of their numbers.
NAMES = {"feature": np.int32, "bits": np.int64, "left": np.int32, "value": np.float64}
