"""N-gram Jaccard join with signature trees.

Documents link when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents with equal sets form a class; only classes are compared.
2. A class of n shingles is put under its lowest ``n - ceil(0.8 n) + n // 10`` shingles by hash,
   frequent shingles last. Two linked classes share at least about n / 10 of those, so classes that
   share fewer with all others together cannot link and go. What remains is put under its rarest
   shared shingles, enough that every linked pair meets under one. Nothing is estimated here.
3. Under one shingle the classes stand in signature trees: a node holds the OR of the token bitmaps
   and the size range of what is below. Two trees (or a tree and itself) are walked together; a pair
   of nodes is left as soon as the largest overlap it could hold is too small, or when all below it
   is one component already. Large groups are dealt to blocks and each pair of blocks is one task.
4. A task returns candidate pairs only if these are no more than its classes. Else a second task
   counts their overlaps exactly, unites the linked ones and returns the links that joined two
   components, fewer than it has classes.
5. A first pass under two min-hashes joins most copies. The second pass looks at every shingle under
   which two components still meet.

The list of frequent shingles is broadcast: one in ``HOT_SHARE`` of all documents or more, of the
shingles in prefixes only, so their number is at most ``HOT_SHARE`` times the mean prefix length
whatever the input. Their rows are dealt by shingle and class, never by shingle alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from exposia.llm.components import components
from exposia.llm.groups import apply_to_groups
from exposia.llm.text import group_sums, mix, shingle_sets, signed, text_chunks
from exposia.sources.staging import materialize

SIMILARITY = 0.8
HOT_SHARE = 500
BLOCK = 1500
LEAF, FAN = 16, 8
_U = np.uint64


def needed(n: np.ndarray) -> np.ndarray:
    """Least overlap of a set of n shingles with any set it links to: ceil(0.8 n)."""
    return -(-4 * n // 5)


def slack(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 10)


def links(size_a, size_b, overlap):
    """The link test in whole numbers."""
    return (100 * overlap >= 80 * (size_a + size_b - overlap)) & (overlap > 0)


def set_ids(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, whatever the order."""
    total = group_sums(mix(values ^ _U(0x5BF0_3635)), offsets)
    return mix(total + np.diff(offsets).astype(_U))


def lowest(values: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the prefix of each set, frequent shingles last, and the owners."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.arange(len(values))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
        order = np.lexsort((values, hot[at] == values, owner))
    rank = np.arange(len(values)) - offsets[:-1][owner]
    keep = rank < (n - needed(n) + slack(n))[owner]
    return order[keep], owner[keep]


class SignatureTree:
    """Sets as leaves of a tree whose nodes hold OR-ed bitmaps, size ranges and component spans."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, extra: np.ndarray, labels: np.ndarray):
        """Sets must come in the wanted order. ``extra``: shingles that share their bit with others."""
        self.sizes, self.bits, self.extra, self.labels = sizes, bits, extra, labels
        self.levels = [self._level(np.arange(0, len(sizes), LEAF), bits, sizes, sizes, extra, labels, labels)]
        while len(self.levels[-1][1]) > 1:
            below = self.levels[-1][1:]
            self.levels.append(self._level(np.arange(0, len(below[0]), FAN), *below))

    @staticmethod
    def _level(starts, bits, low, high, extra, first, last):
        return (
            starts,
            np.bitwise_or.reduceat(bits, starts, axis=0),
            np.minimum.reduceat(low, starts),
            np.maximum.reduceat(high, starts),
            np.maximum.reduceat(extra, starts),
            np.minimum.reduceat(first, starts),
            np.maximum.reduceat(last, starts),
        )

    def children(self, level: int, node: int) -> range:
        starts = self.levels[level][0]
        total = len(self.sizes) if level == 0 else len(self.levels[level - 1][0])
        return range(starts[node], starts[node + 1] if node + 1 < len(starts) else total)


def may_link(low_a, high_a, low_b, high_b, common, extra):
    """Whether sets in these size ranges with so many common bits could overlap enough."""
    most = np.minimum(common + extra, np.minimum(high_a, high_b))
    return (9 * most >= 4 * (low_a + low_b)) & (5 * high_a >= 4 * low_b) & (5 * high_b >= 4 * low_a)


def walk(left: SignatureTree, right: SignatureTree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that survive the walk of two trees from their roots."""
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    stack = [(la, 0, lb, 0)]
    while stack:
        i, a, j, b = stack.pop()
        if i == 0 and j == 0:
            rows, cols = left.children(0, a), right.children(0, b)
            r, c = slice(rows.start, rows.stop), slice(cols.start, cols.stop)
            common = np.bitwise_count(left.bits[r, None, :] & right.bits[None, c, :]).sum(axis=2, dtype=np.int64)
            extra = np.minimum(left.extra[r][:, None], right.extra[c][None, :])
            sa, sb = left.sizes[r][:, None], right.sizes[c][None, :]
            apart = left.labels[r][:, None] != right.labels[c][None, :]
            x, y = np.nonzero(apart & may_link(sa, sa, sb, sb, common, extra))
            x, y = x + rows.start, y + cols.start
            if same:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
            continue
        # the deeper node opens: both trees go down together
        first, second = ([a], [b])
        ni, nj = i, j
        if i >= j:
            first, ni = left.children(i, a), i - 1
        if j >= i:
            second, nj = right.children(j, b), j - 1
        fa, fb = np.asarray(list(first)), np.asarray(list(second))
        _, bits_a, low_a, high_a, extra_a, first_a, last_a = left.levels[ni]
        _, bits_b, low_b, high_b, extra_b, first_b, last_b = right.levels[nj]
        common = np.bitwise_count(bits_a[fa][:, None, :] & bits_b[fb][None, :, :]).sum(axis=2, dtype=np.int64)
        extra = np.minimum(extra_a[fa][:, None], extra_b[fb][None, :])
        ok = may_link(low_a[fa][:, None], high_a[fa][:, None], low_b[fb][None, :], high_b[fb][None, :], common, extra)
        ok &= (first_a[fa][:, None] != last_b[fb][None, :]) | (last_a[fa][:, None] != first_b[fb][None, :])
        for x, y in zip(*np.nonzero(ok)):
            if not same or ni != nj or fa[x] <= fb[y]:
                stack.append((ni, int(fa[x]), nj, int(fb[y])))


class Union:
    """Components inside one task."""

    def __init__(self, labels: np.ndarray):
        names, at = np.unique(labels, return_inverse=True)
        self.parent, self.at = list(range(len(names))), at

    def root(self, i: int) -> int:
        x = self.at[i]
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)


def signatures(values: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of ``width`` 64-bit cells and how many shingles share a bit with another one."""
    n = np.diff(offsets)
    owner = np.repeat(np.arange(len(n)), n)
    bit = (values >> _U(20)) % _U(64 * width)
    flags = np.zeros((len(n), 64 * width), bool)
    flags[owner, bit.astype(np.int64)] = True
    packed = np.packbits(flags, axis=1, bitorder="little").view(_U)
    return packed, n - flags.sum(axis=1)


def _width(sizes: np.ndarray) -> int:
    """Bitmap cells for sets of these sizes: two bits a shingle, a power of two, 2 KB at most."""
    most = int(sizes.max(initial=1))
    return 1 << max(0, min(8, int(np.ceil(np.log2(max(1, 2 * most / 64))))))


def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different texts of each chunk, named by their hash."""
    for batch in text_chunks(batches):
        mark, at = np.unique(np.asarray(batch.column("mark"), np.int64), return_index=True)
        texts = batch.column("text").take(pa.array(at)).to_pylist()
        z = [zlib.compress((t or "").encode(), 6) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(z, pa.binary())], names=["mark", "z"])


def _sets_of(packed) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(pa.array([zlib.decompress(z).decode() for z in packed], pa.large_string()))


def _pairs(found: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    table = np.asarray(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0].copy()), pa.array(table[:, 1].copy())], names=["a", "b"])


def _cells(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The bitmap of each set in its own power-of-two width."""
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        bits, _ = signatures(values[a:b], np.array([0, b - a]), _width(np.array([b - a])))
        out.append(bits.tobytes())
    return out


def _fold(cells: bytes, width: int) -> np.ndarray:
    """A bitmap in a narrower power-of-two width: the same shingles modulo fewer bits."""
    return np.bitwise_or.reduce(np.frombuffer(cells, _U).reshape(-1, width), axis=0)


def _candidates(sizes: np.ndarray, cells: list[bytes], labels: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different components that the bitmaps allow, as places in the arrays.

    The sizes of linked sets differ by a quarter at most and so the widths of their bitmaps by one
    step: sets meet those of their own width and of the next, folded to the narrower of the two.
    With two sides only pairs across are walked.
    """
    width = np.array([len(c) // 8 for c in cells])
    order = np.lexsort((sizes, labels))
    two = side.min() != side.max()
    trees: dict[tuple, tuple[np.ndarray, SignatureTree]] = {}

    def tree(at_side: int, own: int, folded: int) -> tuple[np.ndarray, SignatureTree | None]:
        key = (at_side, own, folded)
        if key not in trees:
            rows = order[(width[order] == own) & ((side[order] == at_side) | (not two))]
            if not len(rows):
                trees[key] = rows, None
            else:
                bits = np.stack([_fold(cells[r], folded) for r in rows])
                extra = sizes[rows] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
                trees[key] = rows, SignatureTree(sizes[rows], bits, extra, labels[rows])
        return trees[key]

    for w in np.unique(width).tolist():
        meetings = [((0, w), (1, w)), ((0, w), (1, 2 * w)), ((0, 2 * w), (1, w))] if two else [((0, w), (0, w)), ((0, w), (0, 2 * w))]
        for left, right in meetings:
            (rows_a, tree_a), (rows_b, tree_b) = tree(*left, w), tree(*right, w)
            if tree_a and tree_b:
                for x, y in walk(tree_a, tree_b, left == right):
                    yield rows_a[x], rows_b[y]
        trees.clear()


def _with_candidates(group: pa.Table) -> pa.RecordBatch | None:
    """The candidates of one task: its pairs (set_id, other) if these are no more than its rows, else
    the sets that have a candidate there (other null). Either way at most as many rows as came in."""
    sizes, label, side, ids = (group[c].to_numpy() for c in ("n", "label", "side", "set_id"))
    marked, pairs, n_pairs = np.zeros(len(sizes), bool), [], 0
    for i, j in _candidates(sizes, group["bits"].to_pylist(), label, side):
        marked[i] = marked[j] = True
        n_pairs += len(i)
        if n_pairs <= len(sizes):
            pairs.append((i, j))
    if not n_pairs:
        return None
    columns = group.select(["key", "low", "high", "side", "set_id", "label"])
    if n_pairs > len(sizes):
        rows = columns.filter(pa.array(marked)).combine_chunks().to_batches()[0]
        return rows.append_column("other", pa.nulls(len(rows), pa.int64()))
    i, j = (np.concatenate(end) for end in zip(*pairs))
    low = np.where(ids[i] < ids[j], i, j)
    rows = columns.take(pa.array(low)).combine_chunks().to_batches()[0]
    return rows.append_column("other", pa.array(np.maximum(ids[i], ids[j])))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            (va, oa), (vb, ob) = (_sets_of(part.column(c).to_pylist()) for c in ("za", "zb"))
            overlap = [len(np.intersect1d(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], True)) for i in range(len(part))]
            keep = links(np.diff(oa), np.diff(ob), np.array(overlap, np.int64))
            yield part.select(["a", "b"]).filter(pa.array(keep))


def _linked_in_group(group: pa.Table) -> pa.RecordBatch:
    """Exact links that join the components of one task, fewer than it has sets.

    Overlaps of a set with its candidates are counted together; sets that are one component by now are left out.
    """
    values, offsets = _sets_of(group["z"].to_pylist())
    ids, labels, side = (group[c].to_numpy() for c in ("set_id", "label", "side"))
    sizes = np.diff(offsets)
    names = np.unique(values, return_inverse=True)[1]
    held = np.zeros(int(names.max(initial=0)) + 1, bool)
    union, found = Union(labels), []
    for x, y in _candidates(sizes, _cells(values, offsets), labels, side):
        for i in np.unique(x).tolist():
            others = np.array([j for j in y[x == i].tolist() if union.root(j) != union.root(i)], np.int64)
            if not len(others):
                continue
            own = names[offsets[i] : offsets[i + 1]]
            held[own] = True
            at = np.concatenate([[0], np.cumsum(sizes[others])])
            every = np.concatenate([names[offsets[j] : offsets[j + 1]] for j in others])
            overlap = np.add.reduceat(held[every].astype(np.int64), at[:-1])
            held[own] = False
            for j in others[links(sizes[i], sizes[others], overlap)].tolist():
                if union.root(i) != union.root(j):
                    union.join(i, j)
                    found.append((ids[i], ids[j]))
    return _pairs(found)


TASK = ("key", "low", "high")


def _dealt(rows: DataFrame, pairs: bool) -> DataFrame:
    """Rows with a task: a group above BLOCK rows is split into blocks, or into pairs of blocks.

    ``side`` tells the two blocks of a pair apart.
    """
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    rows = rows.join(count, "key").withColumn("_n", F.ceil(F.col("_rows") / BLOCK).cast("int"))
    rows = rows.withColumn("_p", F.pmod(F.xxhash64("set_id"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1)) if pairs else F.col("_p")
    rows = rows.withColumn("_q", other).withColumn("side", (F.col("_p") > F.col("_q")).cast("int"))
    ends = {"low": F.least("_p", "_q"), "high": F.greatest("_p", "_q")}
    return rows.withColumns(ends).drop("_rows", "_n", "_p", "_q")


def _relabel(sets: DataFrame, edges: list[DataFrame]) -> DataFrame:
    """``sets`` with the label of each set's component so far."""
    if not edges:
        return sets.withColumn("label", F.col("set_id"))
    found = edges[0]
    for more in edges[1:]:
        found = found.union(more)
    label = components(found).withColumnsRenamed({"id": "set_id", "component": "label"})
    return sets.join(label, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows under keys where more than one component meets; of keys over the same sets, one stays."""
    over = [F.bit_xor(F.xxhash64("set_id", F.lit(i))).alias(f"_x{i}") for i in range(2)]
    label = F.min("label").alias("_a"), F.max("label").alias("_b")
    keys = rows.groupBy("key").agg(*label, *over, F.count(F.lit(1)).alias("_c")).filter("_a != _b")
    keys = keys.groupBy("_x0", "_x1", "_c").agg(F.min("key").alias("key"))
    return rows.join(keys.select("key"), "key", "left_semi")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set; per chunk the prefix shingles that look frequent (doc_id null)."""
    none = np.zeros(0, _U)
    for batch in text_chunks(batches):
        values, offsets = shingle_sets(batch.column("text"))
        n, ids = np.diff(offsets), set_ids(values, offsets)
        at, _ = lowest(values, offsets, none)
        token, count = np.unique(values[at], return_counts=True)
        often = count >= max(4, len(batch) / HOT_SHARE)
        token, count = token[often], count[often]
        pad = len(token)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(pad, pa.int64())]),
                pa.concat_arrays([batch.column("mark"), pa.nulls(pad, pa.int64())]),
                pa.concat_arrays([pa.array(n), pa.array(count.astype(np.int64))]),
                pa.concat_arrays([signed(ids), signed(token)]),
                pa.array(np.r_[np.zeros(len(n), bool), np.ones(pad, bool)]),
            ],
            names=["doc_id", "mark", "n", "value", "is_token"],
        )


def _prefixes(hot: np.ndarray):
    """Prefix rows. A rare shingle is the key itself; a frequent one is kept beside a spread key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            values, offsets = shingle_sets(batch.column("text"))
            ids = set_ids(values, offsets)
            at, owner = lowest(values, offsets, hot)
            once = np.zeros(len(ids), bool)
            once[np.unique(ids, return_index=True)[1]] = True
            at, owner = at[once[owner]], owner[once[owner]]
            token, sets = values[at], ids[owner]
            place = np.minimum(np.searchsorted(hot, token), max(len(hot) - 1, 0))
            frequent = hot[place] == token if len(hot) else np.zeros(len(token), bool)
            key = np.where(frequent, mix(token ^ mix(sets)), token)
            size = np.diff(offsets)[owner].astype(np.int32)
            name = pa.array(token.view(np.int64), mask=~frequent)
            yield pa.RecordBatch.from_arrays([signed(key), name, signed(sets), pa.array(size)], names=["key", "token", "set_id", "n"])

    return rows


def jaccard_join(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text; more are ignored).

    ``n_shingles`` counts distinct five-word shingles; a text of one to four words is one shingle, a
    null, empty or blank text has none and links with nothing. ``component_id`` is the smallest
    doc_id reachable by links. Rows with the same doc_id each give a row. A null doc_id keeps its
    row and takes the smallest known id of its component, null if there is none. Shingles and sets
    are told apart by 64-bit hashes.
    """
    label = jaccard_groups(docs)
    least_id = label.groupBy("label").agg(F.min("doc_id").alias("component_id")).filter("label is not null")
    result = label.join(least_id, "label", "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return result.select("doc_id", F.col("n").alias("n_shingles"), component)


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, n, label`` for every row of ``docs``: a hash of the text, the number of its
    shingles, and a name of its component, null for a text without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    scan = marked.mapInArrow(_scan, "doc_id long, mark long, n long, value long, is_token boolean")
    scan = materialize(scan, "sets")
    members = scan.filter("not is_token").select("doc_id", "mark", "n", F.col("value").alias("set_id"))

    # Fewer than HOT_SHARE * (mean prefix) shingles can stand in a HOT_SHARE-th of all documents.
    total = members.count()
    tokens = scan.filter("is_token").groupBy("value").agg(F.sum("n").alias("n"))
    frequent = tokens.filter(F.col("n") >= max(8, total / HOT_SHARE)).select("value").toPandas()["value"]
    hot = np.sort(frequent.to_numpy(np.int64).view(_U))

    rows = docs.mapInArrow(_prefixes(hot), "key long, token long, set_id long, n int")
    same = "over (partition by key)"
    counted = rows.selectExpr(
        "*", f"min(set_id) {same} as _low", f"max(set_id) {same} as _high", f"count(1) {same} as df"
    )
    token = F.coalesce("token", "key").alias("token")
    df = F.when(F.col("token").isNull(), F.col("df")).otherwise(F.lit(1 << 40)).alias("df")
    shared = counted.filter("_low != _high or token is not null").select(token, "set_id", "n", df)
    shared = materialize(shared.dropDuplicates(["token", "set_id"]), "shared")

    # A link needs at least `least` common shingles here, so all but the last least - 1 can be keys.
    smallest = F.ceil(F.col("n") * 4 / 5)
    least = F.greatest(F.lit(1), F.floor(smallest / 10))
    per_set = shared.groupBy("set_id").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("keys")
    )
    per_set = per_set.withColumn("_keys", (F.size("keys") - least + 1).cast("int")).filter("_keys > 0")
    per_set = per_set.select("set_id", "n", F.slice("keys", 1, F.col("_keys")).alias("keys"))
    routed = materialize(per_set.select("set_id", "n", F.transform("keys", lambda k: k["token"]).alias("keys")), "routed")

    first = members.filter("n > 0").groupBy("set_id").agg(F.min("mark").alias("mark"))
    wanted = routed.select("set_id").join(first, "set_id")
    packed = marked.mapInArrow(pack_texts, "mark long, z binary")
    texts = packed.join(wanted, "mark").dropDuplicates(["set_id"]).select("set_id", "z")
    texts = materialize(texts, "texts")

    hashed = [F.array_min(F.transform("keys", lambda k: F.xxhash64(k, F.lit(i)))) for i in range(2)]
    rows = routed.select("set_id", F.col("set_id").alias("label"), F.explode(F.array(*hashed)).alias("key"))
    edges = [_first_links(_mixed(rows.distinct()), texts)]
    rows = _relabel(routed.select("set_id", F.explode("keys").alias("key")), edges)
    edges.append(_last_links(_mixed(rows), texts))
    label = _relabel(members, edges).withColumn("label", F.when(F.col("n") > 0, F.col("label")))
    return label.select("doc_id", "mark", "n", "label")


def _first_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    tasks = _dealt(rows, pairs=False).join(texts, "set_id")
    return materialize(apply_to_groups(tasks, TASK, _linked_in_group, "a long, b long"), "links")


def _with_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of two bits a shingle, each in its own power-of-two width."""
    for batch in batches:
        for start in range(0, len(batch), 256):
            part = batch.slice(start, 256)
            values, offsets = _sets_of(part.column("z").to_pylist())
            columns = [part.column("set_id"), pa.array(np.diff(offsets)), pa.array(_cells(values, offsets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["set_id", "n", "bits"])


def _last_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between components that still meet under a key, none left out that would join two.

    Bitmaps first show the candidates of a task. A few pairs are verified one by one, each once for
    all tasks; the sets of a crowded task meet again with their texts, and what it then returns joins
    its components and is no list of pairs.
    """
    bits = materialize(texts.mapInArrow(_with_signatures, "set_id long, n long, bits binary"), "bits")
    tasks = _dealt(rows.select("key", "set_id", "label"), pairs=True).join(bits, "set_id")
    schema = "key long, low int, high int, side int, set_id long, label long, other long"
    near = materialize(apply_to_groups(tasks, TASK, _with_candidates, schema), "near")
    pairs = near.filter("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("set_id").alias(end), F.col("z").alias(f"z{end}")), end)
    found = pairs.select("a", "b", "za", "zb").mapInArrow(_verify, "a long, b long")
    crowded = near.filter("other is null").join(texts, "set_id")
    return materialize(found.union(apply_to_groups(crowded, TASK, _linked_in_group, "a long, b long")), "links")
