"""Vector codes: product quantisation trained by dual-tree Lloyd rounds on exact integers.

Each component x becomes floor(SCALE * x); a vector is cut into ``parts`` equal consecutive
parts, each position with its own codebook of up to ``entries`` entries.  A round assigns
every part to the nearest entry (squared Euclidean distance, ties to the lower index), then
replaces each entry by the componentwise floor of its parts' mean; unused entries stay.

Dual tree: vectors are cut once into chunks, and each chunk keeps one balanced tree of
parts per position, with the bounding box, sum and number of parts of every node, in a
stored table that all rounds read.  A round builds a small tree over each codebook's entries
and walks both together, level by level: a pair (part node, entry node) goes when its least
distance is above the greatest distance of another entry node.  A part node with one entry
left is assigned whole by its cached sum; leaves with several are settled part by part.
Boxes, bounds, distances and sums are 64-bit integers, so nothing depends on the order of
rows, chunks or tasks.

Only sums per (position, entry) leave the tasks, aggregated by Spark: what reaches the driver
is one codebook's size, whatever the number of vectors.

Rows with a null vector or a null or non-finite component are dropped; rows with a null id
stay (last among the first entries) and repeated rows count each.  With fewer rows than
entries there are as many entries as rows; an empty table gives an empty result.  All
vectors must have one length that ``parts`` divides and components that 64-bit integers can
hold squared, else a task fails with a message that says so.  Null labels are one label.
Other columns may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_groups, pick, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Parts in a leaf and vectors in a chunk at most.
LEAF, CHUNK = 16, 1024


def integers(vectors) -> np.ndarray:
    """floor(SCALE * x) of each component."""
    return np.floor(np.asarray(vectors, dtype=np.float64) * SCALE)


def _levels(n: int) -> list[np.ndarray]:
    """Cuts of 0..n by level: node i of a level is cuts[i]..cuts[i + 1], its children are 2i, 2i + 1."""
    cuts = [np.array([0, n])]
    while np.diff(cuts[-1]).max() > LEAF:
        a = cuts[-1]
        both = np.empty(2 * len(a) - 1, dtype=np.int64)
        both[::2], both[1::2] = a, (a[:-1] + a[1:]) // 2
        cuts.append(both)
    return cuts


class PartTree:
    """Parts of one position in tree order, ``order`` being their places in the chunk, and per
    level the boxes, sums and numbers of the nodes."""

    def __init__(self, points: np.ndarray, order: np.ndarray, lo: list, hi: list, sums: list):
        self.points, self.order, self.lo, self.hi, self.sums = points, order, lo, hi, sums
        self.cuts = _levels(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> PartTree:
        order, los, his, sums = np.arange(len(points)), [], [], []
        for cuts in _levels(len(points)):
            if los:                                   # split the nodes above at the median of their widest side
                wide = np.argmax(his[-1] - los[-1], axis=1)
                node = np.repeat(np.arange(len(wide)), np.diff(cuts[::2]))
                order = order[np.lexsort((points[order, wide[node]], node))]
            at = points[order]
            los.append(np.minimum.reduceat(at, cuts[:-1]))
            his.append(np.maximum.reduceat(at, cuts[:-1]))
            sums.append(np.add.reduceat(at, cuts[:-1]))
        return cls(points[order], order, los, his, sums)

    def stored(self) -> dict:
        nodes = np.concatenate([np.concatenate(x) for x in (self.lo, self.hi, self.sums)])
        return {"points": self.points.tobytes(), "places": self.order.astype("<i4").tobytes(), "nodes": nodes.tobytes()}

    @classmethod
    def loaded(cls, row: dict, n: int) -> PartTree:
        points = np.frombuffer(row["points"], np.int64).reshape(n, -1)
        cuts = _levels(n)
        sizes = [len(c) - 1 for c in cuts]
        nodes = np.frombuffer(row["nodes"], np.int64).reshape(3, sum(sizes), -1)
        at = np.cumsum(sizes)[:-1]
        return cls(points, np.frombuffer(row["places"], "<i4"), *[np.split(x, at) for x in nodes])


class EntryTree:
    """The entries of one codebook: per level boxes and children; the last level has one entry a node."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        level, self.lo, self.hi, self.children = [np.arange(len(entries))], [], [], []
        while True:
            self.lo.append(np.array([entries[m].min(0) for m in level]))
            self.hi.append(np.array([entries[m].max(0) for m in level]))
            if all(len(m) == 1 for m in level):
                break
            below, kids = [], []
            for m in level:
                side = np.argmax(entries[m].max(0) - entries[m].min(0))
                m = m[np.argsort(entries[m, side], kind="stable")]
                halves = [x for x in (m[:len(m) // 2], m[len(m) // 2:]) if len(x)]
                kids.append([len(below), len(below) + len(halves) - 1])
                below += halves
            self.children.append(np.array(kids))
            level = below
        self.leaf = np.array([m[0] for m in level])       # entry of each node of the last level


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges first..first + count flattened, and which range each value comes from."""
    which = np.repeat(np.arange(len(first)), count)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count), which


def _nearest_in_leaves(parts: PartTree, entries: np.ndarray, p: np.ndarray, e: np.ndarray):
    """Rows of ``parts.points`` in the leaves of the pairs (leaf p, entry e), and their nearest entry."""
    cuts = parts.cuts[-1]
    leaves, first = np.unique(p, return_index=True)
    rows, which = _expand(cuts[leaves], cuts[leaves + 1] - cuts[leaves])
    offset = np.cumsum(cuts[leaves + 1] - cuts[leaves]) - (cuts[leaves + 1] - cuts[leaves])
    at = np.searchsorted(leaves, p)
    local, pair = _expand(offset[at], (cuts[leaves + 1] - cuts[leaves])[at])
    gap = parts.points[rows[local]] - entries[e[pair]]
    dist = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
    dist[local, e[pair]] = np.einsum("ij,ij->i", gap, gap)
    return rows, dist.argmin(axis=1)                      # the first, so the lower index, of equal ones


def assign(parts: PartTree, tree: EntryTree):
    """Yields (level, node, entry) arrays for nodes assigned whole, then (None, row, entry) for
    parts settled one by one."""
    p, e, level, depth = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    bottom, last = len(parts.cuts) - 1, len(tree.lo) - 1
    while len(p):
        lo, hi, elo, ehi = parts.lo[level][p], parts.hi[level][p], tree.lo[depth][e], tree.hi[depth][e]
        near = np.maximum(np.maximum(elo - hi, lo - ehi), 0)
        far = np.maximum(hi - elo, ehi - lo)
        least, most = np.einsum("ij,ij->i", near, near), np.einsum("ij,ij->i", far, far)
        start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))      # pairs are in order of p
        count = np.diff(np.append(start, len(p)))
        bound = np.repeat(np.minimum.reduceat(most, start), count)
        keep = least < bound
        if depth == last:                                 # equal: the lower entry of those at the bound wins
            entry = tree.leaf[e]
            winner = np.repeat(np.minimum.reduceat(np.where(most == bound, entry, len(tree.entries)), start), count)
            keep |= (least == bound) & (entry <= winner)
        else:
            keep |= least == bound
        p, e = p[keep], e[keep]
        if depth == last:
            start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            alone = np.diff(np.append(start, len(p))) == 1
            yield level, p[start[alone]], tree.leaf[e[start[alone]]]
            left = ~np.repeat(alone, np.diff(np.append(start, len(p))))
            p, e = p[left], e[left]
            if level == bottom:
                break
        if depth < last:
            kids = tree.children[depth][e]
            e, which = _expand(kids[:, 0], kids[:, 1] - kids[:, 0] + 1)
            p, depth = p[which], depth + 1
        if level < bottom:
            p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
            order = np.argsort(p, kind="stable")
            p, e, level = p[order], e[order], level + 1
    if len(p):
        yield None, *_nearest_in_leaves(parts, tree.entries, p, tree.leaf[e])


def entry_sums(parts: PartTree, tree: EntryTree) -> np.ndarray:
    """Per entry the sum of its parts, then their number."""
    out = np.zeros((len(tree.entries), parts.points.shape[1] + 1), dtype=np.int64)
    for level, at, entry in assign(parts, tree):
        np.add.at(out[:, :-1], entry, parts.points[at] if level is None else parts.sums[level][at])
        np.add.at(out[:, -1], entry, 1 if level is None else np.diff(parts.cuts[level])[at])
    return out


def codes_of(parts: PartTree, tree: EntryTree) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part, in the chunk's order."""
    code = np.zeros(len(parts.points), dtype=np.int64)
    for level, at, entry in assign(parts, tree):
        if level is None:
            code[at] = entry
        else:
            rows, which = _expand(parts.cuts[level][at], np.diff(parts.cuts[level])[at])
            code[rows] = entry[which]
    gap = parts.points - tree.entries[code]
    out, error = np.empty_like(code), np.empty_like(code)
    out[parts.order], error[parts.order] = code, np.einsum("ij,ij->i", gap, gap)
    return out, error


def _matrix(column: pa.Array, parts: int, width: int) -> np.ndarray:
    if (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError(f"all vectors must have the length {width} of the first id's vector")
    x = integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))
    if len(x) and 4.0 * width * np.abs(x).max() ** 2 >= 2.0 ** 62:
        raise ValueError("components too large for 64-bit squared distances")
    return x.astype(np.int64)


PART = T.ArrayType(T.StructType([T.StructField(c, T.BinaryType()) for c in ("points", "places", "nodes")]))


def _chunks(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """One row per chunk: ids, labels and the trees of its parts."""
    fields = kept.schema
    schema = T.StructType([T.StructField("ids", T.ArrayType(fields["vec_id"].dataType)),
                           T.StructField("labels", T.ArrayType(fields["label"].dataType)), T.StructField("trees", PART)])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                x = _matrix(b.column("embedding"), parts, width)
                trees = [PartTree.build(x[:, i:i + width // parts]).stored() for i in range(0, width, width // parts)]
                row = [pa.array([b.column("vec_id").to_pylist()], kinds.field("ids").type),
                       pa.array([b.column("label").to_pylist()], kinds.field("labels").type), pa.array([trees], kinds.field("trees").type)]
                yield pa.RecordBatch.from_arrays(row, names=schema.names)

    return kept.mapInArrow(run, schema)


def _loaded(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            n = len(row.column("ids")[0])
            yield row, n, [PartTree.loaded(t, n) for t in row.column("trees")[0].as_py()]


def _round(chunks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    def run(batches):
        trees, total = [EntryTree(b) for b in books], [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for _, _, parts in _loaded(batches):
            for p, t, s in zip(parts, trees, total):
                s += entry_sums(p, t)
        flat = np.concatenate([s.ravel() for s in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "total"])

    sums = chunks.select("ids", "trees").mapInArrow(run, "place long, total long").where("total != 0")
    flat = np.zeros(sum(len(b) * (b.shape[1] + 1) for b in books), dtype=np.int64)
    for r in sums.groupBy("place").agg(F.sum("total").alias("total")).collect():     # at most the codebooks' size
        flat[r.place] = r.total
    out, at = [], 0
    for b in books:
        s = flat[at:at + b.size + len(b)].reshape(len(b), -1)
        used = s[:, -1:] > 0
        out.append(np.where(used, s[:, :-1] // np.maximum(s[:, -1:], 1), b))          # // is floor
        at += b.size + len(b)
    return out


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(vector).isNotNull() & fine)


def train(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
          entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(stored chunks, codebooks after ``rounds`` rounds); no codebooks for an empty table."""
    kept = usable(pick(df, vec_id=vec_id, embedding=vector, label=label), "embedding")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()     # as many rows as entries
    if not first:
        return stored(_chunks(kept, parts, parts), "vector-chunks"), []
    width = len(first[0].embedding)
    if width % parts or not width:
        raise ValueError(f"{parts} parts do not divide {width} components")
    chunks = stored(_chunks(kept, parts, width), "vector-chunks")
    start = _matrix(pa.array([r.embedding for r in first], pa.list_(pa.float64())), parts, width)
    books = [start[:, i:i + width // parts] for i in range(0, width, width // parts)]
    for _ in range(rounds):
        books = _round(chunks, books)
    return chunks, books


def encode(chunks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (one byte a part up to 256 entries, two beyond) and error."""
    ids, labels = chunks.schema["ids"].dataType.elementType, chunks.schema["labels"].dataType.elementType
    schema = T.StructType([T.StructField("vec_id", ids), T.StructField("label", labels), T.StructField("codes", T.BinaryType()),
                           T.StructField("error", T.LongType())])
    kind = np.uint8 if max((len(b) for b in books), default=0) <= 256 else np.uint16

    def run(batches):
        trees = [EntryTree(b) for b in books]
        for row, n, parts in _loaded(batches):
            got = [codes_of(p, t) for p, t in zip(parts, trees)]
            codes = np.stack([c for c, _ in got], axis=1).astype(kind)
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(),
                                              pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(e for _, e in got))], names=schema.names)

    return chunks.mapInArrow(run, schema)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the error summed over their label (nulls together)."""
    rows = stored(coded, "vector-codes")
    groups = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "vector-labels")
    return join_groups(rows, groups, ["label"], "n").drop("n")
