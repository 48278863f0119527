"""Block matrix products over message vectors: nearest neighbours and similarity links.

Vectors are quantised to int8 codes with one scale each; code products are whole numbers
(formed in float32 registers, where they are exact), and the norms of the quantisation
errors bound how far a product can be from the cosine. Only pairs whose bound reaches the
threshold or a row's current k-th best survive; they are recomputed in float64 from the
stored vectors, and each row's best are merged by per-group heaps (window group limits).

All-pairs searches are blocked by cells: a bounded sample of the vectors are the cells'
centres, and each vector enters its PROBES nearest cells, so two vectors meet unless they
share none of these; every vector is indexed. Where every link has to be found (``covered``),
the cells are balls around dense places and one open cell for all vectors in no ball, and a
vector enters each ball that the triangle inequality on angles can't exclude. Cells are cut
into blocks and block pairs are the unit of work, so a cell of any size spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.runtime import store

DIM, K, PROBES, BLOCK = 64, 5, 5, 2_048
#: Rows of a block at most where blocks grow with their cell: a tile's vectors take 64 MB.
LARGE = 131_072
#: Cells: one for CELL_ROWS vectors, at most MAX_CELLS (a broadcast of MAX_CELLS * DIM floats, 4 MB).
CELL_ROWS, MAX_CELLS = 256, 16_384
#: Balls: found in a sample of one in BALL_ROWS vectors, at most MAX_CELLS, where at least BALL_LEAST of them lie together. They only save work.
BALL_ROWS, BALL_LEAST = 4, 4
#: Smaller dense places are looked for among the open cell's rows: in BALL_SEEN sampled vectors at most (13 MB on the driver), of them one in OPEN_ROWS of the cell, for OPEN_ROUNDS rounds or until one closes less than OPEN_GAIN of the cell.
BALL_SEEN, OPEN_ROWS, OPEN_ROUNDS, OPEN_GAIN = 49_152, 8, 4, 0.02
#: Angles: what is added to a ball's radius, and what covers the rounding of float32 angles.
MARGIN, SLACK = 0.08, 0.005


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column, all of ``width`` numbers, as one array, without a Python object for each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), width)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, vec, dir): each message_id once whose embedding has ``dim`` finite numbers, not all zero.

    ``dir`` is a hash of the direction rounded to 1e-6, equal for copies of any length. Null, short,
    empty, zero and non-finite vectors are left out; repeated ids count once; other columns are ignored.
    """

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import xxhash

        for b in batches:
            right = pc.equal(pc.list_value_length(b.column(1)), dim)
            ids, flat = b.column(0).filter(right), b.column(1).filter(right).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            good = np.isfinite(x).all(1) & x.any(1)
            a = x[good]
            u = a / np.abs(a).max(1, keepdims=True)
            u = np.round(u / np.linalg.norm(u, axis=1, keepdims=True), 6) + 0.0
            dirs = [xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in u]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), binary(a.astype("<f4")), pa.array(dirs, pa.int64())], ["id", "vec", "dir"])

    rows = vectors.where("message_id is not null and embedding is not null").select(F.col("message_id").cast("bigint"), F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(shape, "id bigint, vec binary, dir bigint").dropDuplicates(["id"])


def units(vecs: list[bytes] | pa.Array, dim: int = DIM) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), "<f4").reshape(-1, dim) if isinstance(vecs, list) else matrix(vecs, "<f4", dim)
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of unit vectors."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    return codes, scale.astype(np.float32), np.linalg.norm(x - codes * scale[:, None], axis=1).astype(np.float32)


def products(ca: np.ndarray, sa: np.ndarray, ea: np.ndarray, cb: np.ndarray, sb: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate cosines of two blocks and the bound of their error (|x'y' - xy| <= |ex| |y| + |x'| |ey|)."""
    p = ca.astype(np.float32) @ cb.astype(np.float32).T
    p *= sa[:, None]
    p *= sb[None, :]
    return p, ea[:, None] + (1 + ea[:, None]) * eb[None, :] + np.float32(1e-5)


def centres(rows: DataFrame, n: int) -> np.ndarray:
    """Cell centres: the vectors with the smallest hashes of their ids, one for CELL_ROWS rows and at most MAX_CELLS."""
    return _sample(rows, int(min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))))


def _sample(rows: DataFrame, want: int) -> np.ndarray:
    picked = rows.select("vec", F.xxhash64("id").alias("h")).orderBy("h", "vec").limit(want).collect()  # bounded by BALL_SEEN
    return units([bytes(r["vec"]) for r in picked]).astype(np.float32) if picked else np.zeros((0, DIM), np.float32)


def balls(sample: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and radii (angles) of balls around the dense places of a sample, densest first."""
    near = np.concatenate([(sample[at : at + 256] @ sample.T >= link).sum(1) for at in range(0, len(sample), 256)]) if len(sample) else np.zeros(0, int)
    left, centre, radius = np.ones(len(sample), bool), [], []
    for i in np.argsort(-near, kind="stable"):
        if near[i] < BALL_LEAST:
            break
        if not left[i]:
            continue
        m = sample[i]
        for _ in range(3):
            m = sample[sample @ m >= link - 0.05].mean(0)
            m /= np.linalg.norm(m)
        c = sample @ m
        own = c >= link - 0.05
        left[own] = False
        left[i] = False
        if own.sum() >= BALL_LEAST:
            centre.append(m)
            radius.append(np.arccos(min(1.0, c[own].min())) + MARGIN)
    return np.array(centre, np.float32).reshape(-1, sample.shape[1]), np.array(radius, np.float32)


def inside(x: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Whether each unit vector lies in a ball."""
    least = np.cos(radius)
    return np.concatenate([np.zeros(0, bool), *((x[at : at + 8_192] @ centre.T >= least).any(1) for at in range(0, len(x), 8_192))])


def places(sample: np.ndarray, n: int, link: float) -> tuple[np.ndarray, np.ndarray]:
    """Balls of a sample of n vectors in the order of hashes; those of its first MAX_CELLS vectors first, then further ones among the vectors in no ball."""
    centre, radius = balls(sample[:MAX_CELLS], link)
    rest = sample[~inside(sample, centre, radius)]
    for _ in range(OPEN_ROUNDS):
        some = rest[: int(len(rest) / max(1, len(sample)) * n / OPEN_ROWS)]
        c, r = balls(some, link)
        c, r = c[: MAX_CELLS - len(centre)], r[: MAX_CELLS - len(radius)]
        if not len(c):
            break
        centre, radius = np.concatenate([centre, c]), np.concatenate([radius, r])
        before, rest = len(rest), rest[~inside(rest, c, r)]
        if len(rest) > (1 - OPEN_GAIN) * before:
            break
    return centre, radius


def entered(x: np.ndarray, centre: np.ndarray, radius: np.ndarray, link: float) -> np.ndarray:
    """Mask of the cells that unit vectors enter: the balls within reach of a link, and the last, open cell for those in no ball.

    Two vectors of an angle of at most acos(link) meet: both in no ball, in the open cell; else one lies in a
    ball, and the other is at most its radius and that angle away from the ball's centre.
    """
    c = np.clip(x.astype(np.float32) @ centre.T, -1, 1)
    return np.hstack([c >= np.cos(np.minimum(np.pi, radius + np.float32(np.arccos(link) + SLACK))), ~(c >= np.cos(radius)).any(1, keepdims=True)])


def _coder(bc, probes: int, link: float | None = None):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bc.value if bc is not None else None
        for whole in batches:
            for at in range(0, whole.num_rows, 2_048):
                b = whole.slice(at, 2_048)
                x = units(b.column(1))
                codes, scale, err = quantise(x)
                ends, cells = np.zeros(len(x) + 1, np.int32), np.zeros(0, np.int32)
                if link is not None and c is not None:
                    row, cells = np.nonzero(entered(x, *c, link))
                    ends[1:] = np.bincount(row, minlength=len(x)).cumsum()
                elif c is not None:
                    p = x.astype(np.float32) @ c.T
                    k = min(probes, p.shape[1])
                    cells = np.sort(np.argpartition(-p, k - 1, axis=1)[:, :k], axis=1).ravel()
                    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(k)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), binary(codes), pa.array(scale), pa.array(err), lists], ["id", "code", "scale", "err", "cells"])

    return code


CODED = "id bigint, code binary, scale float, err float, cells array<int>"


def coded(rows: DataFrame, probes: int = PROBES) -> DataFrame:
    """(id, code, scale, err, cells) of (id, vec): int8 codes and the cells entered."""
    n = rows.count()
    bc = rows.sparkSession.sparkContext.broadcast(centres(rows, n)) if n else None
    return store(rows.select("id", "vec").mapInArrow(_coder(bc, probes), CODED))


def covered(rows: DataFrame, link: float) -> DataFrame:
    """Like ``coded``, with cells in which any two vectors of a cosine of at least ``link`` meet."""
    n = rows.count()
    want = min(BALL_SEEN, -(-n // BALL_ROWS))
    few = rows.where(F.xxhash64("id") < int(-(2**63) + 2**64 * min(0.999, (1.2 * want + 1_000) / max(1, n))))  # more than the sample, so that not all rows are put in order
    bc = rows.sparkSession.sparkContext.broadcast(places(_sample(few, want), n, link)) if n else None
    return store(rows.select("id", "vec").mapInArrow(_coder(bc, 0, link), CODED))


def tiles(code: DataFrame, wide: float = 1, cells: bool = True, most: int | None = None) -> DataFrame:
    """Rows spread over pairs of blocks of ``wide`` * BLOCK rows: (cell, a, b, side, id, code, scale, err, cells), sorted by tile within partitions.

    A row is copied once for each block of its cell. With ``most``, cells of more than ``most`` blocks get larger blocks instead, of up to LARGE rows.
    """
    sizes = code.select(F.explode("cells").alias("cell")).groupBy("cell").count()
    n = F.ceil(F.col("count") / (wide * BLOCK))
    if most is not None:
        n = F.greatest(F.least(n, F.lit(most)), F.ceil(F.col("count") / LARGE))
    blocks = sizes.select("cell", n.cast("int").alias("n"))  # one row for each cell
    at = code.select("*", F.explode("cells").alias("cell")).join(F.broadcast(blocks), "cell")  # at most MAX_CELLS rows
    at = at.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return (
        at.select("cell", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), (F.col("mine") > F.col("other")).alias("side"), "id", "code", "scale", "err", *["cells"] * cells)
        .repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    )


class Tile:
    """The rows of one block pair; ``left`` and ``right`` are row numbers (the same for a block with itself)."""

    def __init__(self, key: tuple[int, int, int], rows: pa.Table, dim: int = DIM):
        self.cell, self.a, self.b = key
        self.ids = rows.column("id").to_numpy()
        self.codes = matrix(rows.column("code"), "i1", dim)
        self.scale, self.err = rows.column("scale").to_numpy(), rows.column("err").to_numpy()
        self.cells = None
        if "cells" in rows.column_names:  # each row enters as many
            self.cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        side = rows.column("side").to_numpy(zero_copy_only=False)
        self.left = np.arange(len(side)) if self.a == self.b else np.flatnonzero(~side)
        self.right = self.left if self.a == self.b else np.flatnonzero(side)

    def products(self, x: np.ndarray | None = None, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        x, y = (self.left, self.right) if x is None else (x, y)
        return products(self.codes[x], self.scale[x], self.err[x], self.codes[y], self.scale[y], self.err[y])

    def first_meeting(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether this cell is the first that the rows i and j share (they may meet in several)."""
        both = (self.cells[i][:, :, None] == self.cells[j][:, None, :]).any(2)
        return np.where(both, self.cells[i], np.iinfo(np.int32).max).min(1) == self.cell


def each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
    """The tiles of a partition sorted by (cell, a, b); a tile's rows may come in several batches."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for x, y in zip(cuts, cuts[1:]):
            if (now := tuple(keys[x].tolist())) != key:
                if held:
                    yield Tile(key, pa.Table.from_batches(held))
                key, held = now, []
            held.append(b.slice(x, y - x))
    if held:
        yield Tile(key, pa.Table.from_batches(held))


def best_by_bounds(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Mask of the entries of each row that can be among its k largest, given bounds."""
    if low.shape[1] <= k:
        return np.ones(low.shape, bool)
    kth = np.partition(low, -k, axis=1)[:, -k]
    return high >= kth[:, None]


def _top_hits(row: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """The same of sparse entries: mask of those that can be among their row's k largest."""
    order = np.lexsort((-low, row))
    begin = np.flatnonzero(np.diff(row[order], prepend=-1))
    size = np.diff(begin, append=len(row))
    kth = np.full(len(begin), -np.inf)
    kth[size > k] = low[order][begin[size > k] + k - 1]
    keep = np.zeros(len(row), bool)
    keep[order] = high[order] >= np.repeat(kth, size)
    return keep


def _survivors(threshold: float, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_tile(batches):
            p, e = t.products()
            if t.a == t.b:
                np.fill_diagonal(p, -2)
            i, j = np.nonzero(p + e >= threshold)
            if not len(i):
                continue
            low, high = p[i, j] - e[i, j], p[i, j] + e[i, j]
            x, y = t.left[i], t.right[j]
            a = _top_hits(i, low, high, k)
            src, dst = [x[a]], [y[a]]
            if t.a != t.b:
                a = _top_hits(j, low, high, k)
                src.append(y[a])
                dst.append(x[a])
            s, d = np.concatenate(src), np.concatenate(dst)
            first = t.first_meeting(s, d)
            yield pa.RecordBatch.from_arrays([pa.array(t.ids[s[first]]), pa.array(t.ids[d[first]])], ["src", "dst"])

    return find


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            c = np.einsum("ij,ij->i", units(b.column(2)), units(b.column(3)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.round(c, 12))], ["src", "dst", "cosine"])


def exact_cosines(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, dst, cosine) of pairs (src, dst), in float64."""
    v = rows.select("id", "vec")
    joined = pairs.join(v.withColumnRenamed("id", "src").withColumnRenamed("vec", "x"), "src").join(v.withColumnRenamed("id", "dst").withColumnRenamed("vec", "y"), "dst")
    return joined.select("src", "dst", "x", "y").mapInArrow(_exact, "src bigint, dst bigint, cosine double")


def first_k(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """The first k rows of each key; rows beyond are dropped before the shuffle, so a hot key stays small."""
    from pyspark.sql import Window

    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= k).drop("__r")


def copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of one direction stand for each other: (id, rep) of all rows, and the rows (id, vec) of the representatives."""
    reps = rows.groupBy("dir").agg(F.min("id").alias("rep"))
    member = store(rows.select("id", "dir").join(reps, "dir").select("id", "rep"))
    return member, rows.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "vec")


def near_pairs(vectors: DataFrame, threshold: float = 0.975, k: int = K) -> DataFrame:
    """(message_id_a, message_id_b, cosine), a < b: pairs of at least ``threshold`` of which one is among the other's k most similar.

    On equal cosine (to 12 digits) the smaller id goes first. Copies of one direction are searched
    once; of a group of copies only the k + 1 smallest ids can be anyone's neighbours, so a group of
    any size costs its own rows only. Unusable vectors and repeated rows see ``usable``.
    """
    rows = store(usable(vectors))
    member, reps = copies(rows)
    reps = store(reps)
    found = tiles(coded(reps)).mapInArrow(_survivors(threshold, k), "src bigint, dst bigint").distinct()
    links = exact_cosines(found, reps).where(F.col("cosine") >= threshold)
    links = store(first_k(links, "src", [F.desc("cosine"), F.asc("dst")], k))
    first = first_k(member, "rep", [F.asc("id")], k + 1)  # the members that can be neighbours
    crowd = member.groupBy("rep").count().where("count > 1").select("rep")
    own = crowd.select(F.col("rep").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("cosine"))
    options = own.unionByName(links).join(first.select(F.col("rep").alias("dst"), F.col("id").alias("b")), "dst").select("src", "b", "cosine")
    options = first_k(options, "src", [F.desc("cosine"), F.asc("b")], k + 1)
    each = member.join(options.withColumnRenamed("src", "rep"), "rep").where("id <> b")
    each = first_k(each, "id", [F.desc("cosine"), F.asc("b")], k)
    return each.select(F.least("id", "b").alias("message_id_a"), F.greatest("id", "b").alias("message_id_b"), "cosine").distinct()


def _top_survivors(k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_tile(batches):
            if not len(t.left) or not len(t.right):
                continue
            for at in range(0, len(t.left), 256):
                x = t.left[at : at + 256]
                p, e = products(t.codes[x], t.scale[x], t.err[x], t.codes[t.right], t.scale[t.right], t.err[t.right])
                ids, right = t.ids, t.right
                keep = best_by_bounds(p - e, p + e, k + 1)  # one more, as a row meets itself
                i, j = np.nonzero(keep)
                src, dst = ids[x[i]], ids[right[j]]
                ok = src != dst
                yield pa.RecordBatch.from_arrays([pa.array(src[ok]), pa.array(dst[ok])], ["src", "dst"])

    return find


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = 4_096, block: int = 32_768) -> DataFrame:
    """(src, dst, cosine, rank): the k most similar other messages of each query id, exact, over all usable rows.

    ``queries`` has (id). Query blocks meet blocks of all rows; copies count as messages of their own.
    """
    rows = store(usable(vectors))
    code = coded(rows, 1).drop("cells")
    q = code.join(queries.select("id").distinct(), "id", "left_semi")
    n_q, n_d = max(1, -(-q.count() // query_block)), max(1, -(-code.count() // block))
    tile = lambda df, side, mine, other: df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit({"a": n_q, "b": n_d}[mine])).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit({"a": n_q, "b": n_d}[other] - 1)))
    ).select(F.lit(0).alias("cell"), "a", (F.col("b") + n_q).alias("b"), F.lit(side).alias("side"), "id", "code", "scale", "err")
    both = tile(q, False, "a", "b").unionByName(tile(code, True, "b", "a"))
    found = both.repartition("a", "b").sortWithinPartitions("cell", "a", "b").mapInArrow(_top_survivors(k), "src bigint, dst bigint").distinct()
    from pyspark.sql import Window

    best = first_k(exact_cosines(found, rows), "src", [F.desc("cosine"), F.asc("dst")], k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("cosine"), F.asc("dst"))))
