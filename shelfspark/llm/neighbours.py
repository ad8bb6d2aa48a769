"""The most similar vectors of every vector: multi-index hashing on learned binary codes, then float reranking.

Vectors become binary codes by rotations that are learned on a bounded sample (iterative quantisation).
A code is cut into substrings, each with an index of its own: rows with an equal substring meet in a
bucket. By the pigeonhole principle two codes within a Hamming distance below the number of substrings
share at least one, so every code within that radius is retrieved. Candidates are filtered by the Hamming
distance of a further part of the code and reranked by their floats.

Substrings have 0.4 log2(N) + 8.7 bits, and their number follows from the similarity and recall asked for
(see `plan`); so buckets hold few rows (5 of 300 thousand, 90 of 50 million), and the index grows little
faster than the data (as N to the power 1.07).
"""

from __future__ import annotations

import math

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfspark.util import bounded_sample, hot_keys

#: Rows the rotations are learned on, and rounds of learning.
SAMPLE, ROUNDS = 8192, 15

#: Share of pairs at exactly the least cosine that may be expected to meet; closer pairs meet far more often.
RECALL = 0.9

#: Buckets of up to twice so many rows, or eight times a usual bucket, are compared by the filter's bits. Larger
#: ones, as in dense clusters, are compared by floats, pair by pair of blocks, and keep the best of each row.
WINDOW = 128

#: Rows of a block, and the share of the rows from which a class of equal vectors is broadcast.
BLOCK, HOT = 49152, 1 / 512

#: Bits of code, beside the substrings, by which candidates are filtered, and standard deviations allowed.
FILTER_BITS, DEVIATIONS = 128, 3


def usable(v: Column, dim: int) -> Column:
    """Not null, of `dim` finite numbers, not zero."""
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.isNotNull() & (F.size(v) == dim) & length.isNotNull() & ~F.isnan(length) & (length > 0) & (length < float("inf"))


@dataclass(frozen=True)
class Plan:
    bits: int
    tables: int
    radius: int
    window: int
    rotations: np.ndarray


def plan(n: int, dim: int, cosine: float, sample: np.ndarray, recall: float = RECALL, seed: int = 7) -> Plan:
    """Number and length of substrings for n rows. A bit of two vectors at angle a differs with chance a/pi."""
    same = 1 - math.acos(min(1.0, cosine)) / math.pi
    bits = max(6, min(32, round(0.4 * math.log2(max(n, 2)) + 8.7)))
    tables = max(4, math.ceil(math.log(1 - recall) / math.log1p(-(same**bits))))
    rotations = learn(sample, math.ceil(bits * tables / dim) + math.ceil(FILTER_BITS / dim), dim, seed)
    radius = math.ceil(FILTER_BITS * (1 - same) + DEVIATIONS * math.sqrt(FILTER_BITS * same * (1 - same)))
    window = max(WINDOW, 4 * n >> bits)
    return Plan(bits, tables, radius, window, rotations)


def learn(sample: np.ndarray, count: int, dim: int, seed: int) -> np.ndarray:
    """`count` rotations, each turned so that the sample lies close to the corners of the cube."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(ROUNDS if len(sample) > dim else 0):
            b = np.where(sample @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(b.T @ sample)
            r = (u @ vt).T
        out.append(r)
    return np.stack(out).astype(np.float32)


def codes(x: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Bits (n, count * dim) as uint8."""
    return (x.astype(np.float32) @ np.concatenate(list(rotations), axis=1) >= 0).astype(np.uint8)


def substrings(bit: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys (n, tables), the table's number from bit 40 on; and FILTER_BITS further bits as two numbers."""
    weights = (1 << np.arange(bits, dtype=np.int64)).astype(np.int64)
    used = bit[:, : bits * tables].reshape(len(bit), tables, bits)
    keys = used.astype(np.int64) @ weights + (np.arange(tables, dtype=np.int64) << 40)
    rest = np.ascontiguousarray(np.packbits(bit[:, -FILTER_BITS:], axis=1)).view(">u8").astype(np.uint64)
    return keys, rest[:, 0], rest[:, 1]


def _matrix(column, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v) of the usable rows, v of unit length; copies of a row stay."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("v"), dim))


def neighbours(df: DataFrame, k: int = 10, cosine: float = 0.9, dim: int = 64, id_col: str = "chunk_id", vector_col: str = "embedding", recall: float = RECALL, least: int = 10_000) -> DataFrame:
    """(id, other, cosine): for every usable vector its k most similar others with at least `cosine`.

    Unusable vectors (null, zero, another length, a number missing or not finite) take no part. Rows with
    the same id count once. Ties go to the smaller id. Vectors that are the same but for their length form
    a class, of which only the k + 1 smallest ids are searched; the other members have these as neighbours.
    So a class may hold any share of the rows; one with `least` rows or more and 1/512 of them is not
    gathered. All pairs of every bucket are compared. An empty table or a single usable row gives no rows.
    """
    spark = df.sparkSession
    rows = unit_vectors(df, id_col, vector_col, dim)
    sample_rows = bounded_sample(rows, "id", SAMPLE).toPandas().sort_values("id")
    sample = np.array([np.asarray(v, np.float64) for v in sample_rows.v]).reshape(-1, dim)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
    p = plan(df.count(), dim, cosine, sample, recall)
    shared = spark.sparkContext.broadcast(p)

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            bit = np.packbits(codes(x, shared.value.rotations), axis=1)
            rounded = np.ascontiguousarray(np.round(x * 65536).astype(np.int32))
            import xxhash

            same = np.fromiter((xxhash.xxh3_64_intdigest(r) for r in rounded.view(f"V{4 * dim}").ravel()), np.uint64, len(x)).view(np.int64)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bit.shape[1]), len(bit), [None, pa.py_buffer(bit.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), flat.cast(pa.binary())], names=["id", "same", "code"])

    vectors = rows.groupBy("id").agg(F.first("v").alias("v"))
    coded = vectors.mapInArrow(code, "id long, same long, code binary")
    # classes of equal vectors that hold a large share of the rows: at most 1/HOT of them
    hot = hot_keys(coded, ["same"], HOT, least)
    marked = coded.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "same", "left")
    place = F.row_number().over(W.partitionBy("same").orderBy("id"))
    first = marked.filter("hot").select("same", "id", "code").withColumn("r", place).filter(F.col("r") <= k + 1)
    other = marked.filter("hot is null").select("same", "id", "code").withColumn("r", place)
    searched = other.filter(F.col("r") <= k + 1).select("id", "code").unionByName(first.select("id", "code"))

    def index(batches):
        import pyarrow as pa

        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            bit = np.unpackbits(raw, axis=1)[:, : len(p.rotations) * dim]
            keys, rest, more = substrings(bit, p.bits, p.tables)
            ids = np.asarray(batch.column(0))
            columns = [keys.ravel(), *(np.repeat(c, p.tables) for c in (rest.view(np.int64), more.view(np.int64), ids))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "rest", "more", "id"])

    def buckets(batches, small: bool):
        """Arrays of whole buckets up to the limit (small), or of the rows of those above it. Rows come sorted by bucket."""
        limit = 2 * shared.value.window
        carry, above = [np.zeros(0, np.int64)] * 4, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([c, np.asarray(x)]) for c, x in zip(carry, batch.columns)]
            bucket = cols[0]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.repeat(np.diff(np.r_[starts, len(bucket)]), np.diff(np.r_[starts, len(bucket)]))
            big = (size > limit) | (bucket == above) if above is not None else size > limit
            open_ = np.arange(len(bucket)) >= starts[-1]  # the last bucket may go on
            above = bucket[-1] if big[-1] else None
            out = ~big & ~open_ if small else big
            yield [c[out] for c in cols]
            carry = [c[open_ & ~big] for c in cols]
        if small:
            yield carry

    def meet(batches):
        import pyarrow as pa

        radius = shared.value.radius
        for bucket, rest, more, ids in buckets(batches, True):
            left, right = [], []
            at = np.arange(len(ids))
            for d in range(1, len(ids)):
                at = at[at + d < len(ids)]
                b = at + d
                at = at[bucket[at] == bucket[b]]
                if not len(at):
                    break
                b = at + d
                far = np.bitwise_count((rest[at] ^ rest[b]).view(np.uint64)).astype(np.int16) + np.bitwise_count((more[at] ^ more[b]).view(np.uint64))
                left.append(ids[at[far <= radius]])
                right.append(ids[b[far <= radius]])
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            b = np.concatenate(right) if right else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def large(batches):
        import pyarrow as pa

        for bucket, _, _, ids in buckets(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids)], names=["grp", "id"])

    indexed = searched.mapInArrow(index, "bucket long, rest long, more long, id long").repartition("bucket").sortWithinPartitions("bucket")
    met = indexed.mapInArrow(meet, "a long, b long").distinct()
    va, vb = vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    pairs = met.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(_rerank(dim), "a long, b long, cosine double").filter(F.col("cosine") >= cosine)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "cosine"))
    dense = blocked(indexed.mapInArrow(large, "grp long, id long").join(vectors, "id"), k, cosine, dim)
    top = _best(both.unionByName(dense).distinct(), k)
    return top.unionByName(_copies(marked.filter("hot"), first, k, True)).unionByName(_copies(other, other.filter(F.col("r") <= k + 1), k, False))


def exact_neighbours(df: DataFrame, k: int = 10, dim: int = 64, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(id, other, cosine): for every usable vector its k most similar others, however far; fewer only if there are fewer.

    All pairs of vectors are compared, so the work grows with the square of the rows: neighbours of no least
    similarity have no index that beats this for less than an approximation. Odd input as in `neighbours`.
    """
    vectors = unit_vectors(df, id_col, vector_col, dim).groupBy("id").agg(F.first("v").alias("v"))
    return _best(blocked(vectors.withColumn("grp", F.lit(0).cast("long")), k, -2.0, dim), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other"))).filter(F.col("n") <= k).drop("n")


def blocked(rows: DataFrame, k: int, cosine: float, dim: int, block: int | None = None) -> DataFrame:
    """(id, other, cosine) of the k most similar others with at least `cosine` in each pair of blocks of each group.

    rows: grp, id, v. All pairs of a group are compared. A group is cut into blocks of about `block` rows, so no
    task holds more than two of them; counts of groups are one row for each.
    """
    sizes = rows.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block or BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # block i meets block j in (min, max); a row goes to every pair of its own block
    placed = rows.join(sizes, "grp").withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = placed.select("grp", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "v")

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        ids, own = table["id"].to_numpy(), table["own"].to_numpy()
        x = _matrix(table["v"].combine_chunks(), dim)
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out = closest(x[a], ids[a], x[b], ids[b], k, cosine, i == j)
        return pa.table([pa.array(c) for c in out], names=["id", "other", "cosine"])

    return pairs.groupBy("grp", "i", "j").applyInArrow(run, "id long, other long, cosine double")


#: Rows and columns of a tile of the matrix of cosines, and the error allowed to its 32-bit numbers.
TILE, ERROR = (1024, 4096), 4e-6


def closest(xa: np.ndarray, ia: np.ndarray, xb: np.ndarray, ib: np.ndarray, k: int, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, other, cosine of the k best of every row of a among b, and, unless they are the same, of b among a.

    Tiles are computed with 32 bits; 2k + 2 candidates are kept for each row and ranked with 64 bits.
    """
    keep = 2 * k + 2
    fa, fb = xa.astype(np.float32), xb.astype(np.float32)
    low = np.float32(cosine - ERROR)

    def seeded(f, g):
        bar = np.full(len(f), low)
        if cosine < -1 and len(g) >= 1024:
            for r in range(0, len(f), 1024):
                s = f[r : r + 1024] @ g[:1024].T
                bar[r : r + 1024] = np.partition(s, 1023 - keep, axis=1)[:, 1023 - keep] - np.float32(ERROR)
        return bar, np.full((len(f), keep), -np.inf, np.float32), np.full((len(f), keep), -1, np.int64)

    def merge(state, row, value, col):
        bar, best, at = state
        order = np.lexsort((-value, row))
        row, value, col = row[order], value[order], col[order]
        which, start, count = np.unique(row, return_index=True, return_counts=True)
        place = np.arange(len(row)) - np.repeat(start, count)
        ok = place < keep
        line = np.repeat(np.arange(len(which)), count)[ok]
        v, c = np.full((len(which), keep), -np.inf, np.float32), np.full((len(which), keep), -1, np.int64)
        v[line, place[ok]], c[line, place[ok]] = value[ok], col[ok]
        v, c = np.concatenate([best[which], v], 1), np.concatenate([at[which], c], 1)
        top = np.argpartition(-v, keep - 1, axis=1)[:, :keep]
        best[which], at[which] = np.take_along_axis(v, top, 1), np.take_along_axis(c, top, 1)
        bar[which] = np.maximum(bar[which], best[which].min(1))

    sa = seeded(fa, fb)
    sb = None if same else seeded(fb, fa)
    for c in range(0, len(fb), TILE[1]):
        for r in range(0, len(fa), TILE[0]):
            s = fa[r : r + TILE[0]] @ fb[c : c + TILE[1]].T
            y, z = np.divmod(np.flatnonzero(s >= sa[0][r : r + TILE[0], None]), s.shape[1])
            if same:
                y, z = y[y + r != z + c], z[y + r != z + c]
            if len(y):
                merge(sa, y + r, s[y, z], z + c)
            if not same:
                y, z = np.divmod(np.flatnonzero(s >= sb[0][None, c : c + TILE[1]]), s.shape[1])
                if len(y):
                    merge(sb, z + c, s[y, z], y + r)
    out = []
    for state, x, ids, g, others in [(sa, xa, ia, xb, ib)] + ([] if same else [(sb, xb, ib, xa, ia)]):
        row, place = np.nonzero(state[2] >= 0)
        col = state[2][row, place]
        value = np.minimum(np.einsum("ij,ij->i", x[row], g[col]), 1.0)
        order = np.lexsort((others[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        start = np.searchsorted(row, np.arange(len(x)))
        ok = (np.arange(len(row)) - start[row] < k) & (value >= cosine)
        out.append((ids[row[ok]], others[col[ok]], value[ok]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _copies(members: DataFrame, first: DataFrame, k: int, few: bool) -> DataFrame:
    """Neighbours of the members of classes of equal vectors beyond the first k + 1: the k smallest ids.

    Which members those are needs no ranking of the class: each is larger than the class's (k + 1)-th id.
    few: the classes are as few as `hot`, and broadcast.
    """
    heads = first.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > k)  # k + 1 ids at most
    joined = members.select("same", "id").join(F.broadcast(heads) if few else heads, "same").filter(F.col("id") > F.element_at("ids", -1))
    return joined.select("id", F.explode(F.slice("ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))


def _rerank(dim: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.einsum("ij,ij->i", _matrix(batch.column(2), dim), _matrix(batch.column(3), dim))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.minimum(c, 1.0))], names=["a", "b", "cosine"])

    return run


def similar_pairs(found: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs one of which is among the neighbours of the other."""
    return found.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()
