"""Exact nearest vectors by cosine: tiles of vectors held against tiles of queries, block by block.

Vectors are placed into cells of like direction and packed into tiles of up to ``TILE`` rows; up to
``BLOCK`` consecutive tiles are a block. Queries are packed alike, but blocks of them are bounded by
rows alone. Every block of queries meets every block of vectors with the same key in one task, which
holds those two blocks and nothing else, so no task grows with the table, and no vector passes through
the driver but for the bounded sample that the cells' centres are fitted on. What is shuffled grows
with the number of blocks, so there are as many as rows ask for, however many partitions there are;
and vectors of floats travel as such and are normalised where they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage_table

TILE, BLOCK = 1024, 16
#: Vectors that the cells' centres are fitted on, at most, and how many centres there are for them.
SAMPLE, CENTRES = 4096, 64
#: Cosines are compared by so many digits; ties go to the smaller id.
DIGITS = 9
#: What rounding may take from a bound.
SLACK = 1e-8


def directions(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the lists of each length; null, empty and zero ones and those that hold
    a null or a number that is not finite are left out."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        m = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, n)
        most = np.abs(m).max(axis=1)
        good = np.isfinite(most) & (most > 0)
        m = m[good] / most[good, None]
        yield at[good], m / np.linalg.norm(m, axis=1, keepdims=True)


def scaled(m: np.ndarray) -> np.ndarray:
    """Unit vectors of finite rows that are not zero."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def binaries(m: np.ndarray) -> pa.Array:
    """The rows of a matrix of floats or doubles as binary values."""
    data = np.ascontiguousarray(m, dtype=m.dtype if m.dtype == np.float32 else np.float64)
    offsets = np.arange(len(data) + 1, dtype=np.int64) * data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def spherical_means(rows: np.ndarray, n: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """``n`` unit centres of unit ``rows``, by rounds of assignment and averaging; fewer where the
    rows they start from are equal. A centre that no row is nearest to stays where it is."""
    rows = np.asarray(rows)
    centres = np.unique(rows[np.random.default_rng(seed).permutation(len(rows))[:n]], axis=0)
    for _ in range(rounds):
        sums = (np.arange(len(centres))[:, None] == (rows @ centres.T).argmax(axis=1)).astype(float) @ rows
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where((norms > 1e-12)[:, None], sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def sampled(vectors: DataFrame, most: int, vector: str = "embedding", ident: str = "vec_id") -> dict[int, np.ndarray]:
    """Unit vectors of about ``most`` rows, by their length: what a model may be fitted on in the driver.
    Rows are chosen by a hash of their id."""
    n = vectors.count()
    share = F.pmod(F.xxhash64(ident), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))
    rows = vectors.where(share).select(vector).limit(2 * most).toArrow()[vector].combine_chunks()
    return {m.shape[1]: m for _, m in directions(rows) if len(m)}


def located(rows: DataFrame, ident: str, place: Callable[[np.ndarray], np.ndarray], key: Column | None = None, vector: str = "embedding") -> DataFrame:
    """(id, key, dim, cell, unit) of the rows that have an id, a key and a direction; ``place`` gives the
    cells of unit vectors. ``unit`` is the unit vector as doubles, or a vector of floats as it is."""
    rows = rows.select(F.col(ident).alias("id"), (F.lit("") if key is None else key.cast("string")).alias("key"), F.col(vector).alias("vector")).where("id IS NOT NULL AND key IS NOT NULL")

    plain = rows.schema["vector"].dataType.elementType.typeName() == "float"

    def run(batches):
        for b in batches:
            for at, m in directions(b["vector"]):
                if len(m):
                    few = pa.array(at)
                    own = b["vector"].take(few).flatten().to_numpy(zero_copy_only=False).reshape(m.shape) if plain else m
                    yield pa.RecordBatch.from_arrays([b["id"].take(few), b["key"].take(few), pa.array(np.full(len(m), m.shape[1], np.int32)), pa.array(place(m).astype(np.int32)), binaries(own)], ["id", "key", "dim", "cell", "unit"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key string, dim int, cell int, unit binary")


def tiled(placed: DataFrame, name: str, rows: int, tile: int = TILE, block: int = BLOCK, most: int | None = None) -> DataFrame:
    """About ``rows`` rows (id, key, dim, cell, unit) as a written table of tiles (key, dim, block, tile, ids, unit).
    A block has ``block`` tiles at most; with ``most``, as many as hold so many rows.

    Ranges of (key, cell, hash of the id) are dealt out, so a cell or key with very many rows
    spans many tasks; a tile's rows are of one key and one cell.
    """
    kind = placed.schema["id"].dataType.simpleString()
    partitions = max(1, min(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (tile * block))))
    dealt = placed.withColumn("deal", F.xxhash64("id")).repartitionByRange(partitions, "key", "dim", "cell", "deal").sortWithinPartitions("key", "dim", "cell", "deal")

    def run(batches):
        part = TaskContext.get().partitionId()
        held, held_as, size, tiles, run_of, run_rows = [], None, 0, 0, None, 0

        def flush():
            nonlocal held, size, tiles, run_of, run_rows
            if not size:
                return None
            rows = pa.Table.from_batches(held).combine_chunks()
            full = tiles - run_of[1] >= block if most is None and run_of else run_rows + size > (most or 0)
            if run_of is None or run_of[0] != held_as[:2] or full:
                run_of, run_rows = (held_as[:2], tiles), 0
            run_rows += size
            unit = b"".join(rows["unit"].to_pylist())
            row = {"key": held_as[0], "dim": held_as[1], "block": f"{part}-{run_of[1]}", "tile": f"{part}-{tiles}", "unit": unit}
            ids = rows["id"].combine_chunks()
            out = pa.RecordBatch.from_arrays([*(pa.array([row[c]]) for c in ("key", "dim", "block", "tile")), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([unit], pa.binary())], ["key", "dim", "block", "tile", "ids", "unit"])
            held, size, tiles = [], 0, tiles + 1
            return out.set_column(1, "dim", out["dim"].cast(pa.int32()))

        for b in batches:
            columns = [b[c].to_pylist() for c in ("key", "dim", "cell")]
            at = list(zip(*columns, strict=True))
            i = 0
            while i < b.num_rows:
                if at[i] != held_as or size >= tile:
                    if (out := flush()) is not None:
                        yield out
                    held_as = at[i]
                j = i
                while j < b.num_rows and at[j] == held_as and size + j - i < tile:
                    j += 1
                held.append(b.select(["id", "unit"]).slice(i, j - i))
                size, i = size + j - i, j
        if (out := flush()) is not None:
            yield out

    return stage_table(dealt.select("id", "key", "dim", "cell", "unit").mapInArrow(run, f"key string, dim int, block string, tile string, ids array<{kind}>, unit binary"), name)


class Best:
    """The best ``k`` of the vectors that a tile of queries has met; ties go to the smaller id."""

    def __init__(self, queries: int, k: int, digits: int = DIGITS):
        self.k, self.digits = k, digits
        self.score = np.full((queries, k), -np.inf)
        self.exact = np.zeros((queries, k))
        self.id = np.full((queries, k), -1, np.int64)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, cosine: np.ndarray, ids: np.ndarray) -> None:
        """``cosine`` of the queries ``rows`` with vectors whose ranks by id are ``ids``."""
        k, n = self.k, len(ids)
        exact = np.concatenate([self.exact[rows], cosine], axis=1)
        score = np.concatenate([self.score[rows], np.round(cosine, self.digits)], axis=1)
        names = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), n))], axis=1)
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        r, c = np.nonzero(score >= least[:, None])  # the k-th and its ties are all there
        order = np.lexsort((names[r, c], -score[r, c], r))
        r, c = r[order], c[order]
        first = np.searchsorted(r, np.arange(len(rows)))
        place = np.arange(len(r)) - first[r]
        keep = place < k
        r, c, place = r[keep], c[keep], place[keep]
        self.score[rows[r], place], self.exact[rows[r], place], self.id[rows[r], place] = score[r, c], exact[r, c], names[r, c]


def _matrix(data: bytes, dim: int, rows: int) -> np.ndarray:
    """The unit vectors of a tile of ``rows`` rows."""
    if len(data) == 8 * dim * rows:
        return np.frombuffer(data, np.float64).reshape(-1, dim)
    return scaled(np.frombuffer(data, np.float32).reshape(-1, dim).astype(np.float64))


def met(left: pa.Table, right: pa.Table, k: int, digits: int = DIGITS) -> pa.Table:
    """The best ``k`` of the vectors of ``right``, a block of tiles, for each query of ``left``.

    Tiles are taken nearest centre first; one that, by the triangle inequality of angles, holds
    nothing better than what a query has is skipped for it. ``rows``, where a tile has
    them, are the places of its vectors that take part.
    """
    dim = left["dim"][0].as_py()
    tiles, names = [], []
    for unit, ids, rows in zip(right["unit"].to_pylist(), right["ids"], right["rows"].to_pylist() if "rows" in right.column_names else [None] * right.num_rows, strict=True):
        ids = ids.values.to_numpy(zero_copy_only=False)
        m = _matrix(unit, dim, len(ids))
        if rows is not None:
            m, ids = m[rows], ids[np.asarray(rows, int)]
        tiles.append(m)
        names.append(ids)
    sorted_names, ranks = np.unique(np.concatenate(names), return_inverse=True)
    ranks = np.split(ranks, np.cumsum([len(x) for x in names])[:-1])
    centres = np.array([m.mean(axis=0) for m in tiles])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    radii = np.array([np.arccos(np.clip((m @ c).min(), -1, 1)) for m, c in zip(tiles, centres, strict=True)])
    out = []
    for unit, ids in zip(left["unit"].to_pylist(), left["ids"], strict=True):
        q = _matrix(unit, dim, len(ids))
        bound = np.cos(np.maximum(np.arccos(np.clip(q @ centres.T, -1, 1)) - radii, 0)) + SLACK
        best = Best(len(q), k, digits)
        for t in np.argsort(-bound.max(axis=0)):
            live = np.flatnonzero(bound[:, t] >= best.worst())
            if len(live):
                best.add(live, q[live] @ tiles[t].T, ranks[t])
        r, c = np.nonzero(best.id >= 0)
        out.append((ids.values.take(pa.array(r)), sorted_names[best.id[r, c]], best.exact[r, c]))
    kind = right.schema.field("ids").type.value_type
    columns = [pa.concat_arrays([x for x, _, _ in out]), pa.array(np.concatenate([x for _, x, _ in out]), kind), pa.array(np.concatenate([x for _, _, x in out]))]
    return pa.table(columns, ["query_id", "vec_id", "cosine"])


def blocks(queries: DataFrame, vectors: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """(query_id, vec_id, cosine): of two tables of tiles, the best ``k`` that each query finds in each
    block of vectors of its key and length."""
    key, kind = ["key", "dim"], [df.schema["ids"].dataType.elementType.simpleString() for df in (queries, vectors)]
    pairs = queries.select(*key, F.col("block").alias("qb")).distinct().join(vectors.select(*key, F.col("block").alias("vb")).distinct(), key).select("qb", "vb")
    left = queries.withColumnRenamed("block", "qb").join(pairs, "qb").select("qb", "vb", "dim", "ids", "unit")
    right = vectors.withColumnRenamed("block", "vb").join(pairs, "vb").select("qb", "vb", "ids", "unit", *[c for c in vectors.columns if c == "rows"])
    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(lambda a, b: met(a, b, k, digits), f"query_id {kind[0]}, vec_id {kind[1]}, cosine double")


def first(found: DataFrame, k: int, digits: int = DIGITS) -> DataFrame:
    """The first ``k`` of each query by cosine, ties by id, with ``rank``; Spark cuts each task's rows to
    ``k`` a query before they are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.round("cosine", digits).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Tiles:
    """Vectors (vec_id, embedding) packed once, to be searched by many tables of queries.

    With ``on``, a column of vectors and queries, only vectors that equal a query in it are
    its neighbours. Vectors and queries that are null, empty, zero or hold nulls or numbers
    that are not finite take no part, nor do those without an id or a value of ``on``; only
    vectors of a query's length are its neighbours.
    """

    def __init__(self, vectors: DataFrame, on: str | None = None, tile: int = TILE, block: int = BLOCK):
        self.on, self.tile, self.block = on, tile, block
        centres = {n: spherical_means(m, min(CENTRES, max(1, len(m) // 16))) for n, m in sampled(vectors, SAMPLE).items()}
        sent = vectors.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors a length

        def place(m):
            c = sent.value.get(m.shape[1])
            return np.zeros(len(m)) if c is None else (m @ c.T).argmax(axis=1)

        self.place = place
        self.tiles = self._packed(vectors, "vec_id", "vector_tiles")

    def _packed(self, rows: DataFrame, ident: str, name: str, most: int | None = None) -> DataFrame:
        return tiled(located(rows, ident, self.place, F.col(self.on) if self.on else None), name, rows.count(), self.tile, self.block, most)

    def eligible(self, allowed: DataFrame) -> DataFrame:
        """The tiles that hold any vector of ``allowed`` (vec_id), each with the places of those it holds."""
        places = self.tiles.select("tile", F.posexplode("ids").alias("row", "vec_id"))
        rows = places.join(allowed.select("vec_id").distinct(), "vec_id", "left_semi")
        return self.tiles.join(rows.groupBy("tile").agg(F.sort_array(F.collect_list("row")).alias("rows")), "tile")

    def nearest(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, vec_id, cosine, rank): the ``k`` nearest vectors of each query (query_id, embedding),
        of those in ``allowed`` (vec_id) if it is given. Ids of queries are unique."""
        tiles = self.tiles if allowed is None else self.eligible(allowed)
        return first(blocks(self._packed(queries, "query_id", "query_tiles", self.tile * self.block), tiles, k), k)
