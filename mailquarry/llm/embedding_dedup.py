"""Near-duplicate embeddings by int8 tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.llm.components import connected_components
from mailquarry.llm.storage import bounded_batches, settled, stored

#: Reference directions (drawn from the data by a hash) that deal vectors into blocks and rule out block pairs.
PIVOTS = 64
#: Vectors of a block, at least; larger inputs get larger blocks so that there are about BLOCKS of them.
BLOCK_ROWS, BLOCKS = 2048, 1024
#: Angles are dealt by so many steps within the cell of a pivot.
STEPS = 128
#: Rows of a block that are multiplied at once.
TILE = 1024
#: Vector bytes on one side of a cell of the grid of blocks.
GRID_BYTES = 8 << 20


def unit(matrix: np.ndarray) -> np.ndarray:
    x = matrix.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True, initial=5e-324)  # lengths neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes in -127..127, step of each vector, length of each vector's quantisation error)."""
    step = np.abs(x).max(1, keepdims=True) / 127
    code = np.rint(x / step)
    error = np.linalg.norm(x - code * step, axis=1) + 1e-9
    return code.astype(np.int8), step[:, 0], error


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of ``least`` or more.

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| bounds what the int8 product
    can be off by. Pairs that the bound puts surely above or below are settled;
    the others are computed in double precision.
    """
    x, y = unit(a), unit(b)
    qx, sx, ex = quantised(x)
    qy, sy, ey = quantised(y)
    whole = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    near = (qx.astype(whole) @ qy.T.astype(whole)) * (sx[:, None] * sy[None]).astype(np.float64)
    bound = ex[:, None] + (1 + ex[:, None]) * ey[None] + 1e-9
    out = near - bound >= least
    i, j = np.nonzero((near + bound >= least) & ~out)
    for k in range(0, len(i), 200_000):
        p, q = a[i[k : k + 200_000]].astype(np.float64), b[j[k : k + 200_000]].astype(np.float64)
        p, q = p / np.abs(p).max(1, keepdims=True), q / np.abs(q).max(1, keepdims=True)
        cosine = (p * q).sum(1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
        out[i[k : k + 200_000], j[k : k + 200_000]] = cosine >= least
    return out


def _roots(link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of rows (from 0) and columns (from the number of rows) of a bipartite link matrix."""
    n, m = link.shape
    rows, columns = np.arange(n), np.arange(n, n + m)
    big = n + m
    while True:
        up = np.minimum(columns, np.where(link, rows[:, None], big).min(0)) if n else columns
        down = np.minimum(rows, np.where(link, up[None], big).min(1)) if m else rows
        if (up == columns).all() and (down == rows).all():
            return rows, columns
        rows, columns = down, up


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _dealt(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, kind: str) -> Iterator[pa.RecordBatch]:
    """rep, copies, vector -> the same with the nearest pivot and the step of the angle to it."""
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(2).to_pylist()), kind).reshape(batch.num_rows, -1)
        if len(x):
            angle = _angles(unit(x), pivots)
            cell = angle.argmin(1)
            step = np.minimum((angle[np.arange(len(x)), cell] / np.pi * STEPS * 2).astype(np.int64), STEPS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(step.astype(np.int32))], names=["rep", "copies", "vector", "cell", "step"])


def _block(pivots: np.ndarray, kind: str):
    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("rep")
        data = b"".join(table.column("vector").to_pylist())
        angle = _angles(unit(np.frombuffer(data, kind).reshape(table.num_rows, -1)), pivots).astype("<f4")
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "n": pa.array([table.num_rows], pa.int64()),
                "ids": pa.array([table.column("rep").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "copies": pa.array([table.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "vectors": pa.array([data], pa.binary()),
                "low": pa.array([angle.min(0).tobytes()], pa.binary()),
                "high": pa.array([angle.max(0).tobytes()], pa.binary()),
            }
        )

    return make


def _pair(a: dict, b: dict, same: bool, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rep, links to other vectors, root of its component in the tile) for the tiles of two blocks."""
    ia, ca, va = a["ids"], a["copies"], a["vectors"]
    ib, cb, vb = b["ids"], b["copies"], b["vectors"]
    for i in range(0, len(ia), TILE):
        for j in range(i if same else 0, len(ib), TILE):
            link = linked(va[i : i + TILE], vb[j : j + TILE], least)
            own = same and i == j
            if own:
                np.fill_diagonal(link, False)
            if not link.any():
                continue
            rows, columns = _roots(link)
            p, q = ia[i : i + TILE], ib[j : j + TILE]
            both = np.r_[p, q]
            ra, rb = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
            yield p[ra], link[ra] @ cb[j : j + TILE], both[rows[ra]]
            # a block with itself: both sides of the symmetric matrix count once, but its roots are of both sides
            yield q[rb], np.zeros(len(rb), np.int64) if own else ca[i : i + TILE] @ link[:, rb], both[columns[rb]]


def _grid(least: float, kind: str):
    def compare(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        """The blocks of one cell of the grid and the pairs to compare in it."""
        held = {}
        for row in blocks.to_pylist():
            ids = np.frombuffer(row["ids"], "<i8")
            held[row["block"]] = {"ids": ids, "copies": np.frombuffer(row["copies"], "<i8"), "vectors": np.frombuffer(row["vectors"], kind).reshape(len(ids), -1)}
        found = [x for i, j in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True) for x in _pair(held[i], held[j], i == j, least)]
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("rep", "links", "root"), map(pa.array, columns), strict=True)))

    return compare


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by a cosine of ``least`` (above 0) or more.

    ``vectors`` has vec_id and embedding (array of numbers: 32-bit floats as
    they are, anything else as doubles); other columns are not looked at. A row
    that is repeated counts as another vector, linked with the first; rows of
    one vec_id with different vectors share their links. A vector that is null,
    empty, zero, or holds null or non-finite numbers links with nothing, and
    vectors of different lengths never link. Equal vectors become one class
    before any comparison. Rows with a null vec_id are left out. Every pair of
    blocks is multiplied but those that the triangle inequality of angles,
    taken at any pivot, rules out, so no link is lost.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    e = F.col("embedding")
    good = F.coalesce((F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    number = vectors.schema["embedding"].dataType.elementType
    kind = "float" if isinstance(number, T.FloatType) else "double"
    base = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast(f"array<{kind}>").alias("embedding"))
    base = stored(base.withColumn("good", good), "vectors")
    classes = stored(base.where("good").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vector_classes")
    counted, edges = [], []
    for r in classes.select(F.size("embedding").alias("d")).groupBy("d").count().collect():
        tiles = _of_one_length(classes.where(F.size("embedding") == r["d"]), r["d"], r["count"], least, "<f4" if kind == "float" else "<f8")
        counted.append(tiles.groupBy("rep").agg(F.sum("links").alias("links")))
        edges.append(tiles.select(F.col("rep").alias("u"), F.col("root").alias("v")).where("u <> v"))
    if not counted:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links, joined = counted[0], edges[0]
    for x, y in zip(counted[1:], edges[1:], strict=True):
        links, joined = links.unionByName(x), joined.unionByName(y)
    components = connected_components(joined)
    known = classes.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("embedding", F.lit(True).alias("good"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = base.join(known, ["embedding", "good"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _of_one_length(classes: DataFrame, dims: int, count: int, least: float, kind: str) -> DataFrame:
    """(rep, links, root) rows of all block pairs of the classes, whose vectors have ``dims`` numbers."""
    spark = classes.sparkSession
    share = min(1.0, 4 * PIVOTS / count)
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < share * (1 << 30)).orderBy(F.xxhash64("rep")).limit(PIVOTS).select("embedding").collect()
    if not drawn:
        drawn = classes.limit(1).select("embedding").collect()
    pivots = unit(np.array([r.embedding for r in drawn], np.float64))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.ascontiguousarray(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(kind)).reshape(batch.num_rows, dims) if batch.num_rows else np.zeros((0, dims), kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in flat], pa.binary())], names=["rep", "copies", "vector"])

    rows = classes.select("rep", "copies", "embedding").mapInArrow(lambda it: _dealt(packed(it), pivots, kind), "rep long, copies long, vector binary, cell int, step int")
    rows = stored(rows, "dealt")
    size = max(BLOCK_ROWS, -(-count // BLOCKS))
    # (cell, step) -> first block and number of blocks; at most PIVOTS * STEPS rows, whatever the input
    plan, block = [], -1
    filled, last = 0, None
    for r in sorted(rows.groupBy("cell", "step").count().collect(), key=lambda r: (r["cell"], r["step"])):
        if r["cell"] != last or filled >= size or filled + r["count"] > 2 * size:
            block, filled = block + 1, 0
        parts = max(1, round(r["count"] / size))
        plan.append((r["cell"], r["step"], block, parts))
        if parts > 1:
            block, filled = block + parts - 1, size
        filled, last = filled + r["count"], r["cell"]
    dealt = rows.join(F.broadcast(spark.createDataFrame(plan, "cell int, step int, first int, parts int")), ["cell", "step"])
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("parts")).cast("int")).alias("block"), "rep", "copies", "vector")
    blocks = stored(dealt.groupBy("block").applyInArrow(_block(pivots, kind), "block int, n long, ids binary, copies binary, vectors binary, low binary, high binary"), "blocks")

    bounds = sorted(blocks.select("block", "low", "high").collect(), key=lambda r: r.block)  # about BLOCKS + PIVOTS rows
    low = np.stack([np.frombuffer(r.low, "<f4") for r in bounds]).astype(np.float64)
    high = np.stack([np.frombuffer(r.high, "<f4") for r in bounds]).astype(np.float64)
    reach = float(np.arccos(least)) + 1e-4  # more than the rounding of the stored angles
    pairs = []
    for i, r in enumerate(bounds):
        apart = np.maximum(low[i:] - high[i], low[i] - high[i:]).max(1)
        pairs += [(r.block, bounds[i + int(j)].block) for j in np.flatnonzero(apart <= reach)]
    # a grid over runs of blocks: a block goes to its row and column of cells, once each, not to every pair
    place = {r.block: k for k, r in enumerate(bounds)}
    run = max(1, min(len(bounds) // 16, GRID_BYTES // max(1, 2 * size * dims * np.dtype(kind).itemsize)))
    cells: dict[tuple[int, int], int] = {}
    asked, wanted = [], set()
    for x, y in pairs:
        cell = cells.setdefault((place[x] // run, place[y] // run), len(cells))
        asked.append((cell, x, y))
        wanted |= {(cell, x), (cell, y)}
    dealt_to = F.broadcast(spark.createDataFrame(sorted(wanted), "cell int, block int"))
    data = blocks.join(dealt_to, "block").select("cell", "block", "ids", "copies", "vectors")
    return stored(data.groupBy("cell").cogroup(spark.createDataFrame(asked, "cell int, a int, b int").groupBy("cell")).applyInArrow(_grid(least, kind), "rep long, links long, root long"), "tiles")


def op6_int8(spark, sf_dir: str) -> DataFrame:
    """All rows of embeddings, cosine 0.9."""
    return settled(spark, lambda: near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "op6")
