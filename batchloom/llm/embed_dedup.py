"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Every distinct vector lives in the cell of its nearest centre and also visits each cell that a partner may live
in. Two unit vectors with cosine >= t are at most s = sqrt(2 - 2 t) apart, so for the centres a and b of their
cells the two margins x.(a - b) and y.(b - a) add up to at most s |a - b|: one of the two vectors has a margin of
at most half of that and visits the other's cell. With slack = 1 no pair is missed; a smaller slack looks at fewer
cells and may miss some. Cells are cut into blocks; a task holds one block and streams the rest past it, and what
leaves it are counts and a spanning forest, never the pairs. There are about as many cells as the root of the number of
vectors: in many dimensions a vector visits a large share of all cells, however small they are, and smaller ones
would only send it more often.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize
from .simhash import _runs

THRESHOLD = 0.95
#: Vectors that the centres are fitted on, at most; every vector is then assigned.
FIT_SAMPLE = 20_000
#: Distinct vectors aimed at in a cell, at least, and held at most by a task.
CELL, BLOCK = 512, 16384
#: Cells for n vectors: the root of n, divided by this, and MAX_CELLS at most.
ROOT = 16
MAX_CELLS = 2048
ROUNDS = 8
#: Vectors that are compared, or looked up in cells, at a time; copies of them that leave a task at a time.
STEP, SENT = 1024, 4096


def fit_centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means of unit vectors; the first centres are spread over the sample, an empty cell keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, cell, x)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
    return c


def visits(x: np.ndarray, centres: np.ndarray, threshold: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home cell, and a row of which cells it visits (home included)."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (centres @ centres.T)))
    margin = near[np.arange(len(x)), home][:, None] - near
    return home, margin <= slack * 0.5 * np.sqrt(2.0 - 2.0 * threshold) * gap[home] + 1e-9


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def links(reps: DataFrame, dim: int, threshold: float = THRESHOLD, slack: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Distinct (rep, n, own, v array<double>), v filled up with zeros to one length -> (rep, linked), (src, dst).

    own is a vector's length before; only vectors of equal own are compared. linked is how many vectors of other reps are within the threshold, each rep counting n times.
    """
    total = reps.count()
    k = int(min(MAX_CELLS, max(1, min(total // CELL, np.sqrt(total) // ROOT))))
    sample = reps.orderBy(F.xxhash64("rep")).limit(min(FIT_SAMPLE, max(1, 40 * k))).select("v").collect()
    x = np.array([r.v for r in sample], np.float64).reshape(-1, dim)
    centres = fit_centres(x / np.linalg.norm(x, axis=1)[:, None], min(k, len(x))) if len(x) else np.zeros((1, dim))
    sent = reps.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            home, _ = visits(_unit(b.column("v"), dim), sent.value, threshold, slack)
            yield pa.record_batch([b.column("rep"), b.column("n"), b.column("own"), b.column("v"), pa.array(home)], names=["rep", "n", "own", "v", "home"])

    homes = materialize(reps.select("rep", "n", "own", "v").mapInArrow(assign, "rep long, n long, own int, v array<double>, home long"), "cells")
    blocks = {r.home: -(-r.n // BLOCK) for r in homes.groupBy("home").agg(F.count("*").alias("n")).collect()}  # MAX_CELLS rows at most

    per_cell = np.array([blocks.get(c, 0) for c in range(k)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _steps(batches):
            home, seen = visits(_unit(b.column("v"), dim), sent.value, threshold, slack)
            rep = b.column("rep").to_numpy()
            own = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            row, cell = np.nonzero(seen)
            mine = np.where(cell == home[row], own[row] % np.maximum(1, per_cell[cell]), -1)
            # At home: into its own block, and past the blocks before it. Elsewhere: past all blocks.
            times = np.where(mine >= 0, mine + 1, per_cell[cell])
            at, cell, mine = (np.repeat(x, times) for x in (row, cell, mine))
            block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            mask = np.packbits(seen, axis=1, bitorder="little")
            for i in range(0, len(at), SENT):
                part = slice(i, i + SENT)
                take = pa.array(at[part])
                yield pa.record_batch(
                    [pa.array(cell[part] * (1 << 32) + block[part]), pa.array(np.where(block[part] == mine[part], 0, 1).astype(np.int32)), pa.array(home[at[part]]), b.column("rep").take(take), b.column("n").take(take), b.column("own").take(take), pa.array([mask[j].tobytes() for j in at[part]], pa.binary()), b.column("v").take(take)],
                    names=["task", "role", "home", "rep", "n", "own", "seen", "v"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, full = None, [], None
        for b in batches:
            task, role = b.column("task").to_numpy(), b.column("role").to_numpy()
            cuts = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (role[1:] != role[:-1])) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if task[i] != now:
                    if held and full is None:
                        yield from against(_stack(held), None)
                    now, held, full = task[i], [], None
                part = {n: b.column(n).slice(i, j - i) for n in ("home", "rep", "n", "own", "seen")} | {"v": _unit(b.column("v").slice(i, j - i), dim)}
                part = {n: c if isinstance(c, np.ndarray) else np.array(c.to_pylist()) if n != "seen" else np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(j - i, -1) for n, c in part.items()}
                if role[i] == 0:
                    held.append(part)
                elif held:
                    if full is None:
                        full = _stack(held)
                        yield from against(full, None)
                    for s in range(0, j - i, STEP):
                        yield from against(full, {n: c[s : s + STEP] for n, c in part.items()})
        if held and full is None:
            yield from against(_stack(held), None)

    def against(a: dict[str, np.ndarray], c: dict[str, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        """Links inside block a, or between it and the passing rows c."""
        cell = a["home"][0]
        rep, other = a["rep"], (a if c is None else c)
        ids, past = (rep, 0) if c is None else (np.concatenate([rep, other["rep"]]), len(rep))
        got, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for s in range(0, len(rep), STEP):
            for t in range(s if c is None else 0, len(other["rep"]), STEP):
                hit = (a["v"][s : s + STEP] @ other["v"][t : t + STEP].T >= threshold) & (a["own"][s : s + STEP, None] == other["own"][t : t + STEP])
                i, j = np.nonzero(hit)
                i, j = i + s, j + t
                if c is None:
                    keep = i < j
                else:
                    # A guest's cell sees this pair too if the partner here visits it: the lower cell counts it.
                    h = other["home"][j]
                    both = (a["seen"][i, h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
                    keep = (h == cell) | ~both | (cell < h)
                i, j = i[keep], j[keep]
                if len(i):  # pairs of two steps at most are held, whatever a group's size
                    np.add.at(got, i, other["n"][j])
                    np.add.at(got, j + past, a["n"][i])
                    label = forest(len(ids), np.concatenate([np.arange(len(ids)), i]), np.concatenate([label, j + past]))
        if not got.any():
            return
        some = got > 0
        yield pa.record_batch([pa.array(ids[some]), pa.array(got[some]), pa.array(ids[label[some]])], names=["rep", "linked", "root"])

    dealt = homes.select("rep", "n", "own", "v").mapInArrow(deal, "task long, role int, home long, rep long, n long, own int, seen binary, v array<double>")
    found = dealt.repartition("task").sortWithinPartitions("task", "role").mapInArrow(compare, "rep long, linked long, root long")
    found = materialize(found, "cell-links", compact=4)
    return found.groupBy("rep").agg(F.sum("linked").alias("linked")), found.where("rep <> root").select(F.col("rep").alias("src"), F.col("root").alias("dst"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, STEP):
            yield b.slice(i, STEP)


def _stack(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, slack: float = 1.0) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors are compared once and counted as often as they occur. Null and empty vectors, zero vectors and
    those with a null or non-finite component link with nothing, and vectors of different lengths never link.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.expr("coalesce(size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0), false)")
    rows = rows.withColumn("v", F.when(fine & F.col("vec_id").isNotNull(), F.expr("transform(v, x -> x + 0.0D)")))
    reps = materialize(rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    # Lengths from one power of two to the next go together, filled up with zeros, so the rounds are 31 at most.
    band = F.ceil(F.log2(F.size("v"))).cast("int").alias("band")
    widest = [(r.band, r.d) for r in reps.groupBy(band).agg(F.max(F.size("v")).alias("d")).collect()]
    counts = rows.sparkSession.createDataFrame([], "rep long, linked long")
    edges = rows.sparkSession.createDataFrame([], "src long, dst long")
    for b, d in sorted(widest):
        filled = F.concat("v", F.array_repeat(F.lit(0.0), d - F.size("v"))).alias("v")
        part = reps.where(F.ceil(F.log2(F.size("v"))) == b).select("rep", "n", F.size("v").alias("own"), filled)
        found, forest_ = links(part, d, threshold, slack)
        counts, edges = counts.unionByName(found), edges.unionByName(forest_)
    roots = connected_components(edges, "vector-links")
    known = (
        reps.join(counts.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select(F.col("v").alias("key"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = rows.join(known, F.col("v") == F.col("key"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
