"""Inverted-file search: coarse k-means cells, a join on the nearest cells, optional product codes scored by lookup tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.functions import keyed, tiles
from nearloom.functions import vectors as V
from nearloom.functions.arrow import list_matrix, matrix_list
from nearloom.operators.encode import ROW_CHUNK
from nearloom.operators.lsh import keyed_topk

MAX_CELLS = 1 << 16
# Centroids or codebooks that travel to every task; more is refused.
MAX_MODEL_BYTES = 512 << 20
# Elements are summed as whole multiples of this, so that means do not depend on the order of rows. Sums pass 64 bits,
# which is an error, where rows x element exceed 5e11.
STEP = 2.0**-24
# Scores of vectors against cells held at a time.
SCORES = 1 << 22


@dataclass(frozen=True)
class IvfModel:
    """Coarse ``centroids[nlist, dim]`` and product ``codebooks[m, 2**bits, dim / m]`` of residuals."""

    centroids: np.ndarray
    codebooks: np.ndarray | None = None

    def __post_init__(self):
        for part in (self.centroids, self.codebooks):
            if part is not None and part.nbytes > MAX_MODEL_BYTES:
                raise ValueError(f"centroids and codebooks are limited to {MAX_MODEL_BYTES} bytes each")


def _shared(df: DataFrame, values) -> Broadcast:
    return df.sparkSession.sparkContext.broadcast(values)


def given_centroids(cells: DataFrame, max_cells: int = MAX_CELLS) -> np.ndarray:
    """Centroids of a table ``cell, centroid`` with cells 0..n-1; refused beyond ``max_cells`` rows."""
    rows = cells.select("cell", "centroid").take(max_cells + 1)
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} cells")
    rows = sorted(rows)
    if [r.cell for r in rows] != list(range(len(rows))):
        raise ValueError("cells must be numbered from 0")
    return np.array([r.centroid for r in rows])


def _seeds(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The ``vec`` of the ``n`` rows of the smallest keyed hash of ``id``."""
    first = rows.select("vec", keyed.hash60(seed, F.col("id")).alias("h"), "id").orderBy("h", "id").limit(n).select("vec").toArrow()
    return list_matrix(first.column("vec"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres**2).sum(axis=1) - x @ centres.T).argmin(axis=1)


def _lloyd(rows: DataFrame, books: np.ndarray, iterations: int) -> np.ndarray:
    """``books[m, centres, width]`` after rounds of k-means of the ``m`` slices of ``vec``, all in one pass a round.

    A task adds its rows up by centre; Spark adds up the tasks' sums, which are whole numbers, so any
    partitioning gives the same means. A centre without rows stays. Only centres come to the driver.
    """
    rows = rows.select("vec")
    m, centres, width = books.shape
    chunk = max(1, min(ROW_CHUNK, SCORES // centres))
    for _ in range(iterations):
        held = _shared(rows, books)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            books = held.value
            sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for s in range(0, batch.num_rows, chunk):
                    x = list_matrix(batch.column("vec").slice(s, chunk))
                    steps = np.floor(x / STEP + 0.5).astype(np.int64)
                    for j in range(m):
                        part = slice(j * width, (j + 1) * width)
                        own = _nearest(x[:, part], books[j])
                        order = np.argsort(own, kind="stable")
                        found, starts = np.unique(own[order], return_index=True)
                        sums[j, found] += np.add.reduceat(steps[order, part], starts, axis=0)
                        counts[j] += np.bincount(own, minlength=centres)
            book, centre = np.nonzero(counts)
            for s in range(0, len(book), ROW_CHUNK):
                at = book[s : s + ROW_CHUNK], centre[s : s + ROW_CHUNK]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at[0]), pa.array(at[1]), pa.array(counts[at]), matrix_list(sums[at], pa.int64())], names=["book", "centre", "n", "sums"]
                )

        tasks = rows.mapInArrow(run, "book bigint, centre bigint, n bigint, sums array<bigint>")
        added = tasks.select("book", "centre", "n", F.posexplode("sums").alias("i", "x")).groupBy("book", "centre", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        lists = F.sort_array(F.collect_list(F.struct("i", "x")))
        got = added.groupBy("book", "centre").agg(F.first("n").alias("n"), F.transform(lists, lambda e: e["x"]).alias("x")).toArrow()
        books = books.copy()
        if got.num_rows:
            at = got.column("book").to_numpy(), got.column("centre").to_numpy()
            books[at] = list_matrix(got.column("x")) * STEP / got.column("n").to_numpy()[:, None]
        held.unpersist()
    return books


def train(
    base: DataFrame, nlist: int, subspaces: int = 0, bits: int = 8, seed: int = 42, iterations: int = 10, vec_id: str = "vec_id", vec_col: str = "embedding"
) -> IvfModel:
    """k-means for the cells and, with ``subspaces``, for every slice of the residuals.

    Rounds start from the vectors of the smallest keyed hashes of their ids, so a table gives one model, however it is
    partitioned. A table with fewer vectors than centres repeats its last vector. Null vectors take no part.
    """
    if not 1 <= nlist <= MAX_CELLS:
        raise ValueError(f"nlist must be in [1, {MAX_CELLS}]")
    rows = base.filter(F.col(vec_col).isNotNull()).select(F.col(vec_id).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    first = _seeds(rows, nlist, seed)
    if not len(first):
        raise ValueError("no vectors to train on")
    dim = first.shape[1]
    if subspaces and dim % subspaces:
        raise ValueError("dim must be a multiple of subspaces")
    model = IvfModel(_lloyd(rows, first[None], iterations)[0])
    if not subspaces:
        return model
    residuals = assign(rows, model, 1).select("id", F.col("residual").alias("vec"))
    first = _seeds(residuals, 1 << bits, seed + 1)
    first = np.pad(first, ((0, (1 << bits) - len(first)), (0, 0)), mode="edge")
    books = first.reshape(len(first), subspaces, -1).transpose(1, 0, 2)
    return IvfModel(model.centroids, _lloyd(residuals, np.ascontiguousarray(books), iterations))


def assign(rows: DataFrame, model: IvfModel, nprobe: int) -> DataFrame:
    """``id, vec, cell, residual``: each vector with its ``nprobe`` nearest cells."""
    held = _shared(rows, model.centroids)
    nprobe = min(nprobe, len(model.centroids))
    chunk = max(1, min(ROW_CHUNK, SCORES // len(model.centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        half = 0.5 * (centroids**2).sum(axis=1)
        for batch in batches:
            for s in range(0, batch.num_rows, chunk):
                part = batch.slice(s, chunk)
                x = list_matrix(part.column("vec"))
                scores = half - x @ centroids.T
                near = np.sort(np.argpartition(scores, nprobe - 1, axis=1)[:, :nprobe], axis=1)
                order = np.argsort(np.take_along_axis(scores, near, axis=1), axis=1, kind="stable")
                cells = np.take_along_axis(near, order, axis=1)
                rows_of = np.repeat(np.arange(len(x)), nprobe)
                flat = cells.reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows_of)),
                        part.column("vec").take(pa.array(rows_of)),
                        pa.array(flat.astype(np.int32)),
                        matrix_list((x[rows_of] - centroids[flat]).astype(np.float32), pa.float32()),
                    ],
                    names=["id", "vec", "cell", "residual"],
                )

    kept = rows.filter("vec is not null").select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<float>").alias("vec"))
    return kept.mapInArrow(run, "id bigint, vec array<float>, cell int, residual array<float>")


def quantize(assigned: DataFrame, model: IvfModel) -> DataFrame:
    """``id, cell, vec`` with the vector replaced by the one its product code stands for, and ``code``."""
    held = _shared(assigned, (model.codebooks, model.centroids))
    m, _, width = model.codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, centroids = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROW_CHUNK):
                part = batch.slice(s, ROW_CHUNK)
                residual = list_matrix(part.column("residual"))
                cell = part.column("cell").to_numpy()
                code = np.empty((len(residual), m), dtype=np.int32)
                decoded = centroids[cell].copy()
                for j in range(m):
                    piece = residual[:, j * width : (j + 1) * width]
                    code[:, j] = _nearest(piece, books[j])
                    decoded[:, j * width : (j + 1) * width] += books[j][code[:, j]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("cell"), matrix_list(decoded.astype(np.float32), pa.float32()), matrix_list(code, pa.int32())],
                    names=["id", "cell", "vec", "code"],
                )

    return assigned.mapInArrow(run, "id bigint, cell int, vec array<float>, code array<int>")


def product_codes(assigned: DataFrame, model: IvfModel) -> DataFrame:
    """``id, cell, code``: of every slice of the residual the nearest codeword, a byte each where codebooks have at most 256."""
    held = _shared(assigned, model.codebooks)
    m, words, width = model.codebooks.shape
    kind = TableScore.kind(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROW_CHUNK):
                part = batch.slice(s, ROW_CHUNK)
                residual = list_matrix(part.column("residual"))
                code = np.stack([_nearest(residual[:, j * width : (j + 1) * width], books[j]) for j in range(m)], axis=1)
                values = matrix_list(code.astype(np.int8), pa.int8()) if kind == "tinyint" else matrix_list(code, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("cell"), values], names=["id", "cell", "code"])

    return assigned.select("id", "cell", "residual").mapInArrow(run, f"id bigint, cell int, code array<{kind}>")


# Codeword combinations of the slices that are looked up at once.
JOINT_WORDS = 256


@dataclass(frozen=True)
class TableScore:
    """Distances of query vectors to product codes of a cell.

    A chunk of queries is screened by lookup tables, one entry for each slice and codeword; pairs that may enter
    the top k are decided in double precision. ``shared`` holds the codebooks and centroids.
    """

    metric: str
    shared: Broadcast
    words: int
    integral = False

    @staticmethod
    def kind(words: int) -> str:
        return "tinyint" if words <= 256 else "int"

    @property
    def code_type(self) -> str:
        return self.kind(self.words)

    def query(self, batch: pa.RecordBatch) -> dict:
        x = list_matrix(batch.column("vec"))
        if not len(x):
            return {"x": x, "offset": np.zeros(0), "norm": np.zeros(0)}
        own = self.shared.value[1][batch.column("cell").to_numpy(zero_copy_only=False)]
        offset = np.zeros(len(x)) if self.metric == "l2sq" else np.einsum("ij,ij->i", x, own)
        x = x - own if self.metric == "l2sq" else x
        return {"x": x, "offset": offset, "norm": np.sqrt(np.einsum("ij,ij->i", x, x))}

    def base(self, batch: pa.RecordBatch) -> dict:
        codes = list_matrix(batch.column("code"), np.int32)
        return {"x": codes & 0xFF if self.code_type == "tinyint" else codes}

    def screen(self, q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        books = self.shared.value[0]
        width = books.shape[2]
        squares = (books**2).sum(axis=2)
        reach = np.sqrt(squares.max(axis=1).sum())
        # A row of a table holds what all queries of the chunk add for a codeword, so that looking up copies whole rows.
        d = np.zeros((len(b["x"]), len(q["x"])), np.float32)
        joint, place = None, None
        for j, book in enumerate(books):
            part = q["x"][:, j * width : (j + 1) * width]
            table = book @ part.T
            table = squares[j][:, None] + (part**2).sum(axis=1) - 2.0 * table if self.metric == "l2sq" else -table
            # Slices share a table as long as that stays small.
            if joint is not None and len(joint) * len(table) <= JOINT_WORDS:
                joint = (joint[:, None, :] + table[None, :, :]).reshape(-1, table.shape[1])
                place = place * len(table) + b["x"][:, j]
            else:
                if joint is not None:
                    d += joint.astype(np.float32)[place]
                joint, place = table, b["x"][:, j]
        d += joint.astype(np.float32)[place]
        d = d.T
        magnitude = (q["norm"] + reach) ** 2 if self.metric == "l2sq" else q["norm"] * reach + np.abs(q["offset"]) + 1.0
        d += ((self.metric == "cosine") - q["offset"]).astype(np.float32)[:, None]
        return d, magnitude * (4.0 * (q["x"].shape[1] + 8) * 2.0**-24)

    def decide(self, q: dict, b: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        books = self.shared.value[0]
        slices = np.arange(len(books))
        out = np.empty(len(rows))
        for s in range(0, len(rows), tiles.REFINE_CHUNK):
            r, c = rows[s : s + tiles.REFINE_CHUNK], cols[s : s + tiles.REFINE_CHUNK]
            x, y = q["x"][r], books[slices, b["x"][c]].reshape(len(r), -1)
            out[s : s + tiles.REFINE_CHUNK] = (
                np.einsum("ij,ij->i", x - y, x - y) if self.metric == "l2sq" else (self.metric == "cosine") - (q["offset"][r] + np.einsum("ij,ij->i", x, y))
            )
        return out

    def report(self, dist: np.ndarray) -> np.ndarray:
        return dist


def ivf_knn(
    queries: DataFrame,
    base: DataFrame,
    model: IvfModel,
    k: int,
    nprobe: int = 8,
    metric: str = "neg_dot",
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    vec_col: str = "embedding",
    lookup: bool = True,
) -> DataFrame:
    """Top k over the rows of the query's ``nprobe`` nearest cells.

    With product codebooks a base row is shuffled as its code and scored by the query's lookup tables, or
    without ``lookup`` as the single-precision vector its code stands for. Large cells are split like any other join key.
    """
    if metric not in V.VECTOR_METRICS:
        raise ValueError(f"unknown metric {metric}")
    dim = model.centroids.shape[1]
    q = assign(queries.select(F.col(query_id).alias("id"), F.col(vec_col).alias("vec")), model, nprobe)
    b = assign(base.select(F.col(vec_id).alias("id"), F.col(vec_col).alias("vec")), model, 1)
    most_rows = (queries.count(), base.count())
    if model.codebooks is not None and lookup:
        words = model.codebooks.shape[1]
        score = TableScore(metric, _shared(base, (model.codebooks, model.centroids)), words)
        return keyed_topk(q.select("cell", "id", "vec"), product_codes(b, model), ["cell"], score, k, dim=dim, most_rows=most_rows)
    if model.codebooks is not None:
        b = quantize(b, model)
    score = tiles.VectorScore(metric=metric)
    return keyed_topk(q.select("cell", "id", "vec"), b.select("cell", "id", "vec"), ["cell"], score, k, dim=dim,
                      most_rows=most_rows)
