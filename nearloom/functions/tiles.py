"""Top-k over tiles of queries and base rows, run inside one task.

A task reads cells. Every cell holds its query rows first and its base rows after them (the
caller sorts them so), keeps a running top k per query, and streams the base rows through it in
chunks: memory is bounded by the queries of one cell plus one chunk, whatever the base size.

Scores are screened by a single-precision matrix product with a proven error bound and decided
by a double-precision sum of fixed order, so results depend on neither tiling nor partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from nearloom.functions.arrow import list_matrix
from nearloom.functions.rotations import keyed_rotations, pad_rows

NO_ID = np.iinfo(np.int64).max
# A tile of distances stays in the cache while it is compared.
QUERY_CHUNK = 128
BASE_CHUNK = 8192
# Cells of up to this many pairs are scored together, without a matrix product of their own.
SMALL_PAIRS = 1 << 12
# Pairs of small cells scored at once.
PAIR_CHUNK = 1 << 18
# Stands for "no limit yet" among single-precision distances.
FAR = 3e38
# Pairs whose exact score is computed at once: their vectors stay in the cache.
REFINE_CHUNK = 1 << 12

RESULT_SCHEMA = "query_id bigint, vec_id bigint, dist double, rank int"


@dataclass(frozen=True)
class VectorScore:
    """Distances between raw vectors; ``code_seed`` set means the base rows hold component codes.

    Scoring codes by their decoded vector gives the asymmetric distance of the rotated query.
    """

    metric: str = "cosine"
    bits: int = 0
    padded_dim: int = 0
    code_seed: int | None = None
    farthest: bool = False
    integral = False
    code_type = "int"

    def query(self, batch: pa.RecordBatch) -> dict:
        return self._pack(list_matrix(batch.column("vec")))

    def base(self, batch: pa.RecordBatch) -> dict:
        if self.code_seed is None:
            return self._pack(list_matrix(batch.column("vec")))
        codes = list_matrix(batch.column("code"), np.int64)
        return self._pack(keyed_rotations(self.code_seed, self.bits, self.padded_dim).decode(codes))

    def _pack(self, x: np.ndarray) -> dict:
        if self.padded_dim and x.shape[0]:
            x = pad_rows(x, self.padded_dim)
        return {"x": x, "x32": x.astype(np.float32), "norm": np.sqrt(np.einsum("ij,ij->i", x, x))}

    def screen(self, q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        """Approximate distances and, per query, a bound on their error."""
        d = q["x32"] @ b["x32"].T
        np.negative(d, out=d)
        reach = b["norm"].max()
        magnitude = q["norm"] * reach
        if self.metric == "cosine":
            d += 1.0
            magnitude = magnitude + 1.0
        elif self.metric == "l2sq":
            d *= 2.0
            d += (q["norm"] ** 2).astype(np.float32)[:, None]
            d += (b["norm"] ** 2).astype(np.float32)[None, :]
            magnitude = (q["norm"] + reach) ** 2
        if self.farthest:
            d = -d
        return d, magnitude * (4.0 * (q["x"].shape[1] + 8) * 2.0**-24)

    def decide(self, q: dict, b: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Exact distances of the given pairs."""
        out = np.empty(len(rows))
        for s in range(0, len(rows), REFINE_CHUNK):
            x, y = q["x"][rows[s : s + REFINE_CHUNK]], b["x"][cols[s : s + REFINE_CHUNK]]
            if self.metric == "l2sq":
                diff = x - y
                out[s : s + REFINE_CHUNK] = np.einsum("ij,ij->i", diff, diff)
            else:
                out[s : s + REFINE_CHUNK] = -np.einsum("ij,ij->i", x, y)
        if self.metric == "cosine":
            out += 1.0
        return -out if self.farthest else out

    def report(self, dist: np.ndarray) -> np.ndarray:
        return -dist if self.farthest else dist


@dataclass(frozen=True)
class HammingScore:
    """Combined Hamming distance of sign words, from one matrix product of +-1 bits."""

    bits: int
    residual_bits: int = 0
    shift: int = 0
    integral = True
    code_type = "bigint"

    def query(self, batch: pa.RecordBatch) -> dict:
        signs = self._signs(batch)
        weights = np.ones(signs.shape[1], dtype=np.float32)
        if self.residual_bits:
            weights[: self.bits] = float(1 << self.shift)
        return {"x32": signs * weights}

    def base(self, batch: pa.RecordBatch) -> dict:
        return {"x32": self._signs(batch)}

    def _signs(self, batch: pa.RecordBatch) -> np.ndarray:
        words = list_matrix(batch.column("code"), np.int64)
        raw = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
        primary_words = -(-self.bits // 64)
        keep = [raw[:, : self.bits]]
        if self.residual_bits:
            start = 64 * primary_words
            keep.append(raw[:, start : start + self.residual_bits])
        return 1.0 - 2.0 * np.concatenate(keep, axis=1).astype(np.float32)

    def screen(self, q: dict, b: dict) -> tuple[np.ndarray, np.ndarray]:
        total = self.bits * (1 << self.shift) + self.residual_bits if self.residual_bits else self.bits
        d = np.float32(total) - q["x32"] @ b["x32"].T
        d *= 0.5
        return d, np.zeros(d.shape[0])

    def decide(self, q: dict, b: dict, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Distances of the given pairs."""
        total = self.bits * (1 << self.shift) + self.residual_bits if self.residual_bits else self.bits
        agree = np.einsum("ij,ij->i", q["x32"][rows], b["x32"][cols])
        return 0.5 * (total - agree.astype(np.float64))

    def report(self, dist: np.ndarray) -> np.ndarray:
        return dist


def surplus_copies(x: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray | None:
    """Mask of rows to keep: of identical rows only the ``keep`` smallest ids can reach a top k."""
    raw = np.ascontiguousarray(x).view(np.uint64) if x.dtype == np.float64 else x.view(np.uint32).astype(np.uint64)
    mix = np.arange(1, raw.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = ((raw ^ (raw >> np.uint64(29))) * mix).sum(axis=1)
    order = np.lexsort((ids, h))
    sorted_h = h[order]
    same = sorted_h[1:] == sorted_h[:-1]
    if not same.any():
        return None
    starts = np.concatenate(([True], ~same))
    first = np.maximum.accumulate(np.where(starts, np.arange(len(h)), 0))
    equal = (x[order] == x[order[first]]).all(axis=1)
    seen = np.cumsum(equal)
    position = seen - seen[first]
    mask = np.ones(len(h), dtype=bool)
    mask[order[equal & (position >= keep)]] = False
    return mask


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix that is nearly all false, eight places at a time."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    whole = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    found = words[:, None] * 8 + np.arange(8)
    found = np.concatenate((found[flat[found]], whole + np.flatnonzero(flat[whole:])))
    return np.divmod(found, mask.shape[1])


class RunningTopK:
    """The k best base rows per query, ordered by (distance, id).

    Once k rows are held, candidates wait and are merged many at a time. Until then the limit of a query is too high, never
    too low, so that more candidates come but none is lost.
    """

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self._dist = np.full((len(query_ids), k), np.inf)
        self._ids = np.full((len(query_ids), k), NO_ID, dtype=np.int64)
        self._waiting: dict[int, tuple[int, list]] = {}

    @property
    def dist(self) -> np.ndarray:
        self._take_all()
        return self._dist

    @property
    def ids(self) -> np.ndarray:
        self._take_all()
        return self._ids

    def limits(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance and id that a row has to undercut to be among the k best of queries [lo, hi), those that wait not counted."""
        return self._dist[lo:hi, -1], self._ids[lo:hi, -1]

    def add(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, lo: int, hi: int) -> None:
        """Take in candidates; ``rows`` counts from ``lo`` and only queries [lo, hi) are touched."""
        held = self._waiting.setdefault(lo, (hi, []))[1]
        held.append((rows.astype(np.int32), ids, dist))
        if 2 * sum(len(r) for r, *_ in held) >= (hi - lo) * self.k or not np.isfinite(self._dist[lo:hi, -1]).all():
            self._take_in(lo)

    def _take_in(self, lo: int) -> None:
        hi, held = self._waiting.pop(lo)
        self._merge(*(np.concatenate(x) for x in zip(*held)), lo, hi)

    def _take_all(self) -> None:
        for lo in list(self._waiting):
            self._take_in(lo)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, dist: np.ndarray, lo: int, hi: int) -> None:
        held_rows, held_cols = np.nonzero(self._ids[lo:hi] != NO_ID)
        rows = np.concatenate((held_rows, rows))
        all_ids = np.concatenate((self._ids[lo:hi][held_rows, held_cols], ids))
        all_dist = np.concatenate((self._dist[lo:hi][held_rows, held_cols], dist))
        order = np.lexsort((all_ids, all_dist, rows))
        rows, all_ids, all_dist = rows[order], all_ids[order], all_dist[order]
        first = np.searchsorted(rows, rows, side="left")
        place = np.arange(len(rows)) - first
        best = place < self.k
        self._dist[lo + rows[best], place[best]] = all_dist[best]
        self._ids[lo + rows[best], place[best]] = all_ids[best]

    def result(self, report) -> pa.RecordBatch:
        rows, cols = np.nonzero(self.ids != NO_ID)
        return _result(self.query_ids[rows], self.ids[rows, cols], report(self.dist[rows, cols]), cols + 1)


def _take(features: dict, index) -> dict:
    return {name: value[index] for name, value in features.items()}


def score_chunk(top: RunningTopK, q: dict, b: dict, base_ids: np.ndarray, score, exclude_self: bool) -> None:
    """Stream one chunk of base rows through the running top k."""
    k = top.k
    keep = surplus_copies(b["x32"] if score.integral else b["x"], base_ids, k + int(exclude_self))
    if keep is not None:
        b, base_ids = _take(b, keep), base_ids[keep]
    # With ids ascending, the position of a base row orders equal integral scores.
    order = np.argsort(base_ids, kind="stable")
    b, base_ids = _take(b, order), base_ids[order]
    width = len(base_ids)
    for lo in range(0, len(top.query_ids), QUERY_CHUNK):
        hi = min(lo + QUERY_CHUNK, len(top.query_ids))
        part = _take(q, slice(lo, hi))
        d, error = score.screen(part, b)
        if exclude_self:
            pos = np.searchsorted(base_ids, top.query_ids[lo:hi])
            hit = (pos < width) & (base_ids[np.minimum(pos, width - 1)] == top.query_ids[lo:hi])
            d[np.nonzero(hit)[0], pos[hit]] = np.inf
        worst, worst_id = top.limits(lo, hi)
        unfilled = ~np.isfinite(worst).all()
        if score.integral:
            if unfilled and width > k:
                key = d.astype(np.float64) * width + np.arange(width)
                cols = np.argpartition(key, k - 1, axis=1)[:, :k].reshape(-1)
                rows = np.repeat(np.arange(hi - lo), k)
                ok = np.isfinite(d[rows, cols])
                rows, cols = rows[ok], cols[ok]
            else:
                better = d < worst[:, None]
                better |= (d == worst[:, None]) & (base_ids[None, :] < worst_id[:, None])
                better &= np.isfinite(d)
                rows, cols = _where(better)
            dist = d[rows, cols].astype(np.float64)
        else:
            limit = worst + error
            if unfilled and width > k:
                kth = np.partition(d, k - 1, axis=1)[:, k - 1].astype(np.float64)
                limit = np.minimum(limit, kth + 2.0 * error)
            finite = np.minimum(limit, FAR).astype(np.float32)
            rows, cols = _where(d <= np.nextafter(finite, np.float32(np.inf))[:, None])
            ok = np.isfinite(d[rows, cols])
            rows, cols = rows[ok], cols[ok]
            dist = score.decide(part, b, rows, cols)
        if len(rows):
            top.add(rows, base_ids[cols], dist, lo, hi)


def _join(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def _result(query_ids, ids, dist, rank) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids, pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array(dist, pa.float64()),
            pa.array(rank.astype(np.int32), pa.int32()),
        ],
        names=["query_id", "vec_id", "dist", "rank"],
    )


def small_cells_topk(batch: pa.RecordBatch, num_queries: np.ndarray, num_base: np.ndarray, score, k: int, exclude_self: bool):
    """Top k of many small cells at once.

    ``batch`` holds whole cells one after the other, each with its ``num_queries`` query rows
    before its ``num_base`` base rows. Pairs exist only inside this function, a chunk at a time.
    """
    is_query = batch.column("side").to_numpy(zero_copy_only=False) == 0
    q_batch, b_batch = batch.filter(pa.array(is_query)), batch.filter(pa.array(~is_query))
    q, b = score.query(q_batch), score.base(b_batch)
    q_ids, b_ids = q_batch.column("id").to_numpy(), b_batch.column("id").to_numpy()
    # Ids ascend within a cell, so that a stable sort by distance leaves ties in id order.
    by_id = np.lexsort((b_ids, np.repeat(np.arange(len(num_base)), num_base)))
    b, b_ids = _take(b, by_id), b_ids[by_id]
    # Per query row: how many base rows its cell has and where they start; rows of like width together.
    width = np.repeat(num_base, num_queries)
    start = np.repeat(np.cumsum(num_base) - num_base, num_queries)
    turn = np.argsort(width, kind="stable")
    lo = 0
    while lo < len(turn):
        hi = lo + max(1, PAIR_CHUNK // int(width[turn[lo]]))
        part = turn[lo:hi]
        most = int(width[part[-1]])
        if len(part) * most > 2 * PAIR_CHUNK:
            hi = lo + max(1, 2 * PAIR_CHUNK // most)
            part = turn[lo:hi]
            most = int(width[part[-1]])
        filled = np.arange(most)[None, :] < width[part][:, None]
        r, c = np.nonzero(filled)
        rows, cols = part[r], start[part[r]] + c
        dist = score.decide(q, b, rows, cols)
        if exclude_self:
            dist[q_ids[rows] == b_ids[cols]] = np.inf
        grid = np.full(filled.shape, np.inf)
        grid[filled] = dist
        best = np.argsort(grid, axis=1, kind="stable")[:, :k]
        chosen = np.take_along_axis(grid, best, 1)
        r, place = np.nonzero(np.isfinite(chosen))
        yield _result(
            q_ids[part[r]], b_ids[start[part[r]] + best[r, place]], score.report(chosen[r, place]), place + 1
        )
        lo = hi


def cell_topk(score, k: int, cell_columns: list[str], exclude_self: bool):
    """Batch function over rows ``cell columns, side, id, vec, code`` sorted by (cell, side).

    A cell that ends in another batch than it starts, or has many pairs, is streamed through a
    running top k; the small cells that lie within a batch are scored together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, top, features = None, None, None
        waiting_queries: list[pa.RecordBatch] = []
        waiting_base: list[pa.RecordBatch] = []

        def open_queries():
            nonlocal top, features
            block = _join(waiting_queries)
            waiting_queries.clear()
            top = RunningTopK(block.column("id").to_numpy(), k)
            features = score.query(block)

        def drain():
            block = _join(waiting_base)
            waiting_base.clear()
            for s in range(0, block.num_rows, BASE_CHUNK):
                part = block.slice(s, BASE_CHUNK)
                score_chunk(top, features, score.base(part), part.column("id").to_numpy(), score, exclude_self)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal top, features
            if top is not None and waiting_base:
                drain()
            waiting_queries.clear()
            waiting_base.clear()
            done, top, features = top, None, None
            if done is not None:
                yield done.result(score.report)

        def stream(rows: pa.RecordBatch) -> None:
            """Rows of one cell, all of it or a part."""
            num_queries = int((rows.column("side").to_numpy(zero_copy_only=False) == 0).sum())
            if num_queries:
                waiting_queries.append(rows.slice(0, num_queries))
            if num_queries == rows.num_rows:
                return
            if waiting_queries:
                open_queries()
            if top is None:
                return
            waiting_base.append(rows.slice(num_queries))
            if sum(b.num_rows for b in waiting_base) >= BASE_CHUNK:
                drain()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in cell_columns]
            change = np.zeros(batch.num_rows, dtype=bool)
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            starts = np.concatenate(([0], np.nonzero(change)[0]))
            ends = np.append(starts[1:], batch.num_rows)
            first = tuple(key[0] for key in keys)
            if first != cell:
                yield from close()
            cell = first
            stream(batch.slice(0, ends[0]))
            if len(starts) == 1:
                continue
            yield from close()
            # Whole cells inside this batch.
            inner = slice(1, len(starts) - 1)
            side = batch.column("side").to_numpy(zero_copy_only=False)
            queries = np.add.reduceat((side == 0).astype(np.int64), starts)[inner]
            base = (ends - starts)[inner] - queries
            paired = (queries > 0) & (base > 0)
            small = paired & (queries * base <= SMALL_PAIRS)
            if small.any():
                member = np.zeros(len(starts), dtype=bool)
                member[inner] = small
                rows = np.repeat(member, ends - starts)
                yield from small_cells_topk(batch.filter(pa.array(rows)), queries[small], base[small], score, k, exclude_self)
            for i in np.nonzero(paired & ~small)[0] + 1:
                stream(batch.slice(starts[i], ends[i] - starts[i]))
                yield from close()
            cell = tuple(key[-1] for key in keys)
            stream(batch.slice(starts[-1]))
        yield from close()

    return run


def held_topk(score, k: int, queries, exclude_self: bool):
    """Batch function over base rows ``id, vec, code`` against a broadcast query block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.ipc.open_stream(queries.value).read_all().combine_chunks().to_batches()[0]
        top = RunningTopK(block.column("id").to_numpy(), k)
        features = score.query(block)
        waiting: list[pa.RecordBatch] = []

        def drain():
            rows = _join(waiting)
            waiting.clear()
            for s in range(0, rows.num_rows, BASE_CHUNK):
                part = rows.slice(s, BASE_CHUNK)
                score_chunk(top, features, score.base(part), part.column("id").to_numpy(), score, exclude_self)

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BASE_CHUNK:
                drain()
        if waiting:
            drain()
        yield top.result(score.report)

    return run


class ProbedTopK:
    """The k best base rows of every query in each of several nested sets of buckets.

    Buckets come one after the other, each with all its base rows. ``steps`` are the ascending numbers of probes: the bucket of
    a query's probe p belongs to all sets of more than p probes.
    """

    def __init__(self, block: pa.RecordBatch, score, k: int, steps: list[int], exclude_self: bool):
        self.query_ids = block.column("id").to_numpy()
        self.features, self.score, self.k, self.exclude_self = score.query(block), score, k, exclude_self
        probes = list_matrix(block.column("probes"), np.int64)
        n, width = probes.shape
        order = np.argsort(probes, axis=None, kind="stable")
        self.buckets = probes.reshape(-1)[order]
        self.query = (order // width).astype(np.int32)
        self.level = np.searchsorted(steps, np.arange(width), side="right").astype(np.int8)[order % width]
        self.dist = np.full((len(steps), n, k), np.inf)
        self.ids = np.full((len(steps), n, k), NO_ID, dtype=np.int64)
        self.bucket, self.top, self.waiting = None, None, []

    def add(self, bucket: int, rows: pa.RecordBatch) -> None:
        """Base rows of a bucket, all of them or a part."""
        if bucket != self.bucket:
            self.leave()
            lo, hi = np.searchsorted(self.buckets, [bucket, bucket + 1])
            self.bucket, self.at, self.at_level = bucket, self.query[lo:hi], self.level[lo:hi]
            if hi > lo:
                self.top, self.part = RunningTopK(self.query_ids[self.at], self.k), _take(self.features, self.at)
        if self.top is not None:
            self.waiting.append(rows)
            if sum(b.num_rows for b in self.waiting) >= BASE_CHUNK:
                self._drain()

    def _drain(self) -> None:
        block = _join(self.waiting)
        self.waiting = []
        for s in range(0, block.num_rows, BASE_CHUNK):
            rows = block.slice(s, BASE_CHUNK)
            score_chunk(self.top, self.part, self.score.base(rows), rows.column("id").to_numpy(), self.score, self.exclude_self)

    def leave(self) -> None:
        """Merge the bucket into the sets that hold it."""
        if self.waiting:
            self._drain()
        top, self.top, self.part = self.top, None, None
        if top is None:
            return
        for level in range(len(self.dist)):
            mine = np.flatnonzero(self.at_level <= level)
            q = self.at[mine]
            dist = np.concatenate((self.dist[level, q], top.dist[mine]), axis=1)
            ids = np.concatenate((self.ids[level, q], top.ids[mine]), axis=1)
            best = np.lexsort((ids, dist), axis=1)[:, : self.k]
            self.dist[level, q], self.ids[level, q] = np.take_along_axis(dist, best, 1), np.take_along_axis(ids, best, 1)

    def result(self) -> Iterator[pa.RecordBatch]:
        """Rows of all sets, each once, with the first set that holds its bucket as ``rank``."""
        self.leave()
        for level, ids in enumerate(self.ids):
            new = ids != NO_ID
            if level:
                # What a smaller set holds and this one keeps is among the best of the smaller one.
                for before in self.ids[level - 1].T:
                    new &= ids != before[:, None]
            rows, cols = np.nonzero(new)
            yield _result(self.query_ids[rows], ids[rows, cols], self.score.report(self.dist[level, rows, cols]), np.full(len(rows), level))


def probed_topk(score, k: int, steps: list[int], exclude_self: bool):
    """Batch function over rows ``cell, side, bucket, id, vec, probes`` sorted by (cell, side, bucket): see :class:`ProbedTopK`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, top = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "side", "bucket")]
            change = np.flatnonzero(np.any([key[1:] != key[:-1] for key in keys], axis=0)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, batch.num_rows)):
                rows = batch.slice(lo, hi - lo)
                if keys[0][lo] != cell:
                    if top is not None:
                        yield from top.result()
                    cell, queries, top = keys[0][lo], [], None
                if keys[1][lo] == 0:
                    queries.append(rows)
                    continue
                if queries:
                    top, queries = ProbedTopK(_join(queries), score, k, steps, exclude_self), []
                if top is not None:
                    top.add(int(keys[2][lo]), rows)
        if top is not None:
            yield from top.result()

    return run
