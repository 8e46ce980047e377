"""Plain versions and constants shared by the tests."""

import numpy as np

SF = "/root/testdata/sf0.001"


def brute(q, b, k, metric="cosine", exclude_self=False, farthest=False, q_ids=None, b_ids=None):
    """Lists of (id, dist) per query by (dist, id)."""
    q, b = q.astype(np.float64), b.astype(np.float64)
    q_ids = list(range(len(q))) if q_ids is None else list(q_ids)
    b_ids = list(range(len(b))) if b_ids is None else list(b_ids)
    out = {}
    for i, row in zip(q_ids, q):
        if metric == "l2sq":
            d = np.array([((row - y) ** 2).sum() for y in b])
        else:
            d = -np.array([(row * y).sum() for y in b]) + (1.0 if metric == "cosine" else 0.0)
        pairs = [(round(-v if farthest else v, 12), j) for v, j in zip(d, b_ids) if not (exclude_self and j == i)]
        out[i] = [j for _, j in sorted(pairs)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out
