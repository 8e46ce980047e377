import hashlib
import re

import pytest

from nearloom.llm import mixing


def plain_mix(rows, weights=(5.0, 2.0, 1.0), repeats=3):
    """(source -> target) and taken words per row, one document at a time."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    source = [r[3] for r in rows]
    total = {s: sum(n for n, x in zip(size, source) if x == s) for s in set(source)}
    names = sorted((s for s in total if s is not None), key=str.encode) + [None] * (None in total)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        level = (sum(total.values()) - sum(repeats * total[s] for s in full)) / free if free else 0
        more = {s for s in names if s not in full and repeats * total[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: min(repeats * total[s], level * weight[s]) for s in names}
    taken = [0] * len(rows)
    for s in names:
        left = round(target[s])
        mine = sorted((i for i in range(len(rows)) if source[i] == s), key=lambda i: (hashlib.md5(str((rows[i][1] or "") if rows[i][0] is None else rows[i][0]).encode()).hexdigest(), size[i]))
        for _ in range(repeats):
            for i in mine:
                took = min(left, size[i])
                taken[i] += took
                left -= took
    return target, taken, size, total


def corpus():
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), "en", f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
    return rows + [(1000, "a b", "en", None), (1001, "a", "en", "tiny"), (1002, None, None, None), (1003, " ", "en", "empty")]


def test_equals_plain_version(doc_frame):
    rows = corpus()
    target, taken, size, total = plain_mix(rows)
    got = {r.doc_id: r for r in mixing.plan_mix(doc_frame(rows)).collect()}
    assert len(got) == len(rows)
    for i, (key, _, _, source) in enumerate(rows):
        r = got[key]
        assert (r["size"], r.source_size, r.taken) == (size[i], total[source], taken[i])
        assert r.target == pytest.approx(target[source])
        assert sum(p.words for p in r.pieces) == r.taken <= 3 * r["size"]
    for s in total:
        assert abs(sum(t for t, r in zip(taken, rows) if r[3] == s) - target[s]) < 1
    assert sum(target.values()) == pytest.approx(sum(size))


def test_repeated_ids_are_ordered_whatever_the_partitions(doc_frame):
    rows = [(i % 9 if i % 4 else None, " ".join([f"w{i}"] * (1 + i % 13)), "en", "ab"[i % 2]) for i in range(260)]
    runs = []
    for parts in (1, 5):
        plan = mixing.plan_mix(doc_frame(rows).repartition(parts))
        runs.append(sorted((r.text, r["size"], r.taken) for r in plan.collect()))
        order = [r.text for r in mixing.training_order(plan, ["doc_id", "text", "_target", "_first"]).collect()]
        runs.append(order)
    assert runs[0] == runs[2] and sorted(runs[1]) == sorted(runs[3])


def test_positions_follow_the_ramp(doc_frame):
    rows = [(i, "w " * 10, "en", "abc"[i % 3]) for i in range(3000)]
    got = mixing.plan_mix(doc_frame(rows)).collect()
    half = {s: [0, 0] for s in "abc"}
    for r in got:
        for p in r.pieces:
            assert 0 <= p.position <= 1
            half[r.source][p.position >= 0.5] += p.words
    # Heavy sources fade out, light ones fade in, by the integrals of their ramps.
    share = {s: v[0] / sum(v) for s, v in half.items()}
    assert share["a"] == pytest.approx(0.5625, abs=0.02)
    assert share["b"] == pytest.approx(0.5, abs=0.02)
    assert share["c"] == pytest.approx(0.375, abs=0.02)


def test_order_and_reruns(doc_frame):
    docs = doc_frame(corpus())
    first = [tuple(r) for r in mixing.training_order(mixing.plan_mix(docs, prefix="_mix_"), docs.columns, prefix="_mix_").collect()]
    again = [tuple(r) for r in mixing.training_order(mixing.plan_mix(docs.repartition(7), prefix="_mix_"), docs.columns, prefix="_mix_").collect()]
    assert first == again and len(first) > 200
    plan = {r.doc_id: r for r in mixing.plan_mix(docs).collect()}
    copies = {k: sum(r[0] == k for r in first) for k in plan}
    for k, r in plan.items():
        assert copies[k] == sum(2 * p.words >= r["size"] for p in r.pieces)


def test_odd_rows(doc_frame, odd_rows):
    got = mixing.plan_mix(doc_frame(odd_rows)).collect()
    target, taken, size, _ = plain_mix(odd_rows)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r[0] or -1, n) for r, n in zip(odd_rows, size))
    by_source = {}
    for r in got:
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(by_source[s] - t) < 1
    none = mixing.plan_mix(doc_frame([]))
    assert none.count() == 0 and mixing.training_order(none, ["doc_id", "pieces"]).count() == 0
    blank = mixing.plan_mix(doc_frame([(1, None), (2, "")])).collect()
    assert [r.taken for r in blank] == [0, 0]
