import re

import numpy as np
import pytest
import xxhash

from nearloom.llm import components, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "a b c d a b c", "É é Z z y", "x\x0by\x1cz w v u"])
def test_fingerprint(text):
    assert simhash.simhash(text) == plain(text)


def test_long_text_is_cut_in_chunks_without_effect(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(3000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.simhash(text) == whole == plain(text)


def spread(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2**63, n, dtype=np.uint64) >> rng.integers(0, 40, n).astype(np.uint64)
    for _ in range(3):
        some = x[rng.random(len(x)) < 0.4]
        x = np.unique(np.concatenate([x, some ^ (np.uint64(1) << rng.integers(0, 64, len(some)).astype(np.uint64))]))
    return x


@pytest.mark.parametrize("max_bits,node_rows", [(2, 40), (2, 5000), (0, 40), (3, 100)])
def test_trie_join_equals_brute_force(spark, max_bits, node_rows):
    x = spread(300, max_bits)
    want = {(int(x[i]), int(x[j])) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= max_bits}
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint")
    got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.trie_join(df, max_bits, node_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark, doc_frame, odd_rows):
    got = simhash.near_copies(doc_frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = {i: plain(t) for i, t, *_ in odd_rows}
    for r in got:
        assert r.fingerprint % 2**64 == want[r.doc_id]
    place = {r.doc_id: r.component_id for r in got}
    assert place[1] == place[2] == place[3] == 1
    assert place[5] == place[6] == place[None] == 5
    kept = simhash.first_of_each(doc_frame(odd_rows))
    assert kept.columns == doc_frame(odd_rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({p for p in place.values()})
    assert simhash.near_copies(doc_frame([])).count() == 0


def test_groups_equal_brute_force(spark, doc_frame):
    rng = np.random.default_rng(0)
    base = [" ".join(f"w{v}" for v in rng.integers(0, 200, 150)) for _ in range(15)]
    rows = []
    for i in range(150):
        words = base[i % 15].split()
        if i >= 30:
            words[int(rng.integers(0, 150))] = "changed"
        rows.append((1000 - i, " ".join(words)))
    prints = {i: plain(t) for i, t in rows}
    place = {i: i for i in prints}
    for _ in range(20):
        place = {i: min([place[i], *(place[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2)]) for i in prints}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(doc_frame(rows)).collect()}
    assert got == place


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 560)] + [(3, 500), (3, 3), (None, 7)]
    df = spark.createDataFrame(chain[::-1] + star + star, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 3 for i in [3, *range(500, 560)]}
    assert got == want
    assert components.connected_components(df.limit(0)).count() == 0
