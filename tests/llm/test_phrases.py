import re
from collections import Counter

import numpy as np
import pytest

from nearloom.llm import phrases


def plain(rows, top, least):
    """``collocations`` over (doc_id, text, lang, source) by dictionaries."""
    counts, n = {}, Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for d in range(1, 5):
                for i in range(len(words) - d + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + d])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in held.items())
            if not inside:
                s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = []
        while len(words) < 60:
            x = rng.random()
            words += (["new", "york", "City"] if x < 0.1 else ["às", "vezes"] if x < 0.2 else ["a", "a", "a"] if x < 0.3 else ["in", "the", "end", "of"] if x < 0.35
                      else [f"w{int(rng.zipf(1.5)) % 500}" + ("." if rng.random() < 0.1 else "")])
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "s"))
    return rows


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("top", [2000, 7])
def test_equals_plain_version(doc_frame, odd_rows, top):
    rows = corpus(90) + odd_rows
    assert got(phrases.collocations(doc_frame(rows), top=top, least=6)) == plain(rows, top, 6)


def test_blocks_do_not_matter(doc_frame, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    monkeypatch.setattr(phrases, "OPEN_BYTES", 9000)
    monkeypatch.setattr(phrases, "MERGED", 300)
    rows = corpus(60, seed=1)
    assert got(phrases.collocations(doc_frame(rows).repartition(5), least=4)) == plain(rows, 2000, 4)


def test_ties_are_in_byte_order_and_cuts_at_the_smallest(doc_frame):
    rows = [(i, "x y z. p q. é f; Z Y\nb\tc", "en", "s") for i in range(5)]
    found = got(phrases.collocations(doc_frame(rows), least=5))
    assert found == plain(rows, 2000, 5) and [r[2] for r in found][:3] == ["b c", "p q", "é f"]


def test_nothing(doc_frame):
    assert phrases.collocations(doc_frame([])).count() == 0
    assert phrases.collocations(doc_frame([(1, None, None, None), (2, " .;", "en", "s"), (3, "a b", "en", "s")])).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**17, 10**17, 3 * 10**17)], "a bigint, l bigint, r bigint")
    assert row.select(phrases.score(*(row[c] for c in "alr")).alias("s")).first().s == 500_000


@pytest.mark.parametrize("burst, held", [(4, 1 << 20), (4, 60), (10**6, 200)])
def test_trie_counts_what_a_dictionary_counts(burst, held):
    rng = np.random.default_rng(burst)
    paths = np.unique(rng.integers(0, 7, (300, 3)), axis=0).astype(np.int32)
    trie, want, runs = phrases.HatTrie(paths, burst, held), Counter(), []
    for _ in range(20):
        keys, n = np.unique(rng.integers(0, len(paths), 200) << 32 | rng.integers(0, 9, 200), return_counts=True)
        want.update(dict(zip(keys.tolist(), n.tolist())))
        runs += trie.add(keys, n)
        assert sum(trie.sizes.values()) <= held
    runs.append(trie.spill())
    total = Counter()
    for keys, n in runs:
        assert (np.diff(keys) > 0).all()
        total.update(dict(zip(keys.tolist(), n.tolist())))
    assert total == want and not trie.root
    assert len(runs) > 1 or held > 1000


def test_containers_burst_into_branches():
    paths = np.array([[1, w, 0] for w in range(50)], np.int32)
    trie = phrases.HatTrie(paths, burst=8)
    list(trie.add(np.arange(50) << 32, np.ones(50, np.int64)))
    branch, = trie.root[1]
    assert set(branch) == set(range(50)) and all(isinstance(c, dict) for c in branch.values())


def test_packing():
    arrays = [np.array([1, -2, 2**62]), np.zeros(0, np.int64), np.arange(9, dtype=np.int32)]
    for a, b in zip(arrays, phrases.unpack(phrases.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
