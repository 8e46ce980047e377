import hashlib
import re

import numpy as np
import pytest

import __spark_entry__ as entry
from nearloom.llm import pii

SF = "/root/testdata/sf0.001"
# The contract's patterns as they stand.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        if kind == 0 and "@" not in text:  # the pattern as it stands takes quadratic time
            continue
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = [int(c) for c in s if c in "0123456789"]
            if kind == 1 and any(int(p) > 255 for p in s.split(".")):
                continue
            if kind == 2:
                doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


TRICKY = [
    "", "a@b", "a@b.c", "a@b.c%d@e.f", "a@b@c.com x..@-.-", "@a.b x@.c y@z..w q@r.s.", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.01 0001.2.3.4 1.2.3",
    "4539578763621486 4539 5787 6362 1486 4539-5787-6362-1486 1 4539578763621486", "+1 (984) 555-5227 224 +1 +1- +12-3456-78 +()12345678901",
    "ünï.x@mail.de é1.2.3.4 🙂 +49 30 1234567", "+" * 50 + "1 23456789", "1-2--3 4  5 1 2 3 4 5 6 7 8 9 0 1 2 3", "x" * 3000 + "@" * 300,
]


@pytest.mark.parametrize("k", range(len(TRICKY)))
def test_patterns(k):
    assert pii.base_spans(TRICKY[k]) == plain(TRICKY[k])


def test_patterns_on_random_texts():
    rng = np.random.default_rng(0)
    for _ in range(4000):
        text = "".join(rng.choice(list("0123456789019..--  +()@@aZ_%é")) for _ in range(rng.integers(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "+1 " * 100_000, "1 " * 150_000):
        assert len(pii.base_spans(text)) >= 0


def test_gradient_by_differences():
    rng, tagger = np.random.default_rng(1), pii.Tagger.fresh(3)
    for name in ("inputs", "recurrent", "output", "bias", "trans", "start"):
        setattr(tagger, name, getattr(tagger, name).astype(np.float64))
    x, y = rng.integers(0, pii.ROWS, (3, 10)), rng.integers(0, pii.TAGS, (3, 10))
    _, grads = tagger.gradient(x, y)
    for p, g in zip(tagger.parameters(), grads):
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in p.shape)
            old, sides = p[at], []
            for d in (1e-3, -1e-3):
                p[at] = old + d
                sides.append(tagger.gradient(x, y)[0])
            p[at] = old
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(g[at]), abs=2e-4)


def test_decoding_equals_exhaustive_search():
    rng, tagger = np.random.default_rng(2), pii.Tagger.fresh(5)
    x = rng.integers(0, pii.ROWS, (4, 4))
    scores, _ = tagger.run(x)
    tags, _ = tagger.decode(x)
    grids = np.stack(np.meshgrid(*[range(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for k in range(4):
        total = tagger.start[grids[:, 0]] + sum(scores[t, k, grids[:, t]] for t in range(4))
        total = total + sum(tagger.trans[grids[:, t], grids[:, t + 1]] for t in range(3))
        assert tuple(tags[k]) == tuple(grids[total.argmax()])


def prose(rng, n):
    return " ".join("".join(rng.choice(list("etaoinshrdlucmw"), rng.integers(2, 9))) for _ in range(n))


def number(rng, n):
    return "".join(map(str, rng.integers(0, 10, n)))


def card(rng):
    while True:
        s = "4" + number(rng, 15)
        if pii.luhn(s):
            return s


def made(rng, kind):
    return [
        f"{prose(rng, 1)}.{number(rng, 2)}@mail{number(rng, 1)}.example.com", ".".join(str(v) for v in rng.integers(1, 256, 4)), card(rng),
        f"+1 ({number(rng, 3)}) 555-{number(rng, 4)}",
    ][kind]


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(7)
    texts = [f"{prose(rng, 30)} {made(rng, k % 4)} {prose(rng, 30)}" for k in range(240)] + [f"{prose(rng, 40)} {number(rng, k % 6 + 1)} {prose(rng, 9)}" for k in range(80)]
    return pii.train(sorted(p for t in texts for p in pii._training_pieces(t)))


def test_held_out_spans_are_found_without_the_patterns(tagger):
    rng = np.random.default_rng(8)
    texts = [f"{prose(rng, 40)} {made(rng, k % 4)} {prose(rng, 25)}" for k in range(200)]
    found = pii.added_spans(tagger, texts, [[] for _ in texts])
    want = [plain(t) for t in texts]
    assert sum(set(w) <= set(f) for w, f in zip(want, found)) >= 0.9 * len(texts)
    clean = [f"{prose(rng, 30)} {number(rng, 4)} {prose(rng, 5)}, {number(rng, 2)}.{number(rng, 1)} {prose(rng, 20)}" for _ in range(200)]
    assert not any(pii.added_spans(tagger, clean, [pii.base_spans(t) for t in clean]))


def test_method_adds_what_the_patterns_miss(tagger):
    rng = np.random.default_rng(9)
    dotted = [c[:4] + "." + c[4:8] + "." + c[8:12] + "." + c[12:] for c in (card(rng) for _ in range(40))]
    local = [f"({number(rng, 3)}) 555-{number(rng, 4)}" for _ in range(40)]
    for shapes, kind in ((dotted, 2), (local, 3)):
        texts = [f"{prose(rng, 20)} {s} {prose(rng, 20)}" for s in shapes]
        assert not any(s[0] == kind for t in texts for s in pii.base_spans(t))
        found = pii.added_spans(tagger, texts, [pii.base_spans(t) for t in texts])
        assert sum((kind, t.index(s), t.index(s) + len(s)) in f for t, s, f in zip(texts, shapes, found)) >= 0.8 * len(texts)


def test_windows_agree_wherever_a_span_lies(tagger):
    rng = np.random.default_rng(10)
    before, after, c = prose(rng, 60), prose(rng, 60), card(rng)
    c = ".".join(c[k : k + 4] for k in (0, 4, 8, 12))
    hits = 0
    for shift in range(0, 70, 7):
        text = before[: 200 + shift] + " " + c + " " + after
        hits += (2, 201 + shift, 201 + shift + len(c)) in pii.added_spans(tagger, [text], [[]])[0]
    assert hits >= 8


def test_reconcile_equals_exhaustive_search():
    rng = np.random.default_rng(11)
    for _ in range(200):
        spans = {}
        for _ in range(rng.integers(0, 8)):
            a = int(rng.integers(0, 20))
            spans[int(rng.integers(0, 4)), a, a + int(rng.integers(1, 9))] = float(rng.integers(1, 50))
        items = list(spans)
        best = 0
        for mask in range(1 << len(items)):
            mine = sorted((s for k, s in enumerate(items) if mask >> k & 1), key=lambda s: s[1])
            if all(x[2] <= y[1] for x, y in zip(mine, mine[1:])):
                best = max(best, sum(spans[s] for s in mine))
        got = pii.reconcile(spans)
        assert sum(spans[s] for s in got) == best and all(x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_windows_left_out_could_add_nothing(tagger, monkeypatch):
    rng = np.random.default_rng(12)
    odd = ["12 ab 3", "(555) 123-4567", "1.2.3.4", "4.4.4.4.4", "55 5 555", "+1 (984) 555-5227 12345", "x@y", "é@ü.de", "4539.5787.6362.1486"]
    texts = [" ".join(prose(rng, int(rng.integers(1, 30))) + " " + odd[j] for j in rng.integers(0, len(odd), 12)) for _ in range(12)]
    bases = [pii.base_spans(t) for t in texts]
    assert pii.window_starts(prose(rng, 300) + " 12 w1 x2 2021 3.5", []) == []
    some = pii.added_spans(tagger, texts, bases)
    monkeypatch.setattr(pii, "window_starts", lambda text, base: list(range(-2 * pii.STRIDE, len(text), pii.STRIDE)))
    assert some == pii.added_spans(tagger, texts, bases)


def test_rows_equal_plain_version(spark, doc_frame, odd_rows, tagger):
    rows = odd_rows + [(50 + k, t, "en", "a") for k, t in enumerate(TRICKY)]
    found = pii.find(doc_frame(rows), tagger).select("doc_id", "base", "spans").collect()
    assert len(found) == len(rows)
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add(r[1] or "")
    for r in found:
        base, spans = ([tuple(s) for s in c] for c in (r.base, r.spans))
        assert base in [plain(t) for t in texts[r.doc_id]] and set(base) <= set(spans)
    assert pii.find(doc_frame([]), tagger).count() == 0
    assert pii.fit(doc_frame([])).inputs.shape[0] == 2


def test_query_digests(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in entry.queries()["op11_personal_data"](spark, SF).collect():
        base = plain(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
