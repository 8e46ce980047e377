"""Collocated phrases of each language, counted by burst tries in tasks and merged sorted runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.common import parts_for, release, write_shared

# Words of the longest phrase; occurrences a phrase needs; share of its occurrences, in hundredths, inside a longer one that drops it.
LONGEST, LEAST, INSIDE = 4, 30, 80
# Bytes of text in a block, and of all blocks that a task has open, one for each language it met.
BLOCK_BYTES, OPEN_BYTES = 4 << 20, 24 << 20
# Tokens counted together before they go into the trie; entries of a container before it bursts; entries of a trie before it spills.
CHUNK, BURST, HELD = 1 << 18, 4096, 1 << 19
# Keys of a prefix partition on average; parts that the phrases of one prefix are dealt to, by their last word.
MERGED, SPREAD = 1 << 20, 16

PIECE = re.compile(rb"[.,;:!?\x0A-\x0D]")


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes, most significant bytes together and compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a, f"<i{a.dtype.itemsize}")
        out += [np.array([a.dtype.itemsize, len(a)], "<i8").tobytes(), a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        width, n = np.frombuffer(raw, "<i8", 2, at)
        at += 16
        out.append(np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T.copy().view(f"<i{width}").reshape(-1))
        at += int(width * n)
    return out


@dataclass
class HatTrie:
    """Counts of word sequences: hash containers under a shallow trie of word ids.

    ``paths[p]`` are the words of prefix ``p``; a key is a prefix and a last word in one integer. A container is a dict
    of keys; one that outgrows ``burst`` becomes a branch with a container for each next word of the prefix. When the
    trie holds more than ``held`` keys, its largest subtrees under the root leave whole, until half is left.
    """

    paths: np.ndarray
    burst: int = BURST
    held: int = HELD
    root: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Add counts of distinct keys in ascending order; what spills is given back as a sorted run."""
        first = self.paths[keys >> 32, 0]
        order = np.argsort(first, kind="stable")
        keys, counts, first = keys[order], counts[order], first[order]
        cuts = np.append(np.flatnonzero(np.diff(first, prepend=-1)), len(keys))
        for low, high in zip(cuts[:-1], cuts[1:]):
            word = int(first[low])
            node, grown = self._into(self.root.get(word, {}), 1, keys[low:high], counts[low:high])
            self.root[word] = node
            self.sizes[word] = self.sizes.get(word, 0) + grown
        if sum(self.sizes.values()) > self.held:
            yield self.spill(self.held // 2)

    def _into(self, node, depth: int, keys: np.ndarray, counts: np.ndarray) -> tuple[object, int]:
        if isinstance(node, dict):
            before = len(node)
            for key, n in zip(keys.tolist(), counts.tolist()):
                node[key] = node.get(key, 0) + n
            grown = len(node) - before
            if len(node) > self.burst and depth < self.paths.shape[1]:
                return self._burst(node, depth), grown
            return node, grown
        grown, words = 0, self.paths[keys >> 32, depth]
        for word in np.unique(words):
            mine = words == word
            branch, more = self._into(node[0].get(int(word), {}), depth + 1, keys[mine], counts[mine])
            node[0][int(word)] = branch
            grown += more
        return node, grown

    def _burst(self, container: dict, depth: int) -> tuple[dict]:
        children: dict[int, dict] = {}
        for key, n in container.items():
            children.setdefault(int(self.paths[key >> 32, depth]), {})[key] = n
        return ({w: self._burst(c, depth + 1) if len(c) > self.burst and depth + 1 < self.paths.shape[1] else c for w, c in children.items()},)

    def _items(self, node) -> Iterator[dict]:
        if isinstance(node, dict):
            yield node
        else:
            for child in node[0].values():
                yield from self._items(child)

    def spill(self, left: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Take subtrees out, the largest first, until ``left`` keys remain; their keys in order and counts."""
        out, total = [], sum(self.sizes.values())
        for word in sorted(self.sizes, key=lambda w: (-self.sizes[w], w)):
            if total <= left:
                break
            total -= self.sizes.pop(word)
            out += self._items(self.root.pop(word))
        keys = np.fromiter((k for c in out for k in c), np.int64)
        counts = np.fromiter((n for c in out for n in c.values()), np.int64)
        order = np.argsort(keys)
        return keys[order], counts[order]


@dataclass
class Block:
    """Tokens of a part of one language: places of words in ``ids`` (-1: no frequent word here, or a piece ends), and
    places of the frequent phrase of ``length`` words that begins at each token in ``nodes`` (-1: none)."""

    length: int
    words: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    nodes: np.ndarray

    def pack(self) -> bytes:
        return pack(np.array([self.length]), self.words, self.ids, self.at, self.nodes)

    @staticmethod
    def unpack(data: bytes) -> Block:
        length, *rest = unpack(data)
        return Block(int(length[0]), *rest)

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens where a phrase of one word more may begin, since both its parts are frequent, and its keys."""
        starts = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
        return starts, self.at[starts].astype(np.int64) << 32 | self.words[starts + self.length].astype(np.int64)

    def runs(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """Sorted runs of the candidate phrases of one word more: prefix partition, then packed prefixes, last words and counts."""
        starts, keys = self._keys()
        paths = np.zeros((len(self.nodes), self.length), np.int32)
        for d in range(self.length):
            paths[self.at[starts], d] = self.words[starts + d]
        trie = HatTrie(paths)

        def cut(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
            prefix, last = self.nodes[keys >> 32], self.ids[keys & 0xFFFFFFFF]
            part = _part(prefix, last, parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[p] : bounds[p + 1]]
                yield int(p), pack(prefix[mine], last[mine], counts[mine])

        for low in range(0, len(keys), CHUNK):
            for spilled in trie.add(*np.unique(keys[low : low + CHUNK], return_counts=True)):
                yield from cut(*spilled)
        yield from cut(*trie.spill())

    def longer(self, prefix: np.ndarray, last: np.ndarray, nodes: np.ndarray) -> Block:
        """The block with the frequent phrases of one word more, and without tokens that none of them covers."""
        starts, keys = self._keys()
        known = np.searchsorted(self.nodes, prefix).astype(np.int64) << 32 | np.searchsorted(self.ids, last).astype(np.int64)
        order = np.argsort(known)
        known, nodes = known[order], nodes[order]
        ids, at_known = np.unique(nodes, return_inverse=True)
        at = np.full(len(self.words), -1, np.int32)
        if len(known):
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[place] == keys
            at[starts[hit]] = at_known[place[hit]]
        covered = np.zeros(len(at), bool)
        for d in range(self.length + 1):
            covered[d:] |= at[: len(at) - d] >= 0
        stay = covered | np.append(False, covered[:-1])
        words = np.where(covered, self.words, -1).astype(np.int32)[stay]
        return Block(self.length + 1, words, self.ids, at[stay], ids)


def _part(prefix: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    """Prefix partitions: those of a prefix are ``SPREAD``, by its last word."""
    with np.errstate(over="ignore"):
        h = (prefix.astype(np.uint64) * np.uint64(SPREAD) + (last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SPREAD))
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


def _blocks(docs: DataFrame) -> DataFrame:
    """``block, lang, words, counts, places``: distinct words of a block, their occurrences, and its tokens (-1: a piece ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def send(lang: str) -> pa.RecordBatch:
            local, places, _ = held.pop(lang)
            tokens = np.concatenate(places).astype(np.int32)
            words = pa.array(list(local), pa.binary()).cast(pa.string())
            counts = np.bincount(tokens[tokens >= 0], minlength=len(words)).astype(np.int64)
            whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_pydict({
                "lang": pa.array([lang]), "words": whole(words), "counts": whole(pa.array(counts)), "places": pa.array([pack(tokens)], pa.binary()),
            })

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = (text.as_py() or "").encode().lower()
                local, places, size = held.setdefault(lang, [{}, [], 0])
                numbers = []
                for piece in PIECE.split(raw):
                    if words := piece.split():
                        numbers += [local.setdefault(w, len(local)) for w in words]
                        numbers.append(-1)
                places.append(np.array(numbers, np.int32))
                held[lang][2] = size + len(raw)
                if held[lang][2] > BLOCK_BYTES:
                    yield send(lang)
                elif sum(h[2] for h in held.values()) + 4096 * len(held) > OPEN_BYTES:
                    yield send(max(held, key=lambda x: held[x][2]))
        for lang in list(held):
            yield send(lang)

    made = docs.mapInArrow(run, "lang string, words array<string>, counts array<bigint>, places binary")
    return write_shared(made.withColumn("block", F.monotonically_increasing_id()))


def _column(table: pa.Table, name: str, dtype=np.int64) -> np.ndarray:
    return table.column(name).to_numpy().astype(dtype)


STEP = "block bigint, part int, data binary"


def _sent(block: pa.Table, made: Block, parts: int) -> pa.Table:
    """The block itself as part -1, and its runs by prefix partition."""
    rows = [(-1, made.pack()), *made.runs(parts)]
    release()
    return pa.table({
        "block": pa.array([block.column("block")[0].as_py()] * len(rows), pa.int64()), "part": pa.array([r[0] for r in rows], pa.int32()),
        "data": pa.array([r[1] for r in rows], pa.binary()),
    })


def _begin(parts: int) -> Callable:
    """Blocks of frequent words, and their runs of two words."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        tokens, = unpack(block.column("places")[0].as_py())
        place, ids = _column(found, "place"), _column(found, "id")
        order = np.argsort(ids)
        new = np.full(len(block.column("words")[0]) + 1, -1, np.int32)
        new[place[order]] = np.arange(len(order), dtype=np.int32)
        words = new[tokens]
        stay = (words >= 0) | np.append(False, words[:-1] >= 0)
        words = np.append(words[stay], -1).astype(np.int32)
        return _sent(block, Block(1, words, ids[order], words, ids[order]), parts)

    return run


def _go_on(parts: int) -> Callable:
    """Blocks with the frequent phrases found, and runs of one word more."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        answers = [unpack(d) for d in found.column("data").to_pylist()]
        prefix, last, nodes = (np.concatenate([np.zeros(0, np.int64), *(a[k] for a in answers)]) for k in range(3))
        made = Block.unpack(block.column("data")[0].as_py()).longer(prefix, last, nodes)
        return _sent(block, made, parts)

    return run


def _merging(least: int) -> Callable:
    """Merge the sorted runs of a prefix partition; its frequent phrases as block -1, and those of every run for its block."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        runs = [unpack(d) for d in table.column("data").to_pylist()]
        blocks = table.column("block").to_pylist()
        prefix, last, n = (np.concatenate([r[k] for r in runs]) for k in range(3))
        order = np.lexsort((last, prefix))
        new = np.append(True, (np.diff(prefix[order]) != 0) | (np.diff(last[order]) != 0))
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n[order], starts)
        held = total >= least
        nodes = np.where(held, (np.int64(part) << 40) + np.cumsum(held) - 1, -1)
        node = np.empty(len(order), np.int64)
        node[order] = nodes[np.cumsum(new) - 1]
        first = order[starts[held]]
        out_blocks, data = [-1], [pack(prefix[first], last[first], total[held], nodes[held])]
        low = 0
        for block, run in zip(blocks, runs):
            mine = slice(low, low + len(run[0]))
            low += len(run[0])
            hit = node[mine] >= 0
            if hit.any():
                out_blocks.append(block)
                data.append(pack(run[0][hit], run[1][hit], node[mine][hit]))
        release()
        return pa.table({"block": pa.array(out_blocks, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _grams(merged: DataFrame) -> DataFrame:
    """``prefix, last, f, node`` of the frequent phrases of a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                yield from pa.table(dict(zip(("prefix", "last", "f", "node"), unpack(d)))).to_batches(max_chunksize=1 << 16)

    return merged.filter("block = -1").select("data").mapInArrow(run, "prefix bigint, last bigint, f bigint, node bigint")


def count_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, dict[int, DataFrame], DataFrame]:
    """Frequent words ``id, lang, word, f``, frequent phrases ``w1, w2, ..., f`` by length, and ``lang, n`` of all words.

    Words are counted first and the frequent ones numbered; blocks then hold numbers. A phrase of ``d`` words
    can be frequent only if its first and its last ``d - 1`` are, so blocks send sorted runs of those only, out
    of the trie in which they count them. A prefix partition merges its runs and answers every block which phrases are frequent.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    blocks = _blocks(docs)
    every = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select(
        "block", "lang", F.col("place").cast("long").alias("place"), F.col("w.words").alias("word"), F.col("w.counts").alias("n")
    )
    words = every.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    words = write_shared(words.withColumn("id", F.monotonically_increasing_id()))
    totals = write_shared(blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("n")).filter("n > 0"))
    tokens = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).first()[0]
    parts = parts_for(int(tokens), MERGED)
    met = every.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "id")
    step = write_shared(blocks.groupBy("block").cogroup(met.groupBy("of")).applyInArrow(_begin(parts), STEP))
    grams: dict[int, DataFrame] = {}
    for d in range(2, LONGEST + 1):
        merged = step.filter("part >= 0").groupBy("part").applyInArrow(_merging(least), "block bigint, data binary")
        merged = write_shared(merged)
        grams[d] = write_shared(_grams(merged))
        if d < LONGEST:
            answers = merged.filter("block >= 0")
            state = step.filter("part = -1")
            step = write_shared(state.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_go_on(parts), STEP))
    named = {2: grams[2].select(F.col("prefix").alias("w1"), F.col("last").alias("w2"), "f", "node")}
    for d in range(3, LONGEST + 1):
        before = named[d - 1].drop("f").withColumnRenamed("node", "prefix")
        named[d] = write_shared(grams[d].join(before, "prefix").select(
            *(f"w{k}" for k in range(1, d)), F.col("last").alias(f"w{d}"), "f", "node"
        ))
    return words, {d: g.drop("node") for d, g in named.items()}, totals


def _looked_up(grams: DataFrame, table: DataFrame, columns: list[str], out: str) -> DataFrame:
    """``grams`` with ``out``, the occurrences of the phrase in ``columns``."""
    names = {f"w{k + 1}": c for k, c in enumerate(columns)}
    return grams.join(table.select(*(F.col(a).alias(b) for a, b in names.items()), F.col("f").alias(out)), columns)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    wide = lambda c: c.cast("decimal(24,0)")
    # Integral division of decimals has no function of its own.
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(left) + wide(right))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 2000, least: int = LEAST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases of every language.

    Texts (A-Z in lower case) are cut into pieces at ``.,;:!?`` and line ends and those into words at spaces and tabs. A
    phrase has 2 to 4 words of one piece and ``a`` >= ``least`` occurrences, overlaps included. Its score is the
    least floor(2000000 a / (l + r)) over its cuts into a first part of ``l`` and a rest of ``r`` occurrences, of equals
    that of the shortest first part. Phrases inside a longer one with at least ``INSIDE`` hundredths of their occurrences are dropped. ``n`` counts
    the language's words. Order: score, then ``a``, both descending, then the phrase by its bytes.

    Null languages are ``und``, null and empty texts hold nothing, repeated rows count each, other columns are not looked
    at, and an empty table gives no rows. A very long text is a block of its own. No word, phrase or language is gathered
    in one task: runs of a prefix are dealt out by last words, and only ``top`` rows of a partition are ranked together.
    """
    words, grams, totals = count_phrases(docs, lang, text, least)
    ones = words.select(F.col("id").alias("w1"), "f")
    tables = {1: ones, **grams}
    found = None
    for d, table in grams.items():
        names = [f"w{k}" for k in range(1, d + 1)]
        scored = table.withColumnRenamed("f", "a")
        for k in range(1, d):
            scored = _looked_up(scored, tables[k], names[:k], f"l{k}")
            scored = _looked_up(scored, tables[d - k], names[k:], f"r{k}")
        cuts = [F.struct(score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, d)]
        best = cuts[0] if d == 2 else F.least(*cuts)
        scored = scored.withColumn("cut", best).select(*names, "a", "cut.score", "cut.l", "cut.r")
        if d + 1 in grams:
            longer = grams[d + 1]
            sides = [longer.select(*(F.col(f"w{k + s}").alias(f"w{k}") for k in range(1, d + 1)), "f") for s in (0, 1)]
            around = sides[0].unionByName(sides[1]).groupBy(*names).agg(F.max("f").alias("around"))
            scored = scored.join(around, names, "left")
            wide = lambda c: F.col(c).cast("decimal(24,0)")
            scored = scored.filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * INSIDE)).drop("around")
        for k in range(d + 1, LONGEST + 1):
            scored = scored.withColumn(f"w{k}", F.lit(None).cast("long"))
        found = scored if found is None else found.unionByName(scored)
    found = found.join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("word1")), "w1")
    rough = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    found = found.withColumn("place", F.rank().over(rough)).filter(F.col("place") <= top)
    for k in range(2, LONGEST + 1):
        found = found.join(words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}")), f"w{k}", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", *(f"word{k}" for k in range(1, LONGEST + 1))))
    exact = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(exact)).filter(F.col("rank") <= top)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
