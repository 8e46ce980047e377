"""Byte-level BPE encoding and decoding by a global shuffle of distinct words."""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.common import parts_for, release
from nearloom.session import ensure_checkpoint_dir

# Characters of text in a block, whose distinct words go out once.
BLOCK_CHARS = 20 << 20
# Distinct words of all blocks that meet in a task.
WORDS_PER_TASK = 250_000
# Assembled tokens held as wide integers at a time.
STEP = 1 << 20


class Splitter:
    """Cuts texts into pre-tokens by a pattern and numbers the distinct ones in the order they come.

    Where a space does not stand between other white space and white space or the text's end, no pre-token
    reaches across its front: the pattern lets a space begin a pre-token only. So texts are cut at
    spaces and the pieces, which repeat, are matched once per block; texts with such spaces are
    matched whole.
    """

    RUNS = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, pattern: str):
        self.match = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _numbers(self, text: str) -> list[int]:
        words = self.words
        return [words.setdefault(w, len(words)) for w in self.match(text)]

    def cut(self, text: str | None) -> np.ndarray:
        """Numbers of the pre-tokens of a text."""
        if not text:
            return np.empty(0, np.int32)
        if self.RUNS.search(text):
            return np.array(self._numbers(text), np.int32)
        first, *rest = text.split(" ")
        known = self.pieces
        try:
            found = list(map(known.__getitem__, rest))
        except KeyError:
            for piece in rest:
                if piece not in known:
                    known[piece] = tuple(self._numbers(" " + piece))
            found = list(map(known.__getitem__, rest))
        return np.array([*self._numbers(first), *chain.from_iterable(found)], np.int32)


def pack(values: np.ndarray) -> bytes:
    """Integers below 2^32, by byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(words: list[str]) -> bytes:
    """Words as lengths and bytes, compressed."""
    raw = [w.encode() for w in words]
    lengths = np.array([len(w) for w in raw], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(raw).to_bytes(4, "little") + lengths + b"".join(raw))


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64)) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist())]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _blocks(docs: DataFrame, key: str, text: str, pattern: str, tasks: int, buckets: int, block_chars: int) -> DataFrame:
    """Blocks of documents as a table bucketed by ``block``.

    A row holds the keys, the number of pre-tokens of each document, the numbers of all pre-tokens,
    and the block's distinct words in ``chunks`` by the hash of the word: the task that encodes
    them, the words and their numbers.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, pieces, size, splitter = [], [], 0, Splitter(pattern)

        def send() -> pa.RecordBatch:
            words = list(splitter.words)
            task = np.array([xxhash.xxh64_intdigest(w) % tasks for w in words], np.int64)
            order = np.argsort(task, kind="stable")
            bounds = np.flatnonzero(np.append(True, task[order][1:] != task[order][:-1])) if len(words) else np.empty(0, int)
            chunks = []
            for low, high in zip(bounds, np.append(bounds[1:], len(order))):
                places = order[low:high]
                chunks.append({"task": int(task[places[0]]), "words": pack_words([words[i] for i in places]), "places": pack(places)})
            row = {
                "keys": pa.array([keys], pa.list_(key_type)),
                "lengths": pa.array([[len(p) for p in pieces]], pa.list_(pa.int64())),
                "pieces": pa.array([pack(np.concatenate(pieces))], pa.binary()),
                "chunks": pa.array([chunks], pa.list_(pa.struct([("task", pa.int64()), ("words", pa.binary()), ("places", pa.binary())]))),
            }
            return pa.RecordBatch.from_pydict(row)

        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                content = t.as_py()
                keys.append(k)
                pieces.append(splitter.cut(content))
                size += len(content or "")
                if size > block_chars:
                    yield send()
                    keys, pieces, size, splitter = [], [], 0, Splitter(pattern)
        if keys:
            yield send()
        del keys, pieces, splitter
        release()

    shape = f"keys array<{kind}>, lengths array<bigint>, pieces binary, chunks array<struct<task: bigint, words: binary, places: binary>>"
    made = docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, shape)
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    made = made.withColumn("block", F.monotonically_increasing_id())
    made.write.format("parquet").option("compression", "none").bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def encode(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str, key: str = "doc_id", text: str = "text",
    block_chars: int = BLOCK_CHARS, words_per_task: int = WORDS_PER_TASK,
) -> DataFrame:
    """``key, ids`` of every row: the token ids of the whole text, without special tokens.

    Texts are cut into pre-tokens by ``pattern`` and every distinct pre-token of the whole table is
    encoded once: a block of documents sends each of its distinct words once, by hash, to the task that
    encodes this word for all blocks; ids come back to the block, where the positions of the words were
    kept, and documents are put together again. Words of a block travel packed by task, and
    blocks stay where they are written, bucketed by their number. A frequent word costs one
    entry a block, so no word is a hot key; a very long text is a block of its own. Nothing is broadcast
    but the ranks, whose size is the vocabulary's.

    Null texts are empty; empty texts have no ids. Repeated rows are encoded each. Other columns
    are not looked at. An empty table gives no rows.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # About one distinct word in 64 characters of a block.
    tasks = parts_for(chars // 64, words_per_task, least)
    blocks = _blocks(docs, key, text, pattern, tasks, parts_for(chars, 4 * block_chars, least), block_chars)
    shared = spark.sparkContext.broadcast(ranks)
    kind = docs.schema[key].dataType.simpleString()

    def encode_words(sent: pa.Table) -> pa.Table:
        tokenizer = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        lengths, ids = [], []
        for words in sent.column("words"):
            found = []
            for w in unpack_words(words.as_py()):
                got = known.get(w)
                if got is None:
                    got = known[w] = tokenizer.encode_ordinary(w.decode())
                found.append(got)
            lengths.append(pack(np.array([len(x) for x in found], np.int64)))
            ids.append(pack(np.array(list(chain.from_iterable(found)), np.int64)))
        return pa.table({"of": sent.column("of"), "places": sent.column("places"), "lengths": pa.array(lengths, pa.binary()), "ids": pa.array(ids, pa.binary())})

    def assemble(block: pa.Table, encoded: pa.Table) -> pa.Table:
        keys = block.column("keys")[0].values
        pieces, lengths = unpack(block.column("pieces")[0].as_py()), block.column("lengths")[0].values.to_numpy()
        parts = [[unpack(encoded.column(c)[i].as_py()) for c in ("places", "lengths", "ids")] for i in range(encoded.num_rows)]
        size = np.zeros(sum(len(p[0]) for p in parts), np.int32)
        start, flat, at = np.zeros(len(size), np.int64), [], 0
        for places, n, ids in parts:
            size[places], start[places] = n, at + np.cumsum(n) - n
            flat.append(ids.astype(np.int32))
            at += len(ids)
        flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        out = []
        for i in range(0, len(pieces), STEP):
            mine = pieces[i : i + STEP]
            n = size[mine]
            out.append(flat[np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        tokens = np.cumsum(size[pieces], dtype=np.int32)
        ends = np.cumsum(lengths)
        offsets = np.zeros(len(ends) + 1, np.int32)
        offsets[1:][ends > 0] = tokens[ends[ends > 0] - 1]
        values = np.concatenate(out) if out else np.empty(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
        release()
        return pa.table({key: keys, "ids": lists})

    sent = blocks.select(F.col("block").alias("of"), F.explode("chunks").alias("c")).select("of", "c.task", "c.words", "c.places")
    encoded = sent.groupBy("task").applyInArrow(encode_words, "of bigint, places binary, lengths binary, ids binary")
    return (
        blocks.select("block", "keys", "lengths", "pieces").groupBy("block").cogroup(encoded.groupBy("of"))
        .applyInArrow(assemble, f"`{key}` {kind}, ids array<int>")
    )


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its token ids in a binary column ``into``.

    Ids are joined with the table of token bytes, which is as large as the vocabulary and is broadcast: a task
    gathers the bytes of all ids of its rows at once. Null ids give null; an unknown id is an
    error. Nothing is shuffled.
    """
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(shared.value, pa.large_binary())
        for lists in batches:
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            out = []
            for row in lists:
                if not row.is_valid:
                    out.append(None)
                    continue
                found = tokens.take(row.values)
                first, last = (np.frombuffer(found.buffers()[1], np.int64)[found.offset + i] for i in (0, len(found))) if len(found) else (0, 0)
                out.append(found.buffers()[2].slice(first, last - first).to_pybytes() if last > first else b"")
            yield pa.array(out, pa.binary())
        release()

    return encoded.withColumn(into, F.arrow_udf(run, "binary")(F.col(ids)))
