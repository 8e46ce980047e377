"""Repair of conversation structure as a shortest path over an integer-cost lattice, found by an auction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.common import write_shared
from nearloom.session import cut_lineage

# Costs of the edits; a truncated turn that is not deleted costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States of the roles given so far: none, a system turn, a user turn, an assistant turn.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
# Turns of a conversation that are gathered in one row, and bytes of their texts; longer ones are cut into segments.
GATHER_TURNS, GATHER_BYTES = 2048, 8 << 20
# Least turns of a segment.
SEGMENT = 1024
# Turns of the lattice that are solved at a time.
LAYERS = 32


def _arcs(symbol: str, q: int) -> tuple[tuple[str, int, int, int], ...]:
    """``letter, cost, turns read, state`` of the edits before a turn, by letter; a letter leads to one state only."""
    step = AFTER[q]
    out = [("D", DELETE, 1, q), ("I", INSERT, 0, step.get("u") or step["a"])]
    if symbol != "d":
        extra = 0 if symbol.islower() else TRUNCATED
        kept = step.get(symbol.lower())
        if kept is not None:
            out.append(("K", extra, 1, kept))
        out.append(("R", REROLE + extra, 1, step.get("u") or step["a"]))
    return tuple(out)


ARCS = {symbol: [_arcs(symbol, q) for q in range(4)] for symbol in "suaoSUAOd"}


class _Lattice:
    """Nodes ``(turns read, state)`` of a run of turns, with prices that never exceed the distance to the end.

    ``exits`` are the exact prices of the states after the last turn. Prices start from the cheapest edit of every
    turn still to come, which no path can undercut, so every arc satisfies price <= cost + price of its head.
    """

    def __init__(self, symbols: str, exits: list[int]):
        self.symbols, n = symbols, len(symbols)
        least = min(exits)
        self.price = [[0] * 4 for _ in range(n)] + [list(exits)]
        self.exact = [[False] * 4 for _ in range(n)] + [[True] * 4]
        for i in range(n - 1, -1, -1):
            least += 0 if symbols[i] in "suao" else DELETE
            self.price[i] = [least] * 4

    def settle(self, i: int, q: int) -> None:
        """Auction from a node: the path's last price rises to its best offer and the path contracts, or the path
        extends along the best arc, until it meets a node of exact price; then all its prices are exact."""
        price, exact = self.price, self.exact
        path = [(i, q)]
        while True:
            i, q = path[-1]
            if exact[i][q]:
                break
            offer, step, r = min((c + price[i + step][r], step, r) for _, c, step, r in ARCS[self.symbols[i]][q])
            if price[i][q] < offer:
                price[i][q] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append((i + step, r))
        for i, q in path:
            exact[i][q] = True

    def trace(self, q: int) -> tuple[str, int]:
        """Letters of the ASCII-least shortest path from the first layer, and the state it ends in.

        An arc is tight if the prices of both ends differ by its cost; the price of its head is settled first where
        it may still be too low.
        """
        i, letters = 0, []
        self.settle(0, q)
        while i < len(self.symbols):
            for letter, cost, step, r in ARCS[self.symbols[i]][q]:
                if self.price[i][q] == cost + self.price[i + step][r]:
                    self.settle(i + step, r)
                    if self.price[i][q] == cost + self.price[i + step][r]:
                        break
            letters.append(letter)
            i, q = i + step, r
        return "".join(letters), q


def _closing(q: int) -> str:
    """Insertions after the last turn."""
    out = ""
    while q not in ENDS:
        q = AFTER[q].get("u") or AFTER[q]["a"]
        out += "I"
    return out


@lru_cache(maxsize=1 << 16)
def solve(symbols: str) -> tuple[str, int]:
    """Cheapest edits of a conversation, ASCII-least among equals, and their cost.

    ``symbols`` has a letter for each turn: the initial of its role (``o`` for any other than s, u, a), in upper case if
    the turn is truncated, or ``d`` if it has to go. Exact prices of the states are carried backwards over runs of
    ``LAYERS`` turns, then every run is traced forwards, so memory beyond the letters is that of a run.
    """
    cuts = range(0, max(len(symbols), 1), LAYERS)
    prices = [[INSERT * len(_closing(q)) for q in range(4)]]
    for low in reversed(cuts):
        lattice = _Lattice(symbols[low : low + LAYERS], prices[-1])
        for q in range(4):
            lattice.settle(0, q)
        prices.append(lattice.price[0])
    prices.reverse()
    audit, q = [], 0
    for k, low in enumerate(cuts):
        letters, q = _Lattice(symbols[low : low + LAYERS], prices[k + 1]).trace(q)
        audit.append(letters)
    return "".join(audit) + _closing(q), prices[0][0]


def apply(symbols: str, audit: str, q: int = 0) -> tuple[list[int], list[str | None], int]:
    """The turns that edits give from state ``q`` on: number of the turn or -1, new role or None, and the state after them."""
    i, sources, roles = 0, [], []
    for letter in audit:
        if letter != "D":
            role = symbols[i].lower() if letter == "K" else "u" if "u" in AFTER[q] else "a"
            q = AFTER[q][role]
            sources.append(-1 if letter == "I" else i)
            roles.append(None if letter == "K" else NAMES[role])
        i += letter != "I"
    return sources, roles, q


def _solved(symbols: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([solve(s) for s in symbols], columns=["audit", "cost"])


def _applied(symbols: pd.Series, audit: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([apply(s, a)[:2] for s, a in zip(symbols, audit)], columns=["sources", "roles"])


def _faults(text: Column, again: Column) -> Column:
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate")
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )


def _symbol(initial: Column, fault: Column) -> Column:
    return F.when(fault.isin("blank", "duplicate"), "d").when(fault == "truncated", F.upper(initial)).otherwise(initial)


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _counts() -> list[Column]:
    return [F.count_if(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")]


def _gaps(distinct: Column) -> Column:
    """Numbers missing between the first and the last turn; null beyond 64 bits."""
    wide = [F.coalesce(c, F.lit(0)).cast("decimal(38,0)") for c in (F.col("high"), F.col("low"), distinct)]
    return F.when(F.col("high").isNull(), F.lit(0).cast("long")).otherwise((wide[0] - wide[1] + 1 - wide[2]).try_cast("long"))


def _summary(solved: DataFrame, *more: Column) -> DataFrame:
    # Every pair but su, ua and au is illegal; pairs overlap.
    pairs = F.length("initials") - 1 - F.regexp_count("initials", F.lit("(?=su|ua|au)"))
    return solved.select(
        "conv", "gaps", "blank", "duplicate", "truncated", F.greatest(pairs, F.lit(0)).cast("long").alias("illegal"),
        "solved.cost", "solved.audit", *more,
    )


@dataclass
class Repair:
    """``summary``: a row per conversation, its repaired turns as one text hashed; ``turns``: the repaired turns."""

    summary: DataFrame
    turns: DataFrame


def _gathered(rows: DataFrame) -> Repair:
    """Conversations of bounded size, each in one row."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumns({"at": F.row_number().over(order), "initial": _initial(F.col("role"))})
    same = Window.partitionBy("conv", "role", "text").orderBy("at")
    placed = placed.withColumn("nth", F.row_number().over(same))
    placed = placed.withColumn("fault", _faults(F.col("text"), F.col("nth") > 1))
    placed = placed.withColumn("symbol", _symbol(F.col("initial"), F.col("fault")))
    whole = placed.groupBy("conv").agg(
        *_counts(), F.max("turn").alias("high"), F.min("turn").alias("low"),
        F.array_sort(F.collect_list(F.struct("at", "turn", "symbol", "initial", "role", "text"))).alias("items"),
    )
    part = lambda c: F.array_join(F.transform("items", lambda x: x[c]), "")
    distinct = F.size(F.array_distinct(F.array_compact(F.transform("items", lambda x: x["turn"]))))
    whole = whole.withColumns({"symbols": part("symbol"), "initials": part("initial"), "gaps": _gaps(distinct)})
    whole = whole.withColumn("solved", F.pandas_udf(_solved, "audit string, cost bigint")("symbols"))
    whole = whole.withColumn("edits", F.pandas_udf(_applied, "sources array<int>, roles array<string>")("symbols", "solved.audit"))
    made = F.zip_with("edits.sources", "edits.roles", lambda i, role: F.struct(
        F.when(i < 0, role).otherwise(F.coalesce(role, F.get("items", i)["role"])).alias("role"),
        F.when(i < 0, "").otherwise(F.get("items", i)["text"]).alias("text"),
    ))
    whole = whole.withColumn("made", made)
    text = F.array_join(F.transform("made", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    turns = whole.select("conv", F.posexplode("made").alias("place", "turn"))
    return Repair(
        _summary(whole, F.sha2(text.cast("binary"), 256).alias("repaired_sha256")),
        turns.select("conv", F.col("place").cast("long").alias("place"), "turn.role", "turn.text"),
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, their place in the order of conversations and turns: a range sort, counted by partition."""
    placed = write_shared(
        rows.sort("conv", F.col("turn").asc_nulls_first(), "role", "text").withColumn("_id", F.monotonically_increasing_id())
    )
    part, own = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("at", F.col("_start") + own).drop("_part", "_start", "_id")


def _cut_edits(symbols: pd.Series, audit: pd.Series, length: pd.Series) -> pd.Series:
    def cut(symbols: str, audit: str, length: int) -> list[dict]:
        out, at, q, place = [], 0, 0, 0
        for segment, low in enumerate(range(0, len(symbols), length)):
            mine = symbols[low : low + length]
            end, read = at, 0
            while end < len(audit) and (read < len(mine) or low + length >= len(symbols)):
                read += audit[end] != "I"
                end += 1
            edits, state = audit[at:end], q
            sources, _, q = apply(mine, edits, q)
            out.append({"segment": segment, "state": state, "place": place, "symbols": mine, "edits": edits})
            place, at = place + len(sources), end
        return out

    return pd.Series([cut(s, a, int(n)) for s, a, n in zip(symbols, audit, length)])


def _segment_turns(symbols: pd.Series, edits: pd.Series, state: pd.Series, place: pd.Series) -> pd.Series:
    def made(s: str, e: str, q: int, place: int) -> list[dict]:
        sources, roles, _ = apply(s, e, q)
        return [{"place": place + k, "item": i, "role": r} for k, (i, r) in enumerate(zip(sources, roles))]

    return pd.Series([made(*row) for row in zip(symbols, edits, state, place)])


def _digests(turns: DataFrame) -> DataFrame:
    """``conv, repaired_sha256``: turns stream through the digest in their order, so a task holds a batch of them."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last, started = hashlib.sha256(), None, False

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv": pa.array([last], kinds[0]), "repaired_sha256": [digest.hexdigest()]})

        kinds = []
        for b in batches:
            kinds = [b.schema.field("conv").type]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if started and conv != last:
                    yield done()
                    digest = hashlib.sha256()
                digest.update(((b"\n" if started and conv == last else b"") + f"{role}:{text}".encode()))
                last, started = conv, True
        if started:
            yield done()

    ordered = turns.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "role", "text")
    return ordered.mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _segmented(rows: DataFrame) -> Repair:
    """Conversations beyond the bound: turns are numbered by a range sort and their letters gathered by segments.

    Only a letter for each turn meets in one row (as the audit does by definition); texts stay where they are until the
    digest, which reads a conversation's turns as a stream. A segment has at most about the root of a conversation's turns.
    """
    numbered = cut_lineage(_numbered(rows).withColumn("same", F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)))
    firsts = numbered.groupBy("conv", "same").agg(F.min("at").alias("first"))
    starts = numbered.groupBy("conv").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    length = F.greatest(F.lit(SEGMENT), F.ceil(F.sqrt("n")))
    placed = numbered.join(firsts, ["conv", "same"]).join(starts.withColumn("length", length.cast("long")), "conv")
    placed = placed.withColumns({"initial": _initial(F.col("role")), "fault": _faults(F.col("text"), F.col("at") > F.col("first"))})
    own = F.col("at") - F.col("start")
    placed = cut_lineage(placed.withColumns({
        "symbol": _symbol(F.col("initial"), F.col("fault")), "segment": F.floor(own / F.col("length")),
        "item": (own % F.col("length")).cast("int"),
    }).select("conv", "turn", "role", "text", "length", "segment", "item", "symbol", "initial", "fault"))
    joined = lambda of, c: F.array_join(F.transform(F.array_sort(of), lambda x: x[c]), "")
    parts = placed.groupBy("conv", "length", "segment").agg(
        *_counts(), F.max("turn").alias("high"), F.min("turn").alias("low"), F.collect_list(F.struct("item", "symbol", "initial")).alias("items"),
    )
    parts = parts.withColumns({c + "s": joined("items", c) for c in ("symbol", "initial")}).drop("items")
    whole = parts.groupBy("conv", "length").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.max("high").alias("high"), F.min("low").alias("low"),
        F.collect_list(F.struct("segment", "symbols", "initials")).alias("items"),
    )
    whole = whole.withColumns({c: joined("items", c) for c in ("symbols", "initials")}).drop("items")
    distinct = placed.select("conv", "turn").filter(F.col("turn").isNotNull()).distinct().groupBy("conv").agg(F.count(F.lit(1)).alias("turns"))
    whole = whole.join(distinct, "conv", "left").withColumn("gaps", _gaps(F.col("turns"))).withColumn("solved", F.pandas_udf(_solved, "audit string, cost bigint")("symbols"))
    whole = cut_lineage(whole)
    cut = whole.select("conv", F.explode(F.pandas_udf(_cut_edits, "array<struct<segment:bigint,state:int,place:bigint,symbols:string,edits:string>>")("symbols", "solved.audit", "length")).alias("s")).select("conv", "s.*")
    made = cut.select("conv", "segment", F.explode(F.pandas_udf(_segment_turns, "array<struct<place:bigint,item:int,role:string>>")("symbols", "edits", "state", "place")).alias("t"))
    made = made.select("conv", "segment", "t.place", "t.item", F.col("t.role").alias("new_role"))
    turns = made.join(placed.select("conv", "segment", "item", "role", "text"), ["conv", "segment", "item"], "left").select(
        "conv", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    empty = hashlib.sha256().hexdigest()
    summary = whole.join(_digests(turns), "conv", "left")
    return Repair(_summary(summary, F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")), turns)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Faults of conversations and their cheapest repair to roles ``(system? (user assistant)+)?``.

    Turns are read by number, nulls first, then by role and text. The first fault of a turn counts: blank,
    duplicate (same role and text earlier in the conversation), truncated (no ``.``, ``!`` or ``?`` at the end).
    Keeping a turn is free, a new role costs 1, deletion 2 (required for blank and duplicate turns), an empty new
    turn 5, and a truncated turn that stays 5. Of equally cheap edits those whose initials
    are ASCII-least are taken.

    ``summary`` has ``conv`` and longs ``gaps`` (numbers missing between the least and the largest turn; null beyond 64
    bits), ``blank``, ``duplicate``, ``truncated``, ``illegal`` (neighbours whose role initials are not su, ua or au), ``cost``,
    then ``audit`` and ``repaired_sha256``; ``turns`` has ``conv, place, role, text``. Null roles and texts count as one space, null
    conversations are one. Repeated rows are turns of their own. An empty table gives no rows; other columns are not looked at.

    Prices depend on a conversation's letters only, so a task solves each distinct row of letters once however often it
    occurs. A conversation beyond ``GATHER_TURNS`` or ``GATHER_BYTES`` is cut into segments that many tasks read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = rows.schema[conv].dataType.simpleString()
    rows = rows.select(F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    large = cut_lineage(sizes.filter((F.col("n") > GATHER_TURNS) | (F.col("bytes") > GATHER_BYTES)).select("conv"))
    out = lambda df: df.withColumn("conv", F.col("conv.id").cast(kind))
    if large.isEmpty():
        found = _gathered(rows)
        return Repair(out(found.summary), out(found.turns))
    small, cut = _gathered(rows.join(large, "conv", "left_anti")), _segmented(rows.join(large, "conv", "left_semi"))
    return Repair(out(small.summary.unionByName(cut.summary)), out(small.turns.unionByName(cut.turns)))


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults by a hash of conversation and turn: a turn is dropped, emptied, cut short, repeated or
    given to the user. Null ids count as one space in the hash, null roles and texts are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", blank(conv), blank(turn))), F.lit(20))
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank(text), "[.!?]", "")).otherwise(blank(text))
    made = rows.select(
        conv, turn, F.when(kind == 4, "user").otherwise(blank(role)).alias(role), said.alias(text), kind.alias("_kind")
    ).filter(F.col("_kind") != 0)
    return made.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")
