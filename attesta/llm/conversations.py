"""Repair of conversations: cheapest edits that give a conversation a proper order of roles.

A conversation's rows, by turn (nulls first, then by role and text), have a role class (system, user, assistant by
the role's first letter, or other) and a fault: blank, a duplicate of an earlier row, truncated, or none.
A repaired conversation is empty or one system row at most, then user and assistant in turns, an assistant
last. Rows are kept (0), given another role (2) or deleted (3; blank rows and duplicates must be), rows
without text are inserted (2), and a truncated row that stays costs 1 more. Of the cheapest edits those whose
initials (D, I, K, R) come first are taken.

How.  The order of roles is an automaton of four states: nothing yet, after system, after user, after assistant. A
row is a min-plus transfer matrix between them, made of insertions and then its own edit; rows of one class and fault
share a symbol. Sequences of symbols are compressed by Re-Pair: in rounds, the most frequent pairs that do not
compete for a symbol get rules, until no pair occurs twice; what is left of a sequence is paired up to one
symbol. A rule's matrix is the product of its two sides', and its audit a rope: for each entry and exit
the state between both sides. Matrices are worked out bottom-up, all rules of a round at once, and
rules and whole sequences are shared by all conversations that a task meets. Ropes need no comparison of
strings: audits of one entry that lead to different exits are never prefixes of one another, so their order
is that of the first side that differs, and a matrix keeps the ranks of its exits.

Where.  Rows are shuffled once by conversation and stream through sorted; each batch of whole conversations is settled
at once. A conversation above ``LONG`` rows or bytes is never gathered: its rows are range-partitioned in
order, cut to pieces, and each piece gives its matrix, ranks and audits; one narrow row for each piece chooses the
pieces' entries and exits, and a hash streams over the repaired pieces. Both ways give the same rows.

Nulls in roles and texts stand for one space; a null conversation id is a conversation, and null turns come first.
Repeated rows are rows (the later ones duplicates). Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, materialise, small_batches, small_side

BLANKS = "\t\n\x0b\x0c\r "
#: Rows and bytes above which a conversation goes in pieces, rows and bytes of a piece, bytes settled together.
LONG, PIECE, BLOCK_BYTES = (10_000, 32 << 20), (4096, 8 << 20), 8 << 20
#: Rules that a task remembers before it starts anew.
RULES = 200_000
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NOTHING, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
INSERT, DELETE, REROLE, TRUNCATED = 2, 3, 2, 1
GONE, NONE = 8, 1 << 28
#: Where a row of a class may be kept, and what follows; a user or assistant row may be made or inserted likewise.
KEEP = {SYSTEM: {NOTHING: AFTER_SYSTEM}, USER: {NOTHING: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, ASSISTANT: {AFTER_USER: AFTER_ASSISTANT}, OTHER: {}}
MADE = KEEP[USER] | KEEP[ASSISTANT]
ROLE_OF = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
#: What ends a conversation in each state: cost and edits.
CLOSING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _leaf(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest cost and edits of a row from each state to each."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for entry in range(4):
        state = entry
        for inserted in range(3):
            steps = [(DELETE, "D", state)]
            if symbol != GONE:
                cost = symbol % 2 * TRUNCATED
                steps.append((REROLE + cost, "R", MADE[state]))
                if state in KEEP[symbol // 2]:
                    steps.append((cost, "K", KEEP[symbol // 2][state]))
            for cost, edit, exit_ in steps:
                found = (inserted * INSERT + cost, "I" * inserted + edit)
                best[entry, exit_] = min(best.get((entry, exit_), (NONE, "")), found)
            state = MADE[state]
    return best


def _ranks(order: np.ndarray) -> np.ndarray:
    """The places of the last axis' values in ascending order."""
    return np.argsort(np.argsort(order, axis=-1, kind="stable"), axis=-1, kind="stable")


class Grammar:
    """Rules over row symbols, with the transfer matrix, exit ranks and audit rope of each."""

    def __init__(self) -> None:
        leaves = [_leaf(s) for s in range(GONE + 1)]
        self.left, self.right = [np.full(GONE + 1, -1)], [np.full(GONE + 1, -1)]
        cost = np.array([[[x.get((i, j), (NONE,))[0] for j in range(4)] for i in range(4)] for x in leaves])
        order = np.zeros((len(leaves), 4, 4), np.int64)
        self.known: dict[tuple[int, int, int], str] = {}
        for s, x in enumerate(leaves):
            for i in range(4):
                row = sorted(range(4), key=lambda j: (x[i, j][1] if (i, j) in x else "~", j))
                order[s, i, row] = range(4)
            self.known |= {(s, i, j): edits for (i, j), (_, edits) in x.items()}
        self.cost, self.rank, self.between = cost, order, np.zeros_like(cost)
        self.rules: dict[tuple[int, int], int] = {}
        self.whole: dict[bytes, int] = {}

    def rule(self, pairs: np.ndarray) -> np.ndarray:
        """The symbols of the pairs of symbols, with rules made for new ones."""
        keys = [tuple(p) for p in pairs.tolist()]
        new = list(dict.fromkeys(k for k in keys if k not in self.rules))
        if new:
            self.rules.update(zip(new, range(len(self.cost), len(self.cost) + len(new)), strict=True))
            left, right = np.array(new).T
            total = np.minimum(self.cost[left][:, :, :, None] + self.cost[right][:, None, :, :], NONE)
            pick = (total * 4 + self.rank[left][:, :, :, None]).argmin(2)
            cost = np.take_along_axis(total, pick[:, :, None, :], 2)[:, :, 0]
            first = np.take_along_axis(self.rank[left], pick, 2)
            second = self.rank[right][np.arange(len(new))[:, None, None], pick, np.arange(4)]
            order = np.where(cost < NONE, first * 4 + second, 64 + np.arange(4))
            self.cost, self.rank, self.between = np.concatenate([self.cost, cost]), np.concatenate([self.rank, _ranks(order)]), np.concatenate([self.between, pick])
            self.left.append(left)
            self.right.append(right)
        return np.array([self.rules[k] for k in keys], np.int64)

    def compress(self, sequences: list[bytes]) -> None:
        """One symbol for each of the sequences (different and not empty)."""
        flat = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        own = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        while True:
            at = _pairs(flat, own)
            span = len(self.cost)
            found, times = np.unique(flat[at] * span + flat[at + 1], return_counts=True)
            lefts, rights, taken = set(), set(), []
            for k in np.argsort(-times, kind="stable").tolist():
                a, b = divmod(int(found[k]), span)
                if times[k] < 2:
                    break
                if a not in rights and b not in lefts and (a != b or a not in lefts):
                    lefts.add(a)
                    rights.add(b)
                    taken.append(found[k])
            if not taken:
                break
            flat, own = self._replace(flat, own, at[np.isin(flat[at] * span + flat[at + 1], taken)])
        while len(flat) > len(sequences):
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            flat, own = self._replace(flat, own, np.flatnonzero((nth[:-1] % 2 == 0) & (own[:-1] == own[1:])))
        self.whole.update(zip(sequences, flat.tolist(), strict=True))

    def _replace(self, flat: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put rules for the pairs that begin at ``at``, which do not overlap."""
        pairs, nth = np.unique(np.stack([flat[at], flat[at + 1]], 1), axis=0, return_inverse=True)
        flat = flat.copy()
        flat[at] = self.rule(pairs)[nth.ravel()]
        return np.delete(flat, at + 1), np.delete(own, at + 1)

    def symbols(self, sequences: list[bytes]) -> list[int]:
        new = sorted({s for s in sequences if s not in self.whole})
        if new:
            if len(self.cost) > RULES:
                self.__init__()
                new = sorted(set(sequences))
            self.compress(new)
        return [self.whole[s] for s in sequences]

    def audit(self, symbol: int, entry: int, exit_: int) -> str:
        """The edits that a rope stands for."""
        left, right = (np.concatenate(x) if len(x) > 1 else x[0] for x in (self.left, self.right))
        self.left, self.right = [left], [right]
        out, waiting = [], [(symbol, entry, exit_)]
        while waiting:
            x, i, j = waiting.pop()
            if (x, i, j) in self.known:
                out.append(self.known[x, i, j])
            else:
                k = int(self.between[x, i, j])
                waiting += [(int(right[x]), k, j), (int(left[x]), i, k)]
        self.known[symbol, entry, exit_] = "".join(out)
        return self.known[symbol, entry, exit_]

    def close(self, symbol: int) -> tuple[int, str]:
        """Cost and edits of a whole conversation."""
        cost, rank = self.cost[symbol, NOTHING].tolist(), self.rank[symbol, NOTHING].tolist()
        j = min(range(4), key=lambda j: (cost[j] + CLOSING[j][0], rank[j]))
        return cost[j] + CLOSING[j][0], self.audit(symbol, NOTHING, j) + CLOSING[j][1]


def _pairs(flat: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where pairs begin; of equal symbols in a row every second one."""
    inside = own[:-1] == own[1:]
    equal = inside & (flat[:-1] == flat[1:])
    begins = np.flatnonzero(equal & ~np.append(False, equal[:-1]))
    place = np.arange(len(equal))
    since = place - begins[np.searchsorted(begins, place, side="right") - 1] if len(begins) else place
    return np.flatnonzero(inside & ~(equal & (since % 2 == 1)))


_grammar: list[Grammar] = []


def grammar() -> Grammar:
    """The grammar of this worker."""
    if not _grammar:
        _grammar.append(Grammar())
    return _grammar[0]


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults, by a hash of conversation and turn: dropped, emptied, without end marks, repeated, or of role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = or_space(role_col), or_space(text_col)
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.crc32(F.concat_ws(":", or_space(conv_col), or_space(turn_col))) % 20).alias("_pick"))
    role = F.when(F.col("_pick") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("_pick") == 1, "").when(F.col("_pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("_pick") == 0, 0).when(F.col("_pick") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(True), times)).alias("_nth")).drop("_nth")


def marked(rows: DataFrame) -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``mark``: 4 * class + fault (0 none, 1 blank, 3 truncated)."""
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    initial, rest = F.substring("role", 1, 1), F.rtrim(F.col("text"), F.lit(BLANKS))
    cls = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = F.when(rest == "", 1).when(F.substring(rest, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    return rows.withColumn("mark", cls * 4 + fault)


STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
_LINES = "array<struct<edit:string,role:string,text:string>>"
_LINE = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class Pieces:
    """The rows of a batch, cut to consecutive pieces (``at``: where each begins, and the end)."""

    def __init__(self, batch: pa.RecordBatch, at: np.ndarray):
        self.batch, self.at = batch, at
        self.roles, self.texts = batch.column(2), batch.column(3)
        mark = batch.column(4).to_numpy().astype(np.int64)
        self.cls, fault = mark // 4, mark % 4
        self.own = np.repeat(np.arange(len(at) - 1), np.diff(at))
        repeated = batch.column(5).to_numpy(zero_copy_only=False) if batch.num_columns > 5 else self._repeated()
        self.fault = np.where(repeated & (fault != 1), 2, fault)
        turn = batch.column(1)
        self.given, self.turn = turn.is_valid().to_numpy(zero_copy_only=False), turn.fill_null(0).to_numpy()
        self.symbols = np.where((self.fault == 1) | (self.fault == 2), GONE, self.cls * 2 + (self.fault == 3)).astype(np.uint8)

    def _repeated(self) -> np.ndarray:
        """Rows whose role and text an earlier row of their piece has."""
        codes = [c.dictionary_encode().indices.to_numpy().astype(np.int64) for c in (self.roles, self.texts)]
        order = np.lexsort((np.arange(len(self.own)), codes[1], codes[0], self.own))
        out = np.zeros(len(order), bool)
        same = np.ones(max(0, len(order) - 1), bool)
        for x in (self.own, *codes):
            same &= x[order][1:] == x[order][:-1]
        out[order[1:][same]] = True
        return out

    def sequences(self) -> list[bytes]:
        flat = self.symbols.tobytes()
        return [flat[a:b] for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)]

    def stats(self) -> dict[str, np.ndarray]:
        """Counts of each piece by itself."""
        total = lambda hit: np.add.reduceat(np.append(hit, 0).astype(np.int64), self.at[:-1]) if len(self.at) > 1 else np.empty(0, np.int64)
        inside = np.append(self.own[1:] == self.own[:-1], False) if len(self.own) else np.empty(0, bool)
        pair = self.cls * 4 + np.append(self.cls[1:], 0)
        fine = np.isin(pair, [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        same_turn = inside & np.append((self.turn[1:] == self.turn[:-1]) & self.given[:-1], False)
        return {"rows": np.diff(self.at), "blank": total(self.fault == 1), "duplicate": total(self.fault == 2), "truncated": total(self.fault == 3), "illegal": total(inside & ~fine), "turns": total(self.given) - total(same_turn)}

    def ends(self) -> tuple[pa.Array, pa.Array]:
        """Smallest and largest turn of each piece (rows are in order, nulls first)."""
        low = np.minimum.reduceat(np.where(self.given, self.turn, np.iinfo(np.int64).max), self.at[:-1])
        some = np.logical_or.reduceat(self.given, self.at[:-1])
        return pa.array(low, mask=~some), pa.array(self.turn[self.at[1:] - 1], mask=~some)

    def lines(self, audits: list[str], entries: list[int]) -> pa.Array:
        """The repaired rows of each piece."""
        edits, roles, places, ends = [], [], [], [0]
        for begin, audit, state in zip(self.at[:-1].tolist(), audits, entries, strict=True):
            row = begin
            for edit in audit:
                if edit == "D":
                    row += 1
                    continue
                edits.append(edit)
                if edit == "K":
                    state = KEEP[int(self.cls[row])][state]
                    roles.append(None)
                else:
                    state = MADE[state]
                    roles.append(ROLE_OF[state])
                places.append(None if edit == "I" else row)
                row += edit != "I"
            ends.append(len(edits))
        at = pa.array(places, pa.int64())
        role, text = pc.coalesce(pa.array(roles, pa.string()), self.roles.take(at)), self.texts.take(at).fill_null("")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(edits, pa.string()), role, text], fields=list(_LINE)))


def _starts(conv: pa.Array) -> np.ndarray:
    """Where the conversations of rows in order begin, and the end."""
    code = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code)) if len(code) else np.zeros(1, np.int64)


def in_pieces(batches: Iterator[pa.RecordBatch], bound: tuple[int, int]) -> Iterator[Pieces]:
    """Rows in order as pieces of whole conversations; a conversation above the bound of rows and bytes is cut."""
    held: pa.RecordBatch | None = None
    for b in gathered(batches, BLOCK_BYTES):
        held = b if held is None else pa.concat_batches([held, b])
        at = _starts(held.column(0))
        if len(at) > 2:  # the last conversation may go on in the next batch
            yield Pieces(held.slice(0, at[-2]), at[:-1])
            held = held.slice(at[-2])
        if held.num_rows >= bound[0] or held.nbytes >= bound[1]:
            cuts = np.append(np.arange(0, held.num_rows, bound[0]), held.num_rows)
            yield Pieces(held, cuts)
            held = None
    if held is not None and held.num_rows:
        yield Pieces(held, np.append(np.arange(0, held.num_rows, bound[0]), held.num_rows))


def _kind(df: DataFrame, name: str = "conv") -> str:
    return df.schema[name].dataType.simpleString()


def settled(rows: DataFrame) -> DataFrame:
    """One row for each conversation of marked rows: its counts, ``low`` and ``high`` turn, ``cost``, ``audit``, ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in in_pieces(batches, (1 << 62, 1 << 62)):
            found = grammar()
            symbols = found.symbols(p.sequences())
            closed = {s: found.close(s) for s in set(symbols)}
            costs, audits = [closed[s][0] for s in symbols], [closed[s][1] for s in symbols]
            arrays = [p.batch.column(0).take(pa.array(p.at[:-1])), *(pa.array(x.astype(np.int64)) for x in p.stats().values()), *p.ends(), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), p.lines(audits, [NOTHING] * len(audits))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", *STATS, "low", "high", "cost", "audit", "lines"])

    small_batches(rows.sparkSession)
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.repartition("conv").sortWithinPartitions(*order).select("conv", "turn", "role", "text", "mark")
    return dealt.mapInArrow(run, f"conv {_kind(rows)}, {', '.join(f'{s} long' for s in STATS)}, low long, high long, cost long, audit string, lines {_LINES}")


def pieces_of(rows: DataFrame, piece: tuple[int, int]) -> DataFrame:
    """The pieces of long conversations, in order by ``part`` and ``nth``: counts, matrix, audits, and the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        for p in in_pieces(batches, piece):
            found = grammar()
            symbols = found.symbols(p.sequences())
            n = len(symbols)
            audits = [[found.audit(s, i, j) if found.cost[s, i, j] < NONE else None for i in range(4) for j in range(4)] for s in symbols]
            first, last = p.at[:-1], p.at[1:] - 1
            turn = p.batch.column(1)
            raw = pa.ListArray.from_arrays(pa.array(p.at, pa.int32()), pa.StructArray.from_arrays([p.roles, p.texts, pa.array(p.cls)], names=["role", "text", "cls"]))
            arrays = [
                p.batch.column(0).take(pa.array(first)), pa.array([part] * n, pa.int64()), pa.array(np.arange(nth, nth + n)), *(pa.array(x.astype(np.int64)) for x in p.stats().values()), *p.ends(),
                turn.take(pa.array(first)), turn.take(pa.array(last)), pa.array(p.cls[first]), pa.array(p.cls[last]),
                pa.array(found.cost[symbols].reshape(n, 16).tolist(), pa.list_(pa.int64())), pa.array(found.rank[symbols].reshape(n, 16).tolist(), pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), raw,
            ]
            nth += n
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "part", "nth", *STATS, "low", "high", "first_turn", "last_turn", "first_class", "last_class", "costs", "ranks", "audits", "raw"])

    small_batches(rows.sparkSession)
    earlier = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    # Rows of one turn are split at a prefix of the text at most, which agrees with the order within partitions.
    dealt = rows.withColumn("repeated", earlier).repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    return dealt.select("conv", "turn", "role", "text", "mark", "repeated").mapInArrow(
        run,
        f"conv {_kind(rows)}, part long, nth long, {', '.join(f'{s} long' for s in STATS)}, low long, high long, first_turn long, last_turn long, first_class long, last_class long, costs array<long>, ranks array<long>, audits array<string>, raw array<struct<role:string,text:string,cls:long>>",
    )


def chosen(pieces: DataFrame) -> DataFrame:
    """``part``, ``nth``, ``entry``, ``exit`` and the conversation's ``cost`` of each piece, from its matrix and ranks alone."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("nth", "ascending")])
        cost, rank = (np.array(group[c].to_pylist(), np.int64).reshape(-1, 4, 4) for c in ("costs", "ranks"))
        rest = [np.array([c for c, _ in CLOSING])]
        for m in cost[::-1]:
            rest.append((m + rest[-1][None, :]).min(1))
        rest.reverse()
        state, entries, exits = NOTHING, [], []
        for m, r, after in zip(cost, rank, rest[1:], strict=True):
            total = m[state] + after
            entries.append(state)
            state = min(np.flatnonzero(total == total.min()).tolist(), key=lambda j: r[entries[-1], j])
            exits.append(state)
        n = len(entries)
        held = pa.array(np.arange(n) == n - 1)
        return pa.table({"part": group["part"], "nth": group["nth"], "entry": pa.array(entries, pa.int64()), "exit": pa.array(exits, pa.int64()), "last": held, "cost": pa.array([int(rest[0][NOTHING])] * n, pa.int64())})

    return pieces.select("conv", "part", "nth", "costs", "ranks").groupBy("conv").applyInArrow(run, "part long, nth long, entry long, exit long, last boolean, cost long")


def repaired_pieces(pieces: DataFrame, choice: DataFrame) -> DataFrame:
    """Each piece's ``audit`` and repaired ``lines``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                rows = one.column("raw").flatten()
                n = len(rows)
                held = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), rows.field("role"), rows.field("text"), pc.multiply(rows.field("cls"), 4), pa.array(np.zeros(n, bool))], list("abcdef"))
                lines = Pieces(held, np.array([0, n])).lines(one.column("audit").to_pylist(), one.column("entry").to_pylist())
                yield pa.RecordBatch.from_arrays([one.column(c) for c in ("conv", "part", "nth", "audit")] + [lines], ["conv", "part", "nth", "audit", "lines"])

    closing = F.element_at(F.array(*[F.lit(e) for _, e in CLOSING]), (F.col("exit") + 1).cast("int"))
    audit = F.concat(F.element_at("audits", (F.col("entry") * 4 + F.col("exit") + 1).cast("int")), F.when(F.col("last"), closing).otherwise(""))
    held = pieces.select("conv", "part", "nth", "audits", "raw").join(choice, ["part", "nth"]).select("conv", "part", "nth", audit.alias("audit"), "entry", "raw")
    return held.mapInArrow(run, f"conv {_kind(pieces)}, part long, nth long, audit string, lines {_LINES}")


def joined(lines: Column) -> Column:
    """Repaired rows as text: ``role:text``, a line each."""
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def _hashed(parts: DataFrame) -> DataFrame:
    """``conv`` and the ``sha`` of its pieces' texts one after another, as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, digest = None, False, None
        some = False
        for b in batches:
            for i, text in enumerate(b.column(1)):
                conv = b.column(0).slice(i, 1)
                if not begun or conv != now:
                    if begun:
                        yield pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()])], ["conv", "sha"])
                    now, begun, digest, some = conv, True, hashlib.sha256(), False
                if body := text.as_py().encode():
                    digest.update(b"\n" + body if some else body)
                    some = True
        if begun:
            yield pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()])], ["conv", "sha"])

    dealt = parts.select("conv", "part", "nth", joined(F.col("lines")).alias("body")).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part", "nth")
    return dealt.select("conv", "body").mapInArrow(run, f"conv {_kind(parts)}, sha string")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


class Repair:
    """The repair of a table of ``conv_id``, ``turn``, ``role``, ``text``."""

    def __init__(self, rows: DataFrame, long: tuple[int, int] = LONG, piece: tuple[int, int] = PIECE):
        rows = marked(rows)
        sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
        large = materialise(sizes.where((F.col("n") > long[0]) | (F.col("bytes") > long[1])).select(F.col("conv").alias("_long")), "long-conversations")
        self.any_long = bool(large.take(1))
        self.pieces = self.choice = None
        if self.any_long:
            large = small_side(large)
            self.pieces = materialise(pieces_of(rows.join(large, _same("conv", "_long"), "left_semi"), piece), "conversation-pieces")
            self.choice = materialise(chosen(self.pieces), "piece-choices")
            rows = rows.join(large, _same("conv", "_long"), "left_anti")
        self.short = settled(rows)

    def _long_lines(self) -> DataFrame:
        return repaired_pieces(self.pieces, self.choice)

    def lines(self) -> DataFrame:
        """Every repaired row: ``conv_id``, ``piece`` (in order, from 0), ``line`` (in the piece, from 0), ``edit``, ``role``, ``text``."""
        parts = self.short.select("conv", F.lit(0).alias("piece"), "lines")
        if self.any_long:
            nth = F.row_number().over(Window.partitionBy("conv").orderBy("part", "nth")) - 1
            parts = parts.union(self._long_lines().select("conv", nth.alias("piece"), "lines"))
        return parts.select(F.col("conv").alias("conv_id"), "piece", F.posexplode("lines").alias("line", "_row")).select("conv_id", "piece", "line", "_row.edit", "_row.role", "_row.text")

    def report(self) -> DataFrame:
        """One row for each conversation: its faults, the repair's ``cost`` and ``audit``, and ``repaired_sha256``."""
        short = self.short.select("conv", *STATS[1:], "low", "high", "cost", "audit", F.sha2(joined(F.col("lines")), 256).alias("sha"))
        found = short if not self.any_long else short.union(self._long_report().select(short.columns))
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
        return found.select(F.col("conv").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256"))

    def _long_report(self) -> DataFrame:
        before = Window.partitionBy("conv").orderBy("part", "nth")
        last_class, last_turn = F.lag("last_class").over(before), F.lag("last_turn").over(before)
        fine = [(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)]
        legal = reduce(lambda a, b: a | b, ((F.col("_last") == x) & (F.col("first_class") == y) for x, y in fine))
        seam = self.pieces.select("conv", *STATS, "low", "high", "first_turn", "first_class", last_class.alias("_last"), last_turn.alias("_turn"))
        seam = seam.withColumn("illegal", F.col("illegal") + (F.col("_last").isNotNull() & ~F.coalesce(legal, F.lit(False))).cast("long"))
        seam = seam.withColumn("turns", F.col("turns") - F.coalesce(F.col("_turn") == F.col("first_turn"), F.lit(False)).cast("long"))
        sums = seam.groupBy("conv").agg(*(F.sum(s).alias(s) for s in STATS[1:]), F.min("low").alias("low"), F.max("high").alias("high"))
        parts = materialise(self._long_lines(), "repaired-pieces")
        audits = parts.join(self.choice.select("part", "nth", "cost"), ["part", "nth"]).groupBy(F.col("conv").alias("_conv")).agg(F.max("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "nth", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        shas = _hashed(parts).withColumnRenamed("conv", "_own")
        return sums.join(audits, _same("conv", "_conv")).join(shas, _same("conv", "_own"))
