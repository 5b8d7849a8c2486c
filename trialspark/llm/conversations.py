"""Repair of the structure of conversations at the least cost, by a run-length dynamic programme.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Each row is one of nine symbols: a row that must go, or
the initial of its role with or without a cut-off text. A symbol is a min-plus matrix over four places in the pattern, so
equal neighbours collapse into a run that cached binary powers of the matrix cross in a logarithmic number of steps, and
pieces of a conversation can be worked on apart: rows are sorted over all partitions, only the first and the last
conversation of a partition can go on elsewhere, and their matrices are joined on the driver, two for each partition.

The registry stores no conversations, so this operator is general.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.ordered import join_on
from trialspark.session import checkpointed

DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1  # costs; keeping is free
VISIBLE, END = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
NONE = 1 << 60
EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # places in the pattern; a conversation may end in the first and the last
FOLLOW = (USER, USER, ASSISTANT, USER)  # where an inserted or renamed row leads
ROLES = {USER: "user", ASSISTANT: "assistant"}
DONE = (0, 2 * INSERT, INSERT, 0)  # what is still to be inserted at the end
MUST_GO = 0  # symbol; the others are 1 + 2 * initial (other, s, u, a) + cut off
POSITIONS = 33  # bits that number the rows of a partition
CACHED_RUNS = 48  # conversations of so few runs are solved once for all that look alike


class Repair(NamedTuple):
    report: DataFrame
    transcript: DataFrame


# -- the min-plus algebra ----------------------------------------------------------------------------------------------


def _kept(initial: int, place: int) -> int | None:
    """The place after keeping a row, or None where it may not stand."""
    if initial == SYSTEM:
        return SYSTEM if place == EMPTY else None
    return initial if initial and FOLLOW[place] == initial else None


def _row_matrix(symbol: int) -> list[list[int]]:
    """The cost of one row, insertions before it included, from each place to each place."""
    out = [[NONE] * 4 for _ in range(4)]
    for start in range(4):
        place, paid = start, 0
        for _ in range(4):  # further insertions only come back to a place at a higher cost
            out[start][place] = min(out[start][place], paid + DELETE)
            if symbol != MUST_GO:
                initial, cut = divmod(symbol - 1, 2)
                after = _kept(initial, place)
                if after is not None:
                    out[start][after] = min(out[start][after], paid + cut * CUT_OFF)
                renamed = FOLLOW[place]
                out[start][renamed] = min(out[start][renamed], paid + REROLE + cut * CUT_OFF)
            place, paid = FOLLOW[place], paid + INSERT
    return out


def _product(a, b):
    return [[min(NONE, min(a[i][k] + b[k][j] for k in range(4))) for j in range(4)] for i in range(4)]


def _before(matrix, after) -> tuple[int, ...]:
    """The least cost to the end from each place before the rows of ``matrix``."""
    a, b, c, d = after
    return tuple(min(r[0] + a, r[1] + b, r[2] + c, r[3] + d) for r in matrix)


@lru_cache(maxsize=None)  # nine symbols times 63 powers
def _power(symbol: int, k: int):
    """The matrix of ``2 ** k`` rows of one symbol."""
    return _row_matrix(symbol) if not k else _product(_power(symbol, k - 1), _power(symbol, k - 1))


def _before_run(symbol: int, length: int, after) -> tuple[int, ...]:
    for k in range(length.bit_length()):
        if length >> k & 1:
            after = _before(_power(symbol, k), after)
    return after


def run_matrix(runs) -> list[list[int]]:
    """The min-plus matrix of a sequence of runs (symbol, length)."""
    columns = []
    for j in range(4):
        after = tuple(0 if i == j else NONE for i in range(4))
        for symbol, length in reversed(runs):
            after = _before_run(symbol, length, after)
        columns.append([min(NONE, v) for v in after])
    return [list(row) for row in zip(*columns, strict=True)]


def solve(runs, start: int, after):
    """(audit, end, cost, rows, places): the cheapest edits from ``start``, of equal ones the least audit in ASCII order.

    ``after`` holds the least cost of what follows for each place. ``rows`` numbers the row behind every row put out (-1 for
    an inserted one) and ``places`` holds where in the pattern it stands, negative where its role was changed.
    """
    ends = [after]
    for symbol, length in reversed(runs):
        ends.append(_before_run(symbol, length, ends[-1]))
    ends.reverse()
    place, audit, rows, places, row = start, [], [], [], 0
    insert = lambda: (audit.append("I"), rows.append(-1), places.append(FOLLOW[place]))
    for at, (symbol, length) in enumerate(runs):
        if symbol == MUST_GO:  # deleting changes no place, so it is never worse to do it first, and D comes first
            audit.append("D" * length)
            row += length
            continue
        initial, cut = divmod(symbol - 1, 2)
        steps = [ends[at + 1]]
        for _ in range(length):
            steps.append(_before(_power(symbol, 0), steps[-1]))
        for here, rest in pairwise(reversed(steps)):
            while True:
                if here[place] == DELETE + rest[place]:
                    audit.append("D")
                    break
                if here[place] == INSERT + here[FOLLOW[place]]:
                    insert()
                    place = FOLLOW[place]
                    continue
                kept = _kept(initial, place)
                rows.append(row)
                if kept is not None and here[place] == cut * CUT_OFF + rest[kept]:
                    audit.append("K")
                    place = kept
                    places.append(place)
                else:
                    audit.append("R")
                    place = FOLLOW[place]
                    places.append(-place)
                break
            row += 1
    if after == DONE:
        while DONE[place]:
            insert()
            place = FOLLOW[place]
    return "".join(audit), place, ends[0][start], np.array(rows, np.int64), np.array(places, np.int8)


_cached = lru_cache(maxsize=1 << 14)(solve)


# -- rows, pieces of conversations, and their joints -------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(0)


def _rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(k, t, role, text) and hashes: (d1, d2) of conversation, role and text, (e1, e2) of the turn as well."""
    own = turns.select(F.col(key).alias("k"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    said = [F.col("k").isNull(), F.col("k"), F.col("role"), F.col("text")]
    own = own.withColumns({"d1": F.xxhash64(F.lit(1), *said), "d2": F.xxhash64(F.lit(2), *said)})
    where = [F.col("d1"), F.col("d2"), F.col("t").isNull(), F.col("t")]
    return own.withColumns({"e1": F.xxhash64(F.lit(3), *where), "e2": F.xxhash64(F.lit(4), *where)})


def _laid_out(rows: DataFrame) -> DataFrame:
    """One short row for each distinct row, sorted over all partitions by conversation and turn, and stored so.

    ``n`` counts equal rows of one turn, ``fresh`` tells whether role and text stand here first in the conversation.
    """
    blank = ~F.col("text").rlike(VISIBLE)
    short = rows.select("k", "t", "d1", "d2", "e1", "e2", blank.alias("blank"), _initial(F.col("role")).cast("byte").alias("initial"),
                        (~blank & ~F.col("text").rlike(END)).alias("cut"))
    rest = [c for c in short.columns if c not in ("e1", "e2")]
    one = short.groupBy("e1", "e2").agg(*(F.first(c).alias(c) for c in rest), F.count("*").alias("n"))
    first = one.groupBy("d1", "d2").agg(F.min(F.struct(F.col("t").isNotNull().alias("known"), "t")).alias("at"))
    where = [F.col("d1"), F.col("d2"), ~F.col("at.known"), F.col("at.t")]
    first = first.select(F.xxhash64(F.lit(3), *where).alias("e1"), F.xxhash64(F.lit(4), *where).alias("e2"), F.lit(True).alias("fresh"))
    order = [F.col("k").asc_nulls_first(), F.col("t").asc_nulls_first(), "d1", "d2"]
    laid = one.join(first, ["e1", "e2"], "left").repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpointed(laid.select(
        "k", F.xxhash64(F.col("k").isNull(), "k").alias("c"), "t", "e1", "e2", "initial", "cut", "blank", "n",
        F.coalesce("fresh", F.lit(False)).alias("fresh"), F.monotonically_increasing_id().alias("pos")))


class _Rows:
    """The columns of one or more whole pieces of conversations as arrays, with the places where a piece starts."""

    def __init__(self, batch: pa.RecordBatch, last: bool):
        column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.batch, self.last = batch, last
        self.c, self.n, self.pos = column("c"), column("n"), column("pos")
        self.initial, self.blank = column("initial").astype(np.int64), column("blank")
        t = batch.column("t")
        self.dated, self.t = t.is_valid().to_numpy(zero_copy_only=False), t.fill_null(0).to_numpy()
        self.fresh = column("fresh") & ~self.blank
        self.cut = column("cut") & self.fresh
        self.starts = np.flatnonzero(np.concatenate(([True], self.c[1:] != self.c[:-1])))
        self.stops = np.append(self.starts[1:], len(self.c))
        # a fresh row stands alone, its copies and all other rows must go
        symbol, length = np.zeros((len(self.c), 2), np.int64), np.zeros((len(self.c), 2), np.int64)
        symbol[:, 0] = np.where(self.fresh, 1 + 2 * self.initial + self.cut, MUST_GO)
        length[:, 0], length[:, 1] = np.where(self.fresh, 1, self.n), np.where(self.fresh, self.n - 1, 0)
        some = length.ravel() > 0
        symbol, length, conv = symbol.ravel()[some], length.ravel()[some], np.repeat(np.cumsum(np.bincount(self.starts, minlength=len(self.c))), 2)[some]
        edge = np.flatnonzero(np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (conv[1:] != conv[:-1]))))
        self._symbol, self._length = symbol[edge].tolist(), np.add.reduceat(length, edge).tolist()
        self._run = np.searchsorted(conv[edge], np.arange(1, len(self.starts) + 2))

    def runs(self, i: int):
        a, b = self._run[i], self._run[i + 1]
        return tuple(zip(self._symbol[a:b], self._length[a:b], strict=True))

    def ends(self, i: int):
        """The last turn, if it has one, and the last initial of a piece; and the same of its first row."""
        side = lambda j: (int(self.t[j]) if self.dated[j] else None, int(self.initial[j]))
        return side(self.starts[i]), side(self.stops[i] - 1)


def _pieces(batches):
    """Whole pieces: the last conversation of a batch waits for its rest."""
    held: list[pa.RecordBatch] = []

    def joined():
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        c = batch.column("c").to_numpy()
        turn = np.flatnonzero(c != c[-1])
        edge = int(turn[-1]) + 1 if len(turn) else 0
        if edge or held and held[-1].column("c")[-1].as_py() != c[0]:
            held.append(batch.slice(0, edge))
            yield _Rows(joined(), False)
            held = []
        held.append(batch.slice(edge))
    if held:
        yield _Rows(joined(), True)


def _edges(batches, visit):
    """``visit`` for the first and the last piece of a partition, each once; no more than two rows are put out."""
    first, waiting = True, None
    for rows in _pieces(batches):
        if first:
            yield visit(rows, 0)
        waiting = (rows, len(rows.starts) - 1) if not first or len(rows.starts) > 1 else None
        first = False
    if waiting:
        yield visit(*waiting)


def _joints(laid: DataFrame) -> dict[tuple[int, int], dict]:
    """For each piece of a conversation that lies in several partitions: where it starts and what follows it."""

    def summary(rows, i):
        matrix, ends = run_matrix(rows.runs(i)), rows.ends(i)
        return {"part": int(rows.pos[0]) >> POSITIONS, "c": int(rows.c[rows.starts[i]]), "at": int(rows.pos[rows.starts[i]]), "matrix": sum(matrix, []),
                "first": ends[0][0], "first_initial": ends[0][1], "last": ends[1][0], "last_initial": ends[1][1]}

    kind = "part long, c long, at long, matrix array<bigint>, first long, first_initial long, last long, last_initial long"
    schema = pa.schema([(n, pa.list_(pa.int64()) if n == "matrix" else pa.int64()) for n in (f.split()[0] for f in kind.split(", "))])
    found = laid.mapInArrow(lambda b: (pa.RecordBatch.from_pylist([r], schema) for r in _edges(b, summary)), kind).collect()
    chains, found = [], sorted(found, key=lambda r: r["at"])
    for r in found:
        if chains and chains[-1][-1]["c"] == r["c"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    joints = {}
    for chain in (c for c in chains if len(c) > 1):
        after = DONE
        for i in reversed(range(len(chain))):
            matrix, before = np.array(chain[i]["matrix"]).reshape(4, 4).tolist(), chain[i - 1] if i else None
            joints[chain[i]["part"], chain[i]["c"]] = {"after": after, "turn": before and before["last"], "initial": before and before["last_initial"],
                                                       "first": not i, "start": EMPTY, "offset": 0}
            after = _before(matrix, after)
    if not joints:
        return joints

    def ending(rows, i):
        part, c = int(rows.pos[0]) >> POSITIONS, int(rows.c[rows.starts[i]])
        joint, out = joints.get((part, c)), []
        for start in range(4) if joint else ():
            _, end, _, put, _ = solve(rows.runs(i), start, joint["after"])
            out.append({"part": part, "c": c, "start": start, "end": end, "rows": len(put)})
        return out

    kind = "part long, c long, start long, end long, rows long"
    schema = pa.schema([(n, pa.int64()) for n in (f.split()[0] for f in kind.split(", "))])
    ways = {(r.part, r.c, r.start): (r.end, r.rows) for r in laid.mapInArrow(
        lambda b: (pa.RecordBatch.from_pylist(r, schema) for r in _edges(b, ending)), kind).collect()}
    for chain in (c for c in chains if len(c) > 1):
        start, offset = EMPTY, 0
        for r in chain:
            joints[r["part"], r["c"]] |= {"start": start, "offset": offset}
            start, n = ways[r["part"], r["c"], start]
            offset += n
    return joints


def _repaired(rows: _Rows, joints: dict) -> pa.RecordBatch:
    """A report of every piece and a line for every row that is put out."""
    starts, stops = rows.starts, rows.stops
    part = int(rows.pos[0]) >> POSITIONS
    lone = {"after": DONE, "turn": None, "initial": None, "first": True, "start": EMPTY, "offset": 0}
    joint = [joints.get((part, int(c)), lone) for c in rows.c[starts].tolist()]
    total = lambda x: np.add.reduceat(x.astype(np.int64), starts)
    blank, fresh = total(np.where(rows.blank, rows.n, 0)), total(rows.fresh)
    lasting = lambda x, fill: np.where(rows.dated, x, fill)
    same = np.concatenate(([False], (rows.t[1:] == rows.t[:-1]) & rows.dated[:-1]))
    legal = np.zeros((4, 4), bool)
    legal[SYSTEM, USER] = legal[USER, ASSISTANT] = legal[ASSISTANT, USER] = True
    wrong = np.concatenate(([False], ~legal[rows.initial[:-1], rows.initial[1:]])).astype(np.int64)
    same[starts], wrong[starts] = False, 0
    for i, j in enumerate(joint):
        if not j["first"]:
            same[starts[i]], wrong[starts[i]] = j["turn"] is not None and rows.dated[starts[i]] and j["turn"] == rows.t[starts[i]], not legal[j["initial"], rows.initial[starts[i]]]
    audits, costs, put, places, owner, position = [], [], [], [], [], []
    first_copy = np.cumsum(rows.n) - rows.n
    for i, j in enumerate(joint):
        runs = rows.runs(i)
        audit, _, cost, got, at = (_cached if len(runs) <= CACHED_RUNS else solve)(runs, j["start"], j["after"])
        audits.append(audit)
        costs.append(cost if j["first"] else 0)
        put.append(np.where(got >= 0, got + first_copy[starts[i]], -1))
        places.append(at)
        owner.append(np.full(len(got), starts[i]))
        position.append(np.arange(j["offset"], j["offset"] + len(got)))
    put, places, owner = np.concatenate(put), np.concatenate(places).astype(np.int64), np.concatenate(owner)
    source = np.where(put >= 0, np.searchsorted(first_copy, put, "right") - 1, 0)
    report, lines = len(starts), len(put)
    edit = np.where(put < 0, "I", np.where(places < 0, "R", "K"))
    role = np.where(edit == "K", "", np.where(np.abs(places) == USER, ROLES[USER], ROLES[ASSISTANT]))
    own = lambda name: pa.array(rows.batch.column(name).to_numpy()[source], mask=put < 0)
    pad = lambda values, lead: pa.concat_arrays([pa.nulls(report, values.type), values] if lead else [values, pa.nulls(lines, values.type)])
    long = lambda values: pad(pa.array(values, pa.int64()), False)
    keys = rows.batch.column("k").take(pa.array(np.concatenate((starts, owner))))
    open_ends = np.array([rows.last and i == report - 1 or (part, int(c)) in joints for i, c in enumerate(rows.c[starts])])
    columns = {
        "k": keys, "pos": pa.array(np.concatenate((rows.pos[starts], np.full(lines, -1)))), "open": pad(pa.array(open_ends), False),
        "blank": long(blank), "duplicate": long(total(rows.n) - blank - fresh), "truncated": long(total(rows.cut)),
        "illegal": long(total(wrong) + total(np.where(legal[rows.initial, rows.initial], 0, rows.n - 1))),
        "least": pad(_dated(np.minimum.reduceat(lasting(rows.t, np.iinfo(np.int64).max), starts), total(rows.dated)), False),
        "most": pad(_dated(np.maximum.reduceat(lasting(rows.t, np.iinfo(np.int64).min), starts), total(rows.dated)), False),
        "turns": long(total(rows.dated & ~same)), "cost": long(costs), "audit": pad(pa.array(audits, pa.string()), False),
        "position": pad(pa.array(np.concatenate(position)), True), "edit": pad(pa.array(edit.tolist(), pa.string()), True),
        "role": pad(pa.array(role.tolist(), pa.string()), True), "e1": pad(own("e1"), True), "e2": pad(own("e2"), True)}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _dated(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.array(values, mask=counts == 0)


def repair_conversations(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest edits that give every conversation the roles ``(s?(ua)+)?``, and the conversations so repaired.

    ``report`` has a row for each key: ``gaps`` (turns missing between the first and the last), ``blank``, ``duplicate`` (role
    and text stood earlier) and ``truncated`` rows, each counted by its first fault, ``illegal`` neighbours, the ``cost`` and the
    ``audit``: initials of Keep, Rerole (2), Delete (3, a must for blank and duplicate rows) and Insert (2, with empty text),
    the least in ASCII order of the cheapest. A truncated row that stays adds 1. ``transcript`` has the repaired rows: key,
    ``position`` from 0, ``edit``, ``role`` and ``text``.

    Rows go by turn, null turns first; those of one turn in the order of a hash of role and text, equal ones side by side.
    Null roles and texts count as one space, null keys as one conversation, and null turns count in no gap. Repeated rows are
    duplicates; an empty table gives empty results; extra columns are ignored. A conversation of any length is shared by as many
    tasks as its rows fill, and equal rows are counted before they are sorted.
    """
    rows = _rows(turns, key, turn, role, text)
    laid = _laid_out(rows)
    joints = laid.sparkSession.sparkContext.broadcast(_joints(laid))
    kind = laid.schema["k"].dataType.simpleString()
    out = (f"k {kind}, pos long, open boolean, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, "
           "cost long, audit string, position long, edit string, role string, e1 long, e2 long")
    done = checkpointed(laid.mapInArrow(lambda b: (_repaired(r, joints.value) for r in _pieces(b)), out))
    joints.destroy()
    sums = ["blank", "duplicate", "truncated", "illegal", "turns", "cost"]
    reports = done.where("pos >= 0").select("k", "pos", "open", *sums, "least", "most", "audit")
    several = reports.where("open").groupBy("k").agg(
        F.min("pos").alias("pos"), F.lit(True).alias("open"), *(F.sum(c).alias(c) for c in sums), F.min("least").alias("least"), F.max("most").alias("most"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "audit"))), lambda p: p["audit"]), "").alias("audit"))
    width = F.col("most").cast("decimal(20,0)") - F.col("least").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.coalesce(F.least(width, F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long"), F.lit(0))
    report = reports.where("NOT open").unionByName(several).select(F.col("k").alias(key), gaps.alias("gaps"), *sums[:4], "cost", "audit")
    lines = done.where("pos < 0").select("k", "position", "edit", F.col("role").alias("set"), "e1", "e2")
    stay = lines.where("e1 IS NOT NULL").join(rows.select("e1", "e2", "role", "text"), ["e1", "e2"]).dropDuplicates(["e1", "e2"])
    stay = stay.select("k", "position", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("set")).alias("role"), "text")
    added = lines.where("e1 IS NULL").select("k", "position", "edit", F.col("set").alias("role"), F.lit("").alias("text"))
    transcript = stay.unionByName(added).select(F.col("k").alias(key), "position", "edit", F.col("role").alias(role), F.col("text").alias(text))
    return Repair(report, transcript)


def transcript_digests(transcript: DataFrame, *, key: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """``key`` and ``sha256`` of the lines ``role:text`` of every conversation in order, joined by newlines.

    A digest runs over its bytes in order, so the lines of one conversation stream through one task, which holds one batch.
    """
    lines = transcript.select(F.col(key).alias("k"), F.xxhash64(F.col(key).isNull(), F.col(key)).alias("c"), "position",
                              F.concat(F.col(role), F.lit(":"), F.col(text)).alias("line"))
    kind = lines.schema["k"].dataType.simpleString()

    def digest(batches):
        here, name, state = None, None, None
        for batch in batches:
            names, digests, c = [], [], batch.column("c").to_numpy()
            start = 0
            for i, line in enumerate(batch.column("line").to_pylist()):
                if c[i] != here or state is None:
                    if state is not None:
                        names.append(name)
                        digests.append(state.hexdigest())
                    here, name, state, start = c[i], batch.column("k").slice(i, 1), hashlib.sha256(), True
                state.update(("" if start else "\n").encode() + line.encode())
                start = False
            if names:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(digests)], ["k", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([name, pa.array([state.hexdigest()])], ["k", "sha256"])

    return lines.repartition("c").sortWithinPartitions("c", "position").mapInArrow(digest, f"k {kind}, sha256 string").withColumnRenamed("k", key)


def with_missing(report: DataFrame, ids: DataFrame, key: str = "conv_id") -> DataFrame:
    """``report`` with a row of nulls for every key of ``ids`` that it lacks."""
    return join_on(ids, report, [key], "left")
