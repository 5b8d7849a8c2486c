"""Near-duplicate passages across eligibility texts by compact windows over min-hashes.

For each hash function the 5-word shingles of a text form a Cartesian tree; a node stands for all subsequences in which it
is the minimum, so one *compact window* (left, anchor, right) describes all long subsequences that share a signature. Only
nodes that span a minimum passage are kept, about two for every passage length. Windows with one signature are linked to
the first of them that is similar by short codes of the words around, so a passage in a million texts makes a million links and
no pairs, and texts with the signature alone hide nothing. Linked texts are verified word by word along their diagonals.

Exact repeats do not depend on who is first: where the surroundings of a minimum are shared by two texts, all runs of the
minimum length around it are grouped by their hash, and each meets the first text that has the very same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.id_filter import bit_of, id_filter, split, with_bit
from trialspark.llm.text_arrays import ALNUM, LOWER, cut_words, lists, mix, text_runs, window_hashes, word_hashes, word_spans
from trialspark.session import checkpointed, stored

SHINGLE, MIN_WORDS, SIMILARITY = 5, 50, 0.8
HASHES = 5
REACH = (1 << 16) - 1  # shingles that a window is followed to each side of its anchor; longer repeats have more anchors
BLOCK = 64  # words of a passage that travel together for verification
ROUNDS = 4  # rows of a group that all others meet; further ones are looked up
GROUP_ROWS = 20_000  # windows that are compared in one go; a larger group goes as a whole
_POSITION, _SEGMENT, _ODD = 24, 1 << 22, np.uint64(0x9E3779B97F4A7C15)


def compact_windows(values: np.ndarray, span: int) -> list[tuple[int, int, int]]:
    """(left, anchor, right) of all Cartesian-tree nodes of ``values`` over at least ``span`` places; zeros separate texts.

    Equal minima of one subtree share its extent. One that follows another by less than ``span`` is left out, and later
    ones reach ``span`` places only, so that text which repeats itself has windows in proportion to its length.
    """
    n = len(values)
    if n < span:
        return []
    low = np.uint64((1 << _POSITION) - 1)
    keyed = (values & ~low) | np.arange(n, dtype=np.uint64)
    pad = -n % span
    table = np.concatenate((keyed, np.full(pad, np.iinfo(np.uint64).max))).reshape(-1, span)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n - span + 1], before[span - 1:n])  # of every run of span places
    changes = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    places = (least[changes] & low).astype(np.int64)
    height = (values[places] >> np.uint64(_POSITION)).tolist()
    at = places.tolist()
    left, stack = [], []
    for i, h in enumerate(height):
        while stack and height[stack[-1]] >= h:
            stack.pop()
        left.append(at[stack[-1]] + 1 if stack else 0)
        stack.append(i)
    right, stack = [n - 1] * len(at), []
    for i in range(len(at) - 1, -1, -1):
        h = height[i]
        while stack and height[stack[-1]] >= h:
            stack.pop()
        if stack:
            right[i] = at[stack[-1]] - 1
        stack.append(i)
    out, last = [], {}
    for lo, c, hi, h in zip(left, at, right, height, strict=True):
        if h and hi - lo + 1 >= span:
            before = last.get((lo, h))
            if before is None:
                out.append((lo, c, hi))
            elif c - before >= span:
                out.append((max(lo, c - span), c, min(hi, c + span)))
            else:
                continue
            last[lo, h] = c
    return out


def windows(eligibilities: DataFrame, key: str, text: str, hashes: int, min_words: int) -> DataFrame:
    """(signature, k, place): compact windows of all texts; ``place`` packs anchor, reach to the left and to the right."""
    span = min_words - SHINGLE + 1

    def scan(batches):
        for rows, data, offsets in text_runs(batches, 1):
            low = LOWER[data]
            starts, ends, first = word_spans(low, offsets, ALNUM)
            _, shingles = window_hashes(word_hashes(low, starts, ends), first, SHINGLE)
            per_row = np.maximum(np.diff(first) - SHINGLE + 1, 0)
            lead = np.concatenate(([0], np.cumsum(per_row + 1)))  # each text follows a separator
            own = np.ones(lead[-1], bool)
            own[lead[:-1]] = False
            for j in range(hashes):
                values = np.zeros(lead[-1] + 1, np.uint64)
                values[:-1][own] = mix(shingles ^ np.uint64(0x632BE59BD9B4E019 * (j + 1) & (1 << 64) - 1))
                found = []
                for s in range(0, max(1, len(values) - span), _SEGMENT):
                    found += [(a + s, c + s, b + s) for a, c, b in compact_windows(values[s:s + _SEGMENT + span], span)]
                if not found:
                    continue
                a, c, b = np.array(found, np.int64).T
                row = np.searchsorted(lead, c, "right") - 1
                place = (c - lead[row] - 1) << 32 | np.minimum(c - a, REACH) << 16 | np.minimum(b - c, REACH)
                signature = (values[c] & ~np.uint64(7) | np.uint64(j)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signature), rows.column(0).take(pa.array(row)), pa.array(place)], ["signature", "k", "place"])

    own = eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    return own.mapInArrow(scan, f"signature bigint, k {own.schema['k'].dataType.simpleString()}, place bigint")


def needed(span: int, similarity: float) -> int:
    """Shingles of a window of ``span`` that another one must have, for their Jaccard similarity to be ``similarity``."""
    return int(np.ceil(2 * similarity / (1 + similarity) * span - 1e-9))


def _with_first(rows: DataFrame, by: str, place: str) -> DataFrame:
    """``rows`` plus the first text with the same ``by`` and its first ``place`` there: one shuffle, where a join with the
    aggregated table would compute and move ``rows`` twice. A group streams through its task and spills beyond 4,096 rows."""
    group = Window.partitionBy(by).orderBy("k", place).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", F.first("k").over(group).alias("first_k"), F.first(place).over(group).alias(f"first_{place}"))


def _contexts(words: np.ndarray, anchors: np.ndarray, side: int) -> np.ndarray:
    """The words from ``side`` before to ``side`` after the shingle at each anchor, four bits a word and two words a byte; zero is no word."""
    width = 2 * side + SHINGLE + 1
    codes = np.concatenate((np.zeros(side, np.uint8), (words.view(np.uint32) % 15 + 1).astype(np.uint8), np.zeros(width, np.uint8)))
    found = np.lib.stride_tricks.sliding_window_view(codes, width)[anchors]
    return found[:, ::2] << 4 | found[:, 1::2]


class Similar:
    """Whether two contexts share a passage around their anchors: of some ``span`` shingles, the anchor's among them, at least
    ``need`` are the same, where words may have been put in or left out as far as ``need`` lets them."""

    def __init__(self, min_words: int, similarity: float):
        self.span = min_words - SHINGLE + 1
        self.need = needed(self.span, similarity)
        lost = self.span - self.need
        self.reach = max(0, lost - SHINGLE + 1)  # a change within a passage takes four shingles and one for each word put in
        self.side = self.span - 1 + self.reach
        run = -(-self.need // (1 + lost // (SHINGLE - 1))) + SHINGLE - 1  # words of the longest piece that has no change
        self.blocks = max(0, (run - 7) // 8)  # whole blocks of eight words within it
        self.width = 2 * (self.span - 1) + SHINGLE

    def unpacked(self, packed: np.ndarray) -> np.ndarray:
        return np.stack((packed >> 4, packed & 15), axis=2).reshape(len(packed), -1)

    def shifted(self, contexts: np.ndarray, by: int) -> np.ndarray:
        return contexts[:, self.reach - by:self.reach - by + self.width]

    def blocked(self, contexts: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros((len(contexts), -(-self.width // 8) * 8), np.uint8)
        out[:, :self.width] = self.shifted(contexts, by)
        return out.view(np.uint64)

    def shares(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether so many neighbouring blocks are the same, without which no passage is."""
        same = a == b
        run = same
        for i in range(1, self.blocks):
            run = run[:, :-1] & same[:, i:]
        return run.any(1)

    def matches(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Whether the contexts are similar, and for each shift whether the words match there and on no smaller one."""
        own = self.shifted(a, 0)
        match, adds = np.zeros((len(a), self.width - SHINGLE + 1), bool), {}
        for by in sorted(range(-self.reach, self.reach + 1), key=abs):
            same = (own == self.shifted(b, by)) & (own > 0)
            run = same[:, :same.shape[1] - SHINGLE + 1]
            for i in range(1, SHINGLE):
                run = run & same[:, i:same.shape[1] - SHINGLE + 1 + i]
            adds[by] = (run & ~match).any(1)
            match |= run
        total = np.zeros((len(a), match.shape[1] + 1), np.int32)
        np.cumsum(match, axis=1, out=total[:, 1:])
        return (total[:, self.span:] - total[:, :-self.span] >= self.need).any(1), adds

    def first_of(self, group: np.ndarray, text: np.ndarray, packed: np.ndarray):
        """(row, earlier row, shift): for each row the first row of its group that is of an earlier text and similar.

        Rows come in order of their group and text. All rows of all groups meet the first row of theirs, those that are left the
        second one and so on for ``ROUNDS`` rounds. The others meet the rows with which they share two neighbouring blocks, without
        which none is similar, so rows of a large group that have little in common are not compared.
        """
        contexts = self.unpacked(packed)
        own, theirs = self.blocked(contexts, 0), {by: self.blocked(contexts, by) for by in range(-self.reach, self.reach + 1)}
        start = np.searchsorted(group, group)
        left, out, n = np.arange(len(group)), [], 0

        def meet(rows, other):
            """Which rows are similar to the other ones, each with the shifts of its words."""
            sure = np.ones(len(rows), bool)
            if self.blocks:
                mine = own[rows]
                sure = np.any([self.shares(mine, theirs[by][other]) for by in theirs], axis=0)
            at = np.flatnonzero(sure)
            good, adds = self.matches(contexts[rows[at]], contexts[other[at]])
            sure[at] = good
            return sure, at, adds

        def keep(rows, other):
            good, at, adds = meet(rows, other)
            out.extend((rows[here], other[here], by) for by, there in adds.items() for here in [at[good[at] & (there | (by == 0))]])
            return good

        while self.blocks < 2 or n < ROUNDS:
            left = left[start[left] + n < left]
            left = left[text[start[left] + n] < text[left]]
            if not len(left):
                return out
            left = left[~keep(left, start[left] + n)]
            n += 1
        left = left[(start[left] + n < left)]
        first = np.full(len(group), len(group))  # of those that are left, the first similar row, found among rows with equal blocks
        asked = np.zeros(len(group), bool)
        asked[start[left]] = True
        rows = np.flatnonzero(asked[start] & (np.arange(len(group)) >= start + n))
        whole = {by: (blocks.view(np.uint8).reshape(len(blocks), -1, 8) > 0).all(2) for by, blocks in theirs.items()}
        for by, blocks in theirs.items():
            for j in range(blocks.shape[1] - 1):
                named = lambda b, there, at, j=j: (at[there[at, j] & there[at, j + 1]], lambda r: mix(mix(b[r, j] ^ start[r].astype(np.uint64) * _ODD) ^ b[r, j + 1]))
                earlier, hashed = named(blocks, whole[by], rows)
                later, sought = named(own, whole[0], left)
                value = hashed(earlier)
                order = np.argsort(value, kind="stable")
                earlier, value, wanted = earlier[order], value[order], sought(later)
                at, end = np.searchsorted(value, wanted), np.searchsorted(value, wanted, "right")
                while True:
                    going = np.flatnonzero(at < end)
                    later, at, end = later[going], at[going], end[going]
                    other = earlier[at]
                    going = np.flatnonzero((text[other] < text[later]) & (other < first[later]))
                    later, at, end, other = later[going], at[going], end[going], other[going]
                    if not len(later):
                        break
                    good, _, _ = meet(later, other)
                    first[later[good]] = other[good]
                    at = at + 1
        left = left[first[left] < len(group)]
        if len(left):
            keep(left, first[left])
        return out


def _whole_groups(batches, rows: int):
    """Tables of whole groups of the first column, by which the batches are in order, of about so many rows."""
    ready, last, n = [], [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        by = batch.column(0).to_numpy()
        cut = int(np.searchsorted(by, by[-1]))
        if cut or last and last[-1].column(0)[0].as_py() != by[0]:
            ready += [*last, batch.slice(0, cut)]
            n, last = sum(b.num_rows for b in ready), []
            if n >= rows:
                yield pa.Table.from_batches(ready)
                ready, n = [], 0
        last.append(batch.slice(cut))
    if ready or last:
        yield pa.Table.from_batches([*ready, *last])


def candidate_pairs(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", hashes: int = HASHES,
                    min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(k, first_k, runs): texts and, for each signature of theirs, the first text that is similar around it.

    A text that shares a signature and no passage hides none of those behind it: each window meets all before it that can be
    similar, until one is. ``runs`` lists the diagonals with the shingle range ``[lo, hi]`` around the anchors. Only windows whose signature another text has are given their words.
    Windows of one signature are compared in one task; where they share some 16 words and are unlike all the same, that grows with the square of their number.
    """
    found = windows(eligibilities, key, text, hashes, min_words)
    group = Window.partitionBy("signature")
    shared = found.select("*", (F.min("k").over(group) != F.max("k").over(group)).alias("shared")).where("shared")
    wanted = checkpointed(shared.groupBy("k").agg(F.collect_list(F.struct("signature", "place")).alias("places")))
    texts = _words(eligibilities, key, text, id_filter(wanted.select("k")))
    kind = wanted.schema["k"].dataType.simpleString()
    similar = Similar(min_words, similarity)

    def contexts_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, places = batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values
                anchors = places.field("place").to_numpy() >> 32
                here = np.flatnonzero(anchors + SHINGLE <= len(words))  # another row of the key may be shorter
                context = _contexts(words, anchors[here], similar.side)
                ends = pa.array(np.arange(len(here) + 1) * context.shape[1], pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(here), [None, ends.buffers()[1], pa.py_buffer(context.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [places.field("signature").take(pa.array(here)), pa.array([batch.column(0)[i].as_py()] * len(here), batch.schema.field(0).type),
                     pa.array(anchors[here].astype(np.int32)), packed], ["signature", "k", "place", "context"])

    def links_of(batches):
        for table in _whole_groups(batches, GROUP_ROWS):
            table = table.combine_chunks()
            group, place, keys = table.column(0).to_numpy(), table.column(2).to_numpy(), table.column(1).combine_chunks()
            packed = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(len(group), -1)
            text = np.concatenate(([0], np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False) | (group[1:] != group[:-1]))))
            for own, other, by in similar.first_of(group, text, packed):
                diagonal = place[own] - place[other] + by
                lo = np.maximum(place[own] - similar.span + 1, np.maximum(diagonal, 0))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(own)), keys.take(pa.array(other)), *(
                    pa.array(v.astype(np.int32)) for v in (diagonal, lo, place[own] + similar.span - 1))], ["k", "first_k", "diagonal", "lo", "hi"])

    around = stored(texts.join(wanted, "k").select("k", "words", "places").mapInArrow(contexts_of, f"signature bigint, k {kind}, place int, context binary"))
    ordered = around.repartition("signature").sortWithinPartitions("signature", "k", "place")
    rows = ordered.mapInArrow(links_of, f"k {kind}, first_k {kind}, diagonal int, lo int, hi int")
    lines = rows.groupBy("k", "first_k", "diagonal").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return lines.groupBy("k", "first_k").agg(F.collect_list(F.struct("diagonal", "lo", "hi")).alias("runs"))


def anchored(shingles: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``span`` shingles within one row, and the place of the first least shingle of each."""
    starts, places = [], []
    low = np.uint64((1 << _POSITION) - 1)
    for s in range(0, len(shingles) - span + 1, _SEGMENT):
        part = shingles[s:s + _SEGMENT + span - 1]
        n = len(part)
        table = np.concatenate(((mix(part) & ~low) | np.arange(n, dtype=np.uint64), np.full(-n % span, np.iinfo(np.uint64).max))).reshape(-1, span)
        before = np.minimum.accumulate(table, axis=1).ravel()
        after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n - span + 1], before[span - 1:n])
        own = np.flatnonzero(row[s:s + n - span + 1] == row[s + span - 1:s + n])
        starts.append(own + s)
        places.append((least[own] & low).astype(np.int64) + s)
    return (np.concatenate(starts), np.concatenate(places)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _surroundings(words: np.ndarray, first: np.ndarray, min_words: int):
    """Runs of ``min_words`` words (row, first word, hash), and the hashes of the words before and after the least shingle of
    each, zero where a row has not so many. Of two equal runs one of both is equal, as they are half a run long."""
    half = (min_words + SHINGLE + 1) // 2
    at, shingles = window_hashes(words, first, SHINGLE)
    start, place = anchored(shingles, np.searchsorted(first, at, "right") - 1, min_words - SHINGLE + 1)
    start, place = at[start], at[place]
    row = np.searchsorted(first, start, "right") - 1
    half_at, half_hash = window_hashes(words, first, half)
    halves, whole = np.zeros(len(words) + 1, np.uint64), np.zeros(len(words) + 1, np.uint64)
    halves[half_at] = half_hash
    whole_at, whole_hash = window_hashes(words, first, min_words)
    whole[whole_at] = whole_hash
    after, back = halves[place], place + SHINGLE - half
    before = np.where(back >= first[row], halves[np.maximum(back, 0)], np.uint64(0))
    sides = [np.where(h > 0, mix(h ^ np.uint64(i)), np.uint64(0)).view(np.int64) for i, h in ((1, before), (2, after))]
    return row, start, place, whole[start].view(np.int64), sides


def exact_pairs(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, first_k, diagonal, lo, hi): texts and the first text with the same ``min_words`` words, for all such runs."""
    own = eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    kind = own.schema["k"].dataType.simpleString()

    def sides_of(batches):
        for rows, data, offsets in text_runs(batches, 1):
            low = LOWER[data]
            starts, ends, first = word_spans(low, offsets, ALNUM)
            row, _, place, _, sides = _surroundings(word_hashes(low, starts, ends) >> np.uint64(32), first, min_words)
            new = np.flatnonzero(np.diff(place, prepend=-1))
            for side in sides:
                here = new[side[new] != 0]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row[here])), pa.array(side[here])], ["k", "side"])

    sides = own.mapInArrow(sides_of, f"k {kind}, side bigint")
    group = Window.partitionBy("side")
    shared = sides.select("*", (F.min("k").over(group) != F.max("k").over(group)).alias("shared")).where("shared")
    wanted = checkpointed(shared.groupBy("k").agg(F.collect_set("side").alias("sides")))
    texts = _words(eligibilities, key, text, id_filter(wanted.select("k")))

    def runs_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(1)[i].values.to_numpy().view(np.uint32).astype(np.uint64)
                _, start, _, whole, sides = _surroundings(words, np.array([0, len(words)]), min_words)
                sought = batch.column(2)[i].values.to_numpy()
                here = np.isin(sides[0], sought) | np.isin(sides[1], sought)
                n = int(here.sum())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * n, batch.schema.field(0).type), pa.array(whole[here]),
                                                  pa.array(start[here].astype(np.int32))], ["k", "run", "start"])

    runs = texts.join(wanted, "k").select("k", "words", "sides").mapInArrow(runs_of, f"k {kind}, run bigint, start int")
    met = _with_first(runs, "run", "start").where("k <> first_k")
    span = min_words - SHINGLE
    return met.groupBy("k", "first_k", (F.col("start") - F.col("first_start")).alias("diagonal")).agg(F.min("start").alias("lo"), (F.max("start") + span).alias("hi"))


def _words(eligibilities: DataFrame, key: str, text: str, wanted) -> DataFrame:
    """(k, words) of the texts whose id is in the bit table: one 32-bit hash for each word."""

    def scan(batches):
        for rows, data, offsets in text_runs(with_bit(batches, 2, wanted, True), 1):
            low = LOWER[data]
            starts, ends, first = word_spans(low, offsets, ALNUM)
            hashes = (word_hashes(low, starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), lists(np.diff(first), pa.array(hashes))], ["k", "words"])

    own = eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL")
    return own.withColumn("b", bit_of("k")).mapInArrow(scan, f"k {own.schema['k'].dataType.simpleString()}, words array<int>")


def _cut_blocks(batches):
    """Rows (k, words, blocks) to (k, block, part): the wanted blocks of ``BLOCK`` words."""
    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column(1)[i].values.to_numpy()
            blocks = [b for b in batch.column(2)[i].as_py() if b * BLOCK < len(words)]
            parts = [words[b * BLOCK:(b + 1) * BLOCK] for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0)[i].as_py()] * len(blocks), batch.schema.field(0).type), pa.array(blocks, pa.int32()),
                 lists(np.array([len(p) for p in parts], np.int64), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))], ["k", "block", "part"])


def repeated_spans(words: np.ndarray, lines: list[tuple[int, int, int, np.ndarray]], min_words: int, similarity: float) -> list[tuple[int, int]]:
    """Word ranges ``[start, stop)`` of ``words`` that stay similar to another text over at least ``min_words`` words, cut
    back to the first and the last word that match.

    ``lines`` has (diagonal, lo, hi, the other text's words from ``lo - diagonal`` on). A shingle matches if the other text
    has the same five words on one of the diagonals; a window of ``min_words`` words is similar if so many of its shingles
    match that the Jaccard similarity of both windows is ``similarity``.
    """
    span = min_words - SHINGLE + 1
    match = np.zeros(max(0, len(words) - SHINGLE + 1), np.int32)
    for _, lo, hi, other in lines:
        hi = min(hi, len(match) - 1, lo + len(other) - SHINGLE)
        if hi >= lo:
            same = words[lo:hi + SHINGLE] == other[:hi + SHINGLE - lo]
            run = np.convolve(same, np.ones(SHINGLE, np.int32), "valid") == SHINGLE
            match[lo:hi + 1] |= run
    if len(match) < span:
        return []
    total = np.concatenate(([0], np.cumsum(match)))
    need = needed(span, similarity)
    good = np.flatnonzero(total[span:] - total[:-span] >= need)
    if not len(good):
        return []
    cut = np.flatnonzero(np.diff(good) > min_words)
    out = []
    for a, b in zip(good[np.concatenate(([0], cut + 1))], good[np.concatenate((cut, [len(good) - 1]))], strict=True):
        same = np.flatnonzero(match[a:b + span])
        out.append((int(a + same[0]), int(a + same[-1]) + SHINGLE))
    return out


def repeated_passages(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", hashes: int = HASHES,
                      min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``key``, ``first_<key>`` and ``spans``: passages of a text that the first text with their signatures has too.

    ``spans`` are word ranges ``[start, stop)`` (words of lower-cased ASCII letters, digits and non-ASCII characters) in
    which every ``min_words`` words have a Jaccard similarity of 5-word shingles of at least ``similarity`` to the other
    text, without words at the ends that differ. Words are compared by 32-bit hashes.
    The other text always has the smaller key, so every text but the first of a class is named. Every exact repeat of
    ``min_words`` words is found; a passage that is only similar meets every earlier text that has one of its min-hashes, until
    one is similar, and is missed if none of ``hashes`` min-hashes coincide. Repeats inside one text do not count.

    Null, empty and short texts and rows with a null key give no row; repeated rows with one key are one text read from
    any of them; extra columns are ignored; an empty table gives an empty result. Runs jobs that checkpoint candidates.
    """
    exact = checkpointed(exact_pairs(eligibilities, key=key, text=text, min_words=min_words))
    near = candidate_pairs(eligibilities, key=key, text=text, hashes=hashes, min_words=min_words, similarity=similarity)
    near = near.select("k", "first_k", F.explode("runs").alias("r")).select("k", "first_k", "r.*")
    line = checkpointed(near.unionByName(exact).groupBy("k", "first_k", "diagonal").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    pairs = line.select("k", "first_k")
    ids = pairs.select("k").unionByName(pairs.select(F.col("first_k").alias("k"))).distinct()
    texts = _words(eligibilities, key, text, id_filter(ids))
    span = F.sequence(F.floor((F.col("lo") - F.col("diagonal")) / BLOCK).cast("int"), F.floor((F.col("hi") - F.col("diagonal") + SHINGLE - 1) / BLOCK).cast("int"))
    wanted = line.select("*", F.explode(span).alias("block"))
    blocks = wanted.select(F.col("first_k").alias("k"), "block").distinct().groupBy("k").agg(F.collect_list("block").alias("blocks"))
    id_type = pairs.schema["k"].dataType.simpleString()
    parts = texts.join(blocks, "k").select("k", "words", "blocks").mapInArrow(_cut_blocks, f"k {id_type}, block int, part array<int>").withColumnRenamed("k", "first_k")
    carried = wanted.join(parts, ["first_k", "block"]).groupBy("k").agg(F.collect_list(F.struct("first_k", "diagonal", "lo", "hi", "block", "part")).alias("lines"))
    names = (key, f"first_{key}")

    def verify(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                own, by = batch.column(1)[i].values.to_numpy(), {}
                rows = batch.column(2)[i].values
                field = {f: rows.field(f) for f in ("first_k", "diagonal", "lo", "hi", "block", "part")}
                heads = zip(*(field[f].to_pylist() for f in ("first_k", "diagonal", "lo", "hi", "block")), strict=True)
                for n, (other, d, lo, hi, block) in enumerate(heads):
                    by.setdefault(other, {}).setdefault((d, lo, hi), {})[block] = n  # a repeated row brings a block again
                for other, lines in sorted(by.items()):
                    ready = []
                    for (d, lo, hi), found in lines.items():
                        words = np.concatenate([field["part"][found[b]].values.to_numpy() for b in sorted(found)])
                        ready.append((d, lo, hi, words[lo - d - min(found) * BLOCK:]))
                    if spans := repeated_spans(own, ready, min_words, similarity):
                        out.append((batch.column(0)[i].as_py(), other, [{"start": a, "stop": b} for a, b in spans]))
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], kind),
                 pa.array([r[2] for r in out], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["k", "first_k", "spans"])

    found = texts.join(carried, "k").select("k", "words", "lines").mapInArrow(verify, f"k {id_type}, first_k {id_type}, spans array<struct<start:int,stop:int>>")
    return found.dropDuplicates(["k", "first_k"]).toDF(*names, "spans")


def remove_repeats(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", **options) -> DataFrame:
    """``eligibilities``, all columns kept, without the passages that ``repeated_passages`` finds.

    The first text with a passage keeps it; the others lose its words with what stands between them, and go if no word is
    left. Texts without a find stay untouched, null and empty texts and rows without a key too. Only texts that a bit table
    of fixed size does not rule out are shuffled.
    """
    columns = eligibilities.columns
    n, at, own = len(columns), columns.index(text), f"c{columns.index(key)}"
    found = repeated_passages(eligibilities, key=key, text=text, **options)
    spans = checkpointed(found.toDF("__k", "__f", "s").groupBy("__k").agg(F.flatten(F.collect_list("s")).alias("__spans")))
    others, touched = split(eligibilities, key, spans.select("__k"))
    touched = touched.join(spans, F.col(own) == F.col("__k"), "left").drop("__k")
    cut = touched.mapInArrow(lambda batches: cut_words(batches, at, n, n), others.schema)
    return others.unionByName(cut).toDF(*columns)
