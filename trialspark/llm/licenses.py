"""License notices in eligibility texts by diagonal voting.

All rolling word 3-grams of all texts are joined to the positions of the same grams in license templates. Every hit votes
for a diagonal (its place in the text less its place in the template); the votes are summed by diagonal, neighbouring
diagonals of notices are merged as far as words put in or left out can move them, and what has enough votes is verified word
by word.
"""

from __future__ import annotations

from bisect import bisect_right
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.text_arrays import ALNUM, LOWER, column_bytes, lists, text_runs, window_hashes, word_hashes, word_spans

GRAM, LONG, SIMILARITY = 3, 8, 0.8
CHUNK = 1 << 16  # grams of one text that travel in one row
MARGIN = 4  # words kept around a hit for verification, besides the drift of its template
MASK = 63  # places of a template in one word of votes

# Phrases whose every place counts, with their labels.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Opening or naming sentences and whole texts of well-known public licenses, with their labels.
NOTICES = (
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
            "to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
            "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
            "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
            "from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
            "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
            "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the "
            "author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data "
            "or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
            "performance of this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                 "obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
                 "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
                 "either express or implied see the license for the specific language governing permissions and limitations under the license"),
)


def _template_words(templates) -> list[list[str]]:
    words = [text.lower().split() for _, text in templates]
    if any(len(w) < GRAM for w in words):
        raise ValueError(f"a template has at least {GRAM} words")
    return words


def drift(size: int, exact: bool) -> int:
    """Words that may be put in at one place of a template of ``size`` words before it is less similar than ``SIMILARITY``."""
    return 0 if exact or size < LONG else int(2 * size * (1 - SIMILARITY) / SIMILARITY + 1e-9)


def template_grams(templates) -> list[tuple[int, int, int]]:
    """(hash, template, place) of every gram of every template."""
    data, offsets = column_bytes(pa.array([" ".join(w) for w in _template_words(templates)], pa.string()))
    starts, ends, first = word_spans(data, offsets, ALNUM)
    at, hashes = window_hashes(word_hashes(data, starts, ends), first, GRAM)
    row = np.searchsorted(first, at, "right") - 1
    return list(zip(hashes.view(np.int64).tolist(), row.tolist(), (at - first[row]).tolist(), strict=True))


def _grams(rows, data, offsets):
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets, ALNUM)
    at, hashes = window_hashes(word_hashes(low, starts, ends), first, GRAM)
    return low, starts, ends, first, at, hashes


def _all_grams(batches):
    """(k, base, hashes): the gram hashes of each text in pieces of ``CHUNK``."""
    for rows, data, offsets in text_runs(batches, 1):
        _, _, _, first, at, hashes = _grams(rows, data, offsets)
        edge = np.searchsorted(at, first)
        row, base, size = [], [], []
        for i, n in enumerate(np.diff(edge).tolist()):
            for b in range(0, n, CHUNK):
                row.append(i), base.append(b), size.append(min(CHUNK, n - b))
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row, pa.int64())), pa.array(base, pa.int32()),
                                          lists(np.array(size, np.int64), pa.array(hashes.view(np.int64)))], ["k", "base", "hashes"])


def _evidence(known: np.ndarray, reach: np.ndarray):
    """(k, n_words, near): the words around every gram that some template has, as (first word, words)."""

    def scan(batches):
        for rows, data, offsets in text_runs(batches, 1):
            low, starts, ends, first, at, hashes = _grams(rows, data, offsets)
            where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            same = known[where] == hashes
            hit, wide = at[same], reach[where[same]]
            row = np.searchsorted(first, hit, "right") - 1
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, np.maximum(hit - wide, first[row]), 1)
            np.add.at(change, np.minimum(hit + GRAM + wide, first[row + 1]), -1)
            inside = np.cumsum(change[:-1]) > 0
            near = [[] for _ in range(rows.num_rows)]
            opens = inside & ~np.concatenate(([False], inside[:-1]))[:len(inside)]
            opens[first[:-1][first[:-1] < len(inside)]] |= inside[first[:-1][first[:-1] < len(inside)]]
            begin = np.flatnonzero(opens)
            stops = np.flatnonzero(inside & np.concatenate((~inside[1:] | opens[1:], [True]))[:len(inside)]) + 1
            for r, a, b in zip(np.searchsorted(first, begin, "right") - 1, begin, stops, strict=True):
                words = " ".join(low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True))
                near[r].append({"at": int(a - first[r]), "words": words})
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(first), pa.int64()), pa.array(near, pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string())])))], ["k", "n_words", "near"])

    return scan


def similar_places(own: list[str], part: list[str | None]) -> list[tuple[int, int, float]]:
    """(start, stop, score) of the places in ``part`` with a similarity of ``SIMILARITY`` to ``own``, none overlapping.

    The score is twice the words that match in order over the words of both; a place starts and ends with a match.
    """
    least = len(own) * SIMILARITY / (2 - SIMILARITY)  # shorter places are less similar even if all their words match
    out, todo = [], [(0, len(part))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        blocks = [m for m in SequenceMatcher(None, own, part[lo:hi], False).get_matching_blocks() if m.size]
        best = None
        stray = [m.size == 1 for m in blocks]  # a word alone and away from all others may be there by chance
        for i, (m, n) in enumerate(pairwise(blocks)):
            if n.b - m.b - m.size <= MARGIN:
                stray[i] = stray[i + 1] = False
        for i, head in enumerate(blocks):
            same = 0
            for j, tail in enumerate(blocks[i:], i):
                same += tail.size
                score = 2 * same / (len(own) + tail.b + tail.size - head.b)
                if score >= SIMILARITY:
                    best = max(best or (0,), (same - stray[i] - (j > i and stray[j]), score, lo + head.b, lo + tail.b + tail.size))
        if best:
            _, score, start, stop = best
            out.append((start, stop, score))
            todo += [(lo, start), (stop, hi)]
    return sorted(out)


def _words_between(pieces: list[tuple[int, list[str]]], lo: int, hi: int) -> list[str | None]:
    """The words ``[lo, hi)`` of a text; None where nothing near is known of it."""
    out: list[str | None] = [None] * (hi - lo)
    for at, words in pieces[max(0, bisect_right(pieces, lo, key=lambda p: p[0]) - 1):]:
        if at >= hi:
            break
        a, b = max(lo, at), min(hi, at + len(words))
        if a < b:
            out[a - lo:b - lo] = words[a - at:b - at]
    return out


def _verify(templates, n_base: int):
    words = _template_words(templates)

    def check(batches):
        for batch in batches:
            out = []
            for near, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pieces, places = [(s["at"], s["words"].split(" ")) for s in near or ()], {}
                for f in found or ():
                    own, label, start = words[f["template"]], templates[f["template"]][0], f["least"]
                    base = f["template"] < n_base
                    if not drift(len(own), base):
                        if start >= 0 and _words_between(pieces, start, start + len(own)) == own:
                            places.setdefault((label, base), []).append((start, start + len(own), 1.0))
                        continue
                    lo = max(0, start - MARGIN)
                    for a, b, score in similar_places(own, _words_between(pieces, lo, f["most"] + len(own) + MARGIN)):
                        places.setdefault((label, base), []).append((lo + a, lo + b, score))
                kept = []
                for (label, base), spans in places.items():
                    stop = -1
                    for a, b, score in sorted(spans, key=lambda p: (p[0], -p[1], -p[2])):
                        if base or b > stop:  # a notice inside a longer one of its label is a part of it
                            kept.append({"label": label, "start": a, "stop": b, "score": score, "base": base})
                            stop = b
                out.append(sorted(kept, key=lambda p: (p["start"], p["stop"], p["label"], p["base"])))
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["k", "n_words", "places"])

    return check


def find_licenses(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", base: tuple = BASE_PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """``key``, ``n_words`` and ``places`` (label, start, stop, score, base) of every row.

    Words are runs of lower-cased ASCII letters, digits and non-ASCII characters, counted from 0. A place of ``base`` is
    where a phrase's words stand one after another; all of them are found. A notice of ``LONG`` words or more also matches
    with words changed, left out or put in, at one place or many, as long as a third of its 3-grams are left and its
    similarity is ``SIMILARITY`` or more; shorter ones match exactly. A notice inside a longer one of its label is not
    reported again. Templates may have any length.

    Null and empty texts and texts shorter than a gram have no places; rows that repeat a key or have none are told apart by
    a hash of their text, so copies of one text get the same places; extra columns are ignored; an empty table gives an empty
    result. Templates are the only thing that is broadcast. Texts are never shuffled: grams and the words around hits are.
    """
    spark, templates = eligibilities.sparkSession, [*base, *notices]
    own = eligibilities.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash")).alias("k"), F.col(text).alias("t"))
    kind, table, sizes = own.schema["k"].dataType.simpleString(), template_grams(templates), [len(w) for w in _template_words(templates)]
    drifts = [drift(n, i < len(base)) for i, n in enumerate(sizes)]
    shape = spark.createDataFrame([(i, n, drifts[i]) for i, n in enumerate(sizes)], "template int, size int, drift int")
    known = spark.createDataFrame(table, "hash bigint, template int, spot int").join(F.broadcast(shape), "template")
    grams = own.mapInArrow(_all_grams, f"k {kind}, base int, hashes array<bigint>").select("k", "base", F.posexplode("hashes").alias("i", "hash"))
    hits = grams.join(F.broadcast(known), "hash").select("k", "template", "size", "drift", (F.col("base") + F.col("i") - F.col("spot")).alias("diagonal"), "spot")
    part = F.floor(F.col("spot") / MASK).cast("int").alias("part")
    votes = hits.groupBy("k", "template", "size", "drift", "diagonal", part).agg(F.expr(f"bit_or(shiftleft(1L, spot % {MASK}))").alias("votes"))
    by = Window.partitionBy("k", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > F.col("drift")
    merged = votes.withColumn("group", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by)).groupBy("k", "template", "size", "drift", "group", "part").agg(
        F.bit_count(F.bit_or("votes")).alias("votes"), F.min("diagonal").alias("least"), F.max("diagonal").alias("most"))
    merged = merged.groupBy("k", "template", "size", "drift", "group").agg(F.sum("votes").alias("votes"), F.min("least").alias("least"), F.max("most").alias("most"))
    grams_of = F.col("size") - (GRAM - 1)
    enough = merged.where(F.col("votes") >= F.when(F.col("drift") == 0, grams_of).otherwise(grams_of / 3))
    found = enough.groupBy("k").agg(F.collect_list(F.struct("template", "least", "most")).alias("found"))
    hashes = np.array([h for h, _, _ in table], np.int64).view(np.uint64)
    distinct, which = np.unique(hashes, return_inverse=True)
    reach = np.zeros(len(distinct), np.int64)
    np.maximum.at(reach, which, np.array([MARGIN + drifts[t] for _, t, _ in table], np.int64))
    texts = own.mapInArrow(_evidence(distinct, reach), f"k {kind}, n_words bigint, near array<struct<at:int,words:string>>")
    joined = texts.join(found, texts["k"].eqNullSafe(found["k"]), "left").select(texts["k"], "n_words", "near", "found")
    places = joined.mapInArrow(_verify(templates, len(base)), f"k {kind}, n_words bigint, places array<struct<label:string,start:int,stop:int,score:double,base:boolean>>")
    return places.select(F.col("k.key").alias(key), "n_words", "places")
