"""Near-duplicate eligibility texts by SimHash fingerprints and a generalised pigeonhole search.

Bits that go together are grouped into partitions, and each partition gets its own distance threshold: if the thresholds
sum to ``distance - partitions + 1``, two fingerprints within ``distance`` bits meet at least one of them. A dynamic
programme picks the thresholds with the least estimated work from statistics of all fingerprints, so the plan gets more
selective as the table grows. Texts with one fingerprint meet only once, as one row.

Where a similarity is asked for, bands of min-hashes of 5-word shingles add candidates. Their chance to meet depends on the
Jaccard similarity alone, not on whether the edits are scattered or one block. Sketches only sort out what is far off; every
link is then verified by the exact shingle sets.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.components import connected_components
from trialspark.llm.id_filter import bit_of, id_filter, split, with_bit
from trialspark.llm.text_arrays import LOWER, NOT_SPACE, lists, mix, text_runs, window_hashes, word_hashes, word_spans
from trialspark.session import checkpointed, packed

SHINGLE, DISTANCE, SEED = 4, 4, 42
PROBE_COST, CANDIDATE_COST = 1.0, 0.01  # of shuffling one probe, and of comparing two fingerprints in the join
SKETCH = 4  # longs of a similarity sketch, one bit for each of 256 min-hashes
SLACK = 0.15  # by which a similarity sketched so may fall short: four of its standard deviations
WIDE = 32  # longs of the sketches of texts whose bands meet those of another group; their slack is 0.053
BANDS, BAND = 24, 5  # bands of so many min-hashes: at similarity 0.8 all of them differ for 7 in 100,000 pairs
TURNS = 2  # rounds of one leader a row before all pairs between groups are looked at
HUB = 256  # pairs of one text that one task verifies; those of others are dealt over several
LEADERS = 8  # of each bucket, that all its rows are compared with first
CROWD = 4096  # fingerprints of one bucket that one task compares; a larger bucket is dealt over several

_SALTS = mix(np.arange(1, 64 * WIDE + 1, dtype=np.uint64))
_ODDS = mix(np.arange(1000, 64 * WIDE + 1000, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE, distinct: bool = False) -> np.ndarray:
    """XXH64 of all runs of ``shingle`` words (fewer words: the whole sequence), each once if ``distinct``."""
    if not words:
        return np.zeros(0, np.uint64)
    if shingle == 1 and distinct:
        return np.array([xxhash.xxh64_intdigest(w, SEED) for w in dict.fromkeys(words)], np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    found = (joined[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends[shingle - 1:], strict=False))
    return np.array([xxhash.xxh64_intdigest(g, SEED) for g in (dict.fromkeys(found) if distinct else found)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of 64-bit hashes; zero without any."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.int64)[0])


def _text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of all texts and the n + 1 places where those of each begin."""
    starts, ends, first = word_spans(data, offsets, NOT_SPACE)
    words = word_hashes(data, starts, ends)
    size = np.diff(first)
    at, grams = window_hashes(words, first, 5)
    edge = np.searchsorted(at, first)
    few = np.flatnonzero((size > 0) & (size < 5))  # the whole sequence is the one shingle
    alone = np.array([np.bitwise_xor.reduce(mix(words[first[i]:first[i + 1]] + np.arange(size[i], dtype=np.uint64))) for i in few], np.uint64)
    return np.insert(grams, edge[few], alone), edge + np.searchsorted(few, np.arange(len(size) + 1))


def sketches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every text ``SKETCH`` longs, one bit of each of 64 min-hashes of its 5-word shingles; ``BANDS`` longs, each of
    ``BAND`` whole min-hashes; and whether it has a shingle."""
    grams, edge = _text_shingles(data, offsets)
    n, full = len(edge) - 1, np.flatnonzero(np.diff(edge))
    out, bands = np.zeros((n, SKETCH), np.uint64), np.zeros((n, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    if len(full):
        for j in range(64 * SKETCH):
            least = np.minimum.reduceat((grams ^ _SALTS[j]) * _ODDS[j], edge[full])
            out[full, j // 64] |= (mix(least) & np.uint64(1)) << np.uint64(j % 64)
            if j < BANDS * BAND:
                bands[full, j // BAND] = mix(bands[full, j // BAND] * _ODDS[0] + least)
    return out, bands, np.diff(edge) > 0


def fingerprints(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", shingle: int = SHINGLE, distinct: bool = False,
                 tables: int = 1, sketch: bool = False) -> DataFrame:
    """``key`` and ``fingerprint`` (64 bits as a long) of every whole text, lower-cased (A-Z) and cut at ASCII white space.

    Null and empty texts have fingerprint zero; fewer words than a shingle are one shingle; ``distinct`` counts repeated
    shingles once. More ``tables`` add independent fingerprints of the same shingles (``fingerprint_1`` ...), ``sketch``
    the bits by which the similarity of 5-word shingles is estimated (``sketch_0`` ...) and the array ``bands``.
    """
    extra = [f"fingerprint_{i}" for i in range(1, tables)] + [f"sketch_{i}" for i in range(SKETCH if sketch else 0)]

    def scan(batches):
        for rows, data, offsets in text_runs(batches, 1):
            low = LOWER[data]
            found = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                hashes = shingle_hashes(low[a:b].tobytes().split(), shingle, distinct)
                found.append([fingerprint(hashes), *(fingerprint(mix(hashes + np.uint64(i))) for i in range(1, tables))])
            columns = np.array(found, np.int64).reshape(-1, tables)
            more = []
            if sketch:
                bits, bands, some = sketches(low, offsets)
                columns = np.hstack([columns, bits.view(np.int64)])
                more = [lists(some * BANDS, pa.array(bands[some].ravel().view(np.int64)))]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in columns.T), *more],
                                             [rows.schema.names[0], "fingerprint", *extra, *["bands"][:len(more)]])

    own = eligibilities.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = ", ".join([f"k {own.schema['k'].dataType.simpleString()}", *(f"{c} bigint" for c in ("fingerprint", *extra)), *["bands array<bigint>"][:sketch]])
    return own.mapInArrow(scan, schema).withColumnRenamed("k", key)


def bit_moments(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and the 64 x 64 sums of products of the bits as -1 and 1 with a 65th that is always 1."""

    def gather(batches):
        total = np.zeros((65, 65))
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
            x = np.hstack([bits, np.ones((len(bits), 1), np.float32)])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()])], ["m"])

    sums = np.zeros((65, 65), np.int64)
    for row in prints.select("fingerprint").mapInArrow(gather, "m binary").collect():  # one small matrix for each partition
        sums += np.frombuffer(row.m, np.int64).reshape(65, 65)
    return int(sums[64, 64]), sums


def group_bits(n: int, sums: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the 64 bits into ``parts`` groups of nearly equal size, each grown around the bit that is most correlated."""
    mean = sums[64, :64] / max(n, 1)
    cov = sums[:64, :64] / max(n, 1) - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    free, groups = list(range(64)), []
    for g in range(parts):
        size = len(free) // (parts - g)
        own = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (near[b, own].sum(), -b)))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def chance_within(n: int, sums: np.ndarray, bits: list[int], limit: int) -> list[float]:
    """Chance that two fingerprints differ in at most 0..limit of ``bits``.

    Mean and variance of that distance follow exactly from the moments of all rows; a beta-binomial is fitted to them.
    """
    w, mean = len(bits), sums[64, bits] / max(n, 1)
    joint = sums[np.ix_(bits, bits)] / max(n, 1)
    mu, var = float((1 - mean**2).sum() / 2), float((joint**2 - np.outer(mean**2, mean**2)).sum() / 4)
    p = min(max(mu / w, 1e-6), 1 - 1e-6)
    ratio = min(max(var / (w * p * (1 - p)), 1 + 1e-6), w - 1e-6)
    size = (w - ratio) / (ratio - 1)
    a, b = p * size, (1 - p) * size
    beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
    chances = [comb(w, d) * np.exp(beta(d + a, w - d + b) - beta(a, b)) for d in range(limit + 1)]
    return np.clip(np.nan_to_num(np.cumsum(chances), nan=1.0), 0, 1).tolist()  # too few rows to tell: anything may happen


def allocate(n: int, sums: np.ndarray, distance: int = DISTANCE, most: int = 8) -> list[tuple[list[int], int]]:
    """Partitions of the bits and their thresholds (partitions with threshold -1 are left out) with the least cost.

    For each number of partitions, a dynamic programme over (partition, threshold sum left) weighs probes and estimated
    candidates; the cheapest number wins.
    """
    n, best, chosen = max(n, 2), float("inf"), []
    for parts in range(1, most + 1):
        groups, total = group_bits(n, sums, parts), distance - parts + 1
        table = {0: (0.0, [])}  # sum of (threshold + 1) so far -> cost, thresholds
        for bits in groups:
            top = min(distance, len(bits) - 1, 2)  # beyond two flipped bits, probes are never worth it
            within = chance_within(n, sums, bits, top)
            cost = [0.0] + [n * PROBE_COST * sum(comb(len(bits), j) for j in range(t + 1)) + CANDIDATE_COST * n * n / 2 * within[t] for t in range(top + 1)]
            step = {}
            for used, (spent, ts) in table.items():
                for t in range(-1, top + 1):
                    if (s := used + t + 1) <= distance + 1 and spent + cost[t + 1] < step.get(s, (float("inf"),))[0]:
                        step[s] = (spent + cost[t + 1], [*ts, t])
            table = step
        cost, thresholds = table.get(total + parts, (float("inf"), []))
        if cost < best:
            best, chosen = cost, [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]
    return chosen


def _flip(part: int, own):
    return lambda m: F.struct(F.lit(part).cast("byte").alias("part"), own.bitwiseXOR(m).alias("value"))


def _signatures(plan: list[tuple[list[int], int]], near: bool):
    """SQL array of the bucket keys of a fingerprint: its own value in every partition, and with ``near`` the values
    that differ from it in up to the threshold."""
    keys = []
    for part, (bits, t) in enumerate(plan):
        mask = sum(1 << b for b in bits)
        own = F.col("fingerprint").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        flips = [c for j in range((t if near else 0) + 1) for c in combinations(bits, j)]
        masks = [sum(1 << b for b in c) for c in flips]
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
        keys.append(F.transform(masks, _flip(part, own)))
    return F.flatten(F.array(*keys))


def _keyed(rows: DataFrame, plan: list[tuple[list[int], int]] | None, near: bool) -> DataFrame:
    """Every row once for each of its buckets: those of the plan, or without one its bands."""
    if plan is None:
        return rows.select(*_plain(rows), F.lit(0).cast("byte").alias("part"), F.explode("bands").alias("value"))
    return rows.select("*", F.explode(_signatures(plan, near)).alias("k")).select(*rows.columns, "k.part", "k.value")


def _plain(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c != "bands"]


def _close(columns: list[str], distance: int, similarity: float | None):
    """Whether rows ``a`` and ``b`` are linked by their fingerprints, where they have any, and if asked may be by their sketches."""
    close = _apart("fingerprint") <= distance if "fingerprint" in columns else F.lit(True)
    if similarity is None:
        return close
    longs = sum(c.startswith("sketch") for c in columns)
    return close & (_sketched(columns) <= int((1 - similarity + SLACK * (SKETCH / longs) ** 0.5) / 2 * 64 * longs))


def _apart(column: str):
    return F.bit_count(F.col(f"a.{column}").bitwiseXOR(F.col(f"b.{column}")))


def _sketched(columns: list[str]):
    bits = [c for c in columns if c.startswith("sketch")]
    return sum((_apart(c) for c in bits[1:]), _apart(bits[0]))


def leader_links(rows: DataFrame, plan: list[tuple[list[int], int]], distance: int, similarity: float | None, leaders: int = LEADERS) -> DataFrame:
    """Links (a, b) of every row to at most ``leaders`` rows of each of its buckets.

    They join most of a crowd of near copies with a few links each, so that the search for all links, which follows, need
    not look at pairs inside it.
    """
    keyed = _keyed(rows, plan, near=False)
    chosen = keyed.groupBy("part", "value", F.pmod(F.xxhash64("id"), F.lit(leaders)).alias("seat")).agg(F.min(F.struct(*rows.columns)).alias("r"))
    a, b = keyed.alias("a"), chosen.select("part", "value", "r.*").alias("b")
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.id") != F.col("b.id"))
    found = a.join(b, same & _close(rows.columns, distance, similarity))
    return found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def closest_leaders(rows: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b) of every ``node`` and the closest of the leaders of its bands that has another ``id``.

    The first leader of a band is the text whose bands most texts share, so that a crowd of copies meets what they were made
    of; each later ``turn`` draws another. One pair a row joins most of a crowd of near copies.
    """
    keyed = _keyed(rows, None, near=False)
    own = _plain(rows)
    drawn = F.min(F.struct((F.xxhash64("node", F.lit(turn)) if turn else -F.col("weight")).alias("h"), *own)).alias("r")
    chosen = keyed.groupBy("value").agg(drawn, F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("value", "r.*")
    met = keyed.alias("a").join(chosen.alias("b"), (F.col("a.value") == F.col("b.value")) & (F.col("a.id") != F.col("b.id")) & _close(own, 0, similarity))
    best = met.groupBy(F.col("a.node").alias("n")).agg(F.min(F.struct(_sketched(own).alias("d"), F.col("b.node").alias("m"))).alias("r"))
    return best.select(F.least("n", "r.m").alias("a"), F.greatest("n", "r.m").alias("b")).distinct()


def shared_bands(one: DataFrame) -> DataFrame:
    """(id, bands, weight): for every ``id`` the bands that another one has too, and how many rows share them."""
    keys = one.select("id", F.explode("bands").alias("value"))
    shared = keys.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("value", "n")
    return keys.join(shared, "value").groupBy("id").agg(F.collect_set("value").alias("bands"), F.sum("n").alias("weight"))


def contested(rows: DataFrame) -> DataFrame:
    """(node, id, bands): of every row the bands that a row with another ``id`` has too."""
    keys = rows.select("node", "id", F.explode("bands").alias("value"))
    met = keys.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("value")
    return keys.join(met, "value").groupBy("node", "id").agg(F.collect_set("value").alias("bands"))


def shingle_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(k, grams): the distinct 5-word shingles, sorted, of every text of ``texts`` (k, t) whose key is in ``ids`` (k)."""
    wanted = id_filter(ids)

    def scan(batches):
        for rows, data, offsets in text_runs(with_bit(batches, 2, wanted, True), 1):
            grams, edge = _text_shingles(LOWER[data], offsets)
            sets = [np.unique(grams[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            values = pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists(np.array([len(x) for x in sets], np.int64), values)], ["k", "grams"])

    found = texts.withColumn("b", bit_of("k")).mapInArrow(scan, f"k {texts.schema['k'].dataType.simpleString()}, grams array<bigint>")
    return found.join(ids, "k", "left_semi").dropDuplicates(["k", "grams"])


def wide_sketches(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(k, sketch_0 ...): ``WIDE`` longs for every text of ``texts`` (k, t) with a shingle whose key is in ``ids`` (k)."""
    wanted = id_filter(ids)
    names = [f"sketch_{i}" for i in range(WIDE)]

    def scan(batches):
        for rows, data, offsets in text_runs(with_bit(batches, 2, wanted, True), 1):
            grams, edge = _text_shingles(LOWER[data], offsets)
            full = np.flatnonzero(np.diff(edge))
            out = np.zeros((WIDE, len(full)), np.uint64)
            if len(full):
                for j in range(64 * WIDE):
                    least = np.minimum.reduceat((grams ^ _SALTS[j]) * _ODDS[j], edge[full])
                    out[j // 64] |= (mix(least) & np.uint64(1)) << np.uint64(j % 64)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(full)), *(pa.array(c.view(np.int64)) for c in out)], ["k", *names])

    schema = ", ".join([f"k {texts.schema['k'].dataType.simpleString()}", *(f"{c} bigint" for c in names)])
    return texts.withColumn("b", bit_of("k")).mapInArrow(scan, schema).join(ids, "k", "left_semi").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float, hub: int = HUB) -> DataFrame:
    """Of ``pairs`` (a, b) those whose texts in ``texts`` (k, t) have a Jaccard similarity of 5-word shingles of ``similarity``.

    Runs jobs; ``pairs`` are best checkpointed. A text of more than ``hub`` pairs is repeated, and its pairs are dealt over
    the copies.
    """
    sets = checkpointed(shingle_sets(texts, pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()))
    for side, other in (("b", "a"), ("a", "b")):
        hubs = checkpointed(pairs.groupBy(side).count().where(F.col("count") > hub).select(F.col(side).alias("k"), F.ceil(F.col("count") / hub).cast("int").alias("salts")))
        own, met = sets.select("k", F.col("grams").alias(f"{side}_grams")), pairs
        if hubs.isEmpty():
            own, met = own.withColumn("salt", F.lit(0)), met.withColumn("salt", F.lit(0))
        else:
            salted = F.coalesce("salts", F.lit(1))
            own = own.join(hubs, "k", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salted - 1))).drop("salts")
            met = met.join(hubs.withColumnRenamed("k", side), side, "left").withColumn("salt", F.pmod(F.xxhash64(other), salted).cast("int")).drop("salts")
        pairs = met.join(own.withColumnRenamed("k", side), [side, "salt"]).drop("salt")

    def alike(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = np.concatenate((x, y))
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good.append(same >= similarity * (len(both) - same) - 1e-9 * len(both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    kind = texts.schema["k"].dataType.simpleString()
    return pairs.select("a", "b", "a_grams", "b_grams").mapInArrow(alike, f"a {kind}, b {kind}").distinct()


def similar_links(one: DataFrame, views: list[DataFrame], texts: DataFrame, distance: int, similarity: float) -> DataFrame:
    """Links (a, b) between texts of ``similarity`` that join the same groups as all such links would.

    First every text is verified against one leader in each of ``TURNS`` rounds, then all pairs that share a band or are near
    in a fingerprint and do not belong to one group yet. Texts whose bands still meet another group get wide sketches, so that
    of a crowd of texts which are not quite similar few pairs are left to verify.
    """
    sketch = [c for c in one.columns if c.startswith("sketch")]
    banded = checkpointed(one.select("id", *sketch).join(shared_bands(one), "id"))
    links = known = None

    def grouped(rows):
        rows = rows.withColumnRenamed("id", "node")
        if known is None:
            return rows.withColumn("id", F.col("node"))
        return rows.join(known.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left").select(
            F.coalesce("component", "node").alias("id"), *rows.columns)

    for turn in range(TURNS):
        found = packed(checkpointed(similar_pairs(packed(checkpointed(closest_leaders(grouped(banded), similarity, turn))), texts, similarity)))
        links = found if links is None else links.unionByName(found)
        known = connected_components(links)
    left = checkpointed(contested(grouped(banded)))
    wide = wide_sketches(texts, left.select(F.col("node").alias("k")).distinct()).withColumnRenamed("k", "node")
    pairs = group_links(checkpointed(left.join(wide, "node")), None, distance, similarity, each="node")
    for view in views:
        pairs = pairs.unionByName(group_links(grouped(view), allocate(*bit_moments(view), distance), distance, similarity, each="node"))
    pairs = packed(checkpointed(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    return links.unionByName(similar_pairs(pairs, texts, similarity))


def group_links(rows: DataFrame, plan: list[tuple[list[int], int]] | None, distance: int, similarity: float | None, crowd: int = CROWD,
                each: str = "id") -> DataFrame:
    """Distinct pairs (a, b) of ``each`` of rows with different values of ``id`` which are linked.

    Any two linked rows share the bucket of some partition: one with its own value, the other with one within the
    partition's threshold. They are compared inside the join, which only puts out links between different ids. A bucket of
    more than ``crowd`` rows is dealt over several salts on one side and repeated on the other.
    """
    residents, probes = _keyed(rows, plan, near=False), _keyed(rows, plan, near=True)
    crowds = checkpointed(residents.groupBy("part", "value").count().where(F.col("count") > crowd)
                          .select("part", "value", F.ceil(F.col("count") / crowd).cast("int").alias("salts")))
    salted = F.coalesce("salts", F.lit(1))
    if crowds.isEmpty():
        residents, probes = residents.withColumn("salt", F.lit(0)), probes.withColumn("salt", F.lit(0))
    else:
        residents = residents.join(crowds, ["part", "value"], "left").withColumn("salt", F.pmod(F.xxhash64(*_plain(rows)), salted).cast("int"))
        probes = probes.join(crowds, ["part", "value"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salted - 1)))
    a, b = probes.alias("a"), residents.alias("b")
    same = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.salt") == F.col("b.salt"))
    found = a.join(b, same & (F.col("a.id") < F.col("b.id")) & _close(rows.columns, distance, similarity))
    return found.select(F.col(f"a.{each}").alias("a"), F.col(f"b.{each}").alias("b")).distinct()


def near_duplicates(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", shingle: int = SHINGLE, distance: int = DISTANCE,
                    distinct: bool = False, tables: int = 1, similarity: float | None = None) -> DataFrame:
    """``key``, ``fingerprint`` and ``component`` of every row.

    ``component`` is the least key that a chain of links reaches, its own included. Without ``similarity`` a link takes at
    most ``distance`` differing bits of the fingerprint. With it, a link takes that Jaccard similarity of 5-word shingles,
    verified by the shingle sets (64-bit hashes); candidates share a band of min-hashes, which 7 in 100,000 pairs of
    similarity 0.8 do not, whatever the shape of the edits, or are near in one of ``tables`` fingerprints.

    Null and empty texts share fingerprint zero and are linked like any other; rows with a null key are left out; repeated
    rows are repeated; extra columns are ignored. Every text is read once: signatures are checkpointed in the shared folder.
    """
    own = eligibilities.where(F.col(key).isNotNull())
    prints = checkpointed(fingerprints(own, key=key, text=text, shingle=shingle, distinct=distinct, tables=tables,
                                       sketch=similarity is not None).withColumnRenamed(key, "k"))
    signature = [c for c in prints.columns if c not in ("k", "bands")]
    one = prints.groupBy(*signature).agg(F.min("k").alias("id"), *([F.min_by("bands", "k").alias("bands")] if similarity is not None else []))
    one = checkpointed(one)
    sketch = [c for c in signature if c.startswith("sketch")]
    views = [one.select("id", F.col(c).alias("fingerprint"), *sketch) for c in signature if c not in sketch]
    if similarity is None:
        plan = allocate(*bit_moments(one), distance)
        links = checkpointed(leader_links(views[0], plan, distance, None))
        known = connected_components(links)
        grouped = views[0].join(known, F.col("id") == F.col("node"), "left").select(F.coalesce("component", "id").alias("id"), "fingerprint")
        links = links.unionByName(group_links(grouped, plan, distance, None))
    else:
        links = similar_links(one, views, own.select(F.col(key).alias("k"), F.col(text).alias("t")), distance, similarity)
    groups = connected_components(links)
    joined = one.join(groups, F.col("id") == F.col("node"), "left").select(*signature, F.coalesce("component", "id").alias("component"))
    return prints.join(joined, signature).select(F.col("k").alias(key), "fingerprint", "component")


def drop_near_duplicates(eligibilities: DataFrame, *, key: str = "nct_id", text: str = "criteria", **options) -> DataFrame:
    """``eligibilities``, all columns kept, with only the row of the least key of every component of ``near_duplicates``.

    Rows without a key stay, and rows that repeat a kept key stay with it. Only rows that a bit table of fixed size does not
    rule out are shuffled.
    """
    columns = eligibilities.columns
    copies = checkpointed(near_duplicates(eligibilities, key=key, text=text, **options).where(F.col(key) != F.col("component")).select(F.col(key).alias("__k")).distinct())
    others, doubtful = split(eligibilities, key, copies)
    kept = doubtful.join(copies, F.col(f"c{columns.index(key)}") == F.col("__k"), "left_anti")
    return others.unionByName(kept).toDF(*columns)
