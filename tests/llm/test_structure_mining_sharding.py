"""Conversation repair, hard negatives and sharding against plain Python, and the cases that tables may hold."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from trialspark.llm import hard_negatives
from trialspark.llm.conversations import DONE, repair_conversations, run_matrix, solve, transcript_digests
from trialspark.llm.hard_negatives import hilbert, interval_bounds, mine_hard_negatives
from trialspark.llm.registered import QUERIES
from trialspark.llm.sharding import shard_texts

TURNS = "conv_id long, turn long, role string, text string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# -- conversations ---------------------------------------------------------------------------------------------------------


def inserted(best):
    best = dict(best)
    for _ in range(4):
        for place, (cost, audit) in list(best.items()):
            new = (cost + 2, audit + "I")
            if new < best.get(NEXT[place], (1 << 30,)):
                best[NEXT[place]] = new
    return best


def cheapest(rows):
    """Rows of (initial, must go, cut off): the least (cost, audit) of all edits, place by place in the pattern."""
    best = {"": (0, "")}
    for initial, gone, cut in rows:
        after = {}
        for place, (cost, audit) in inserted(best).items():
            ways = [(place, 3, "D")]
            if not gone:
                ways.append((NEXT[place], 2 + cut, "R"))
                if initial == "s" and place == "" or initial == NEXT[place]:
                    ways.append((initial, cut, "K"))
            for to, paid, edit in ways:
                after[to] = min(after.get(to, (1 << 30,)), (cost + paid, audit + edit))
        best = after
    best = inserted(best)
    return min(best[p] for p in ("", "a") if p in best)


def repaired(rows):
    """What the operator and the digests give for each key, one conversation after the other."""
    found = defaultdict(list)
    for key, turn, role, text in rows:
        found[key].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for key, lines in found.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, symbols, faults = set(), [], Counter()
        for _, role, text in lines:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(symbols)
        left, place, lasting = iter(lines), "", []
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else next(left)
            if edit != "D":
                place = role[0] if edit == "K" else NEXT[place]
                lasting.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[place]}:{text}")
        out[key] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lasting).encode()).hexdigest())
    return out


def got_repaired(df):
    repair = repair_conversations(df)
    digests = {r.conv_id: r.sha256 for r in transcript_digests(repair.transcript).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {r[0]: (*tuple(r)[1:], digests.get(r[0], nothing)) for r in repair.report.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}


def test_programme_equals_search_over_all_places():
    rng = random.Random(3)
    for _ in range(3000):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        symbols = [0 if gone else 1 + 2 * "xsua".index(initial) + cut for initial, gone, cut in rows]
        runs = tuple((s, len(list(g))) for s, g in itertools.groupby(symbols))
        audit, end, cost, put, _ = solve(runs, 0, DONE)
        assert (cost, audit) == cheapest(rows) and len(put) == len(audit) - audit.count("D") and end in (0, 3)


def test_long_runs_take_powers_and_pieces_join():
    runs = ((5, 10**15), (0, 10**17), (8, 3))  # so many users cannot be walked one by one
    whole, left, right = run_matrix(runs), run_matrix(runs[:1]), run_matrix(runs[1:])
    assert whole == [[min(1 << 60, min(left[i][k] + right[k][j] for k in range(4))) for j in range(4)] for i in range(4)]
    few = [("u", False, 0)] * 6 + [("a", True, 0)] * 5 + [("a", False, 1)] * 3
    assert min(whole[0][j] + DONE[j] for j in range(4)) - 10**15 - 3 * 10**17 == cheapest(few)[0] - 6 - 3 * 5  # every further user costs 1 on average


def test_repair_of_odd_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."), (2, 5, "assistant", "cut off"), (2, 9, "user", "Now."), (3, None, "user", "A."),
            (3, None, "user", "A."), (3, 0, "assistant", "B! \n\t"), (None, 1, "user", "C?"), (None, 2, None, "D."), (None, 3, "", "E."), (None, None, "assistant", None),
            (4, 1, "user", " \r\n"), (5, 1, "system", "Alone."), (6, 2, "tool", "x" * 300_000), (6, 2**62, "user", "."), (6, -(2**62), "user", " "), (7, 1, "assistant", ""),
            (8, 1, "User", "Big."), (8, 2, "assistant", "a:b\nc."), (9, 1, "user", "Z."), (9, 1, "user", "Z."), (9, 2, "assistant", "Z.")]
    clashing = spark.createDataFrame([(*r, 1, "x", 2, True) for r in rows], TURNS + ", k int, audit string, n int, blank boolean")
    assert got_repaired(clashing) == repaired(rows)
    assert got_repaired(spark.createDataFrame([], TURNS)) == {}


def test_repair_of_a_conversation_over_many_partitions(many_partitions):
    rng = random.Random(8)
    lines = ["Yes.", "No!", "", "Cut", "Why?"]
    hot = [(1, i // 2 if i % 7 else None, rng.choice(["user", "assistant", "system", "tool"]), f"{rng.choice(lines)}{i % 900}" + rng.choice(["", ".", "."])) for i in range(2000)]
    hot = list({(t, r, x): (k, t, r, x) for k, t, r, x in hot}.values())
    hot = list({t if t is not None else -1: row for row in hot for t in [row[1]]}.values()) + [(1, 5000, "user", "Same.")] * 700  # one row a turn but for copies
    small = [(k, t, rng.choice(["user", "assistant"]), rng.choice(lines)) for k in range(2, 400) for t in range(rng.randint(1, 5))]
    rows = hot + small
    rng.shuffle(rows)
    df = many_partitions.createDataFrame(rows, TURNS).repartition(5)
    assert got_repaired(df) == repaired(rows)


def test_conversations_query(spark):
    sf = "/root/testdata/sf0.001"
    rows, ids = [], set()
    for key, turn, role, text in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        ids.add(key)
        fault = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        rows += [(key, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    want = repaired(rows) | {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in ids - {r[0] for r in rows}}
    got = QUERIES["op11_conversations"](spark, sf)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got.collect()} == want


# -- hard negatives --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2), (1, 5)])
def test_neighbours_on_the_curve_are_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    place = [r.tobytes() for r in hilbert(cells, bits)]
    assert len(set(place)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=place.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(2)
    data, anchors = rng.integers(-500, 500, (200, 6)), rng.integers(-500, 500, (50, 6))
    low, high = interval_bounds(anchors, data.min(0)[None], data.max(0)[None])
    scores = anchors @ data.T
    assert (scores >= low).all() and (scores <= high).all()


def mined(rows, asked, positives=5, negatives=10):
    usable = lambda r: None not in r[:3] and len(r[2]) and all(x is not None and np.isfinite(x) for x in r[2])
    whole = lambda v: [int(np.floor(256.0 * x)) for x in v]
    data = [(k, label, whole(v)) for k, label, v in filter(usable, rows)]
    first = {}
    for k, label, v in filter(usable, asked):
        first[k] = min(first.get(k, (label, whole(v))), (label, whole(v)))
    out = []
    for a, (label, v) in first.items():
        ranked = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), k, other) for k, other, w in data if k != a)
        for s, k, _ in [r for r in ranked if r[2] == label][:positives]:
            fit = [(n, -t) for t, n, other in ranked if other != label and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, k, i + 1, n, -s, t) for i, (n, t) in enumerate(fit)]
    return sorted(out)


def got_mined(spark, rows, asked=None):
    schema = "nct_id long, label_binary int, features array<double>"
    df = spark.createDataFrame(rows, schema)
    found = mine_hard_negatives(df, spark.createDataFrame(asked, schema) if asked is not None else df)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_of_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "RUN", 8)
    monkeypatch.setattr(hard_negatives, "PART", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 5))
    rows = [(i, int(rng.integers(3)), (centres[i % 12] + 0.2 * rng.normal(size=5)).round(2).tolist()) for i in range(600)]
    assert got_mined(spark, rows, rows[::9]) == mined(rows, rows[::9])


def test_blocks_are_left_unread_where_bounds_allow(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(hard_negatives, "BLOCK", 50)
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, (np.eye(4)[i % 4] * (1 + rng.random())).round(3).tolist()) for i in range(800)]
    df = spark.createDataFrame(rows, "nct_id long, label long, v array<double>")
    data = hard_negatives.quantised(df.selectExpr("nct_id AS k", "v"), key="k", vector="v", scale=256.0).join(df.selectExpr("nct_id AS k", "label"), "k").select("k", "label", "v")
    path, zones = hard_negatives.write_blocks(data, 4)
    zones = zones.collect()
    inside = spark.read.parquet(path).groupBy("block").count().collect()
    assert sum(r["count"] for r in inside) == 800 == sum(sum(z.counts) for z in zones)
    least, most = interval_bounds(np.array([[256, 0, 0, 0]]), np.array([z.low for z in zones]), np.array([z.high for z in zones]))
    assert (most[0] < 200).sum() > len(zones) / 2  # blocks of the other three directions


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, 0.0]), (2, 0, [0.5, 0.5]), (2, 0, [0.5, 0.5]), (3, 1, [0.25, 0.1]), (3, 1, [0.25, 0.1]), (4, 1, [0.4, 0.2]), (5, None, [1.0, 1.0]), (6, 1, None),
            (7, 1, [nan, 1.0]), (8, 1, [inf, 1.0]), (9, 1, [None, 1.0]), (None, 1, [0.4, 0.2]), (10, 1, []), (11, 2, [-1.0, 0.0]), (12, 2, [0.0, 0.0]), (13, 2, [0.0, 0.0]),
            (14, 3, [0.3, 0.1]), (1, 1, [0.3, 0.3])]
    assert got_mined(spark, rows) == mined(rows, rows)
    assert got_mined(spark, []) == [] and got_mined(spark, rows, []) == []
    schema = "nct_id long, label_binary int, features array<double>, k int, v string, label int, block int, a int, rank int"
    clashing = spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], schema)
    assert sorted(tuple(r) for r in mine_hard_negatives(clashing, clashing).collect()) == mined(rows, rows)
    with pytest.raises(ValueError, match="components"):
        got_mined(spark, [(1, 0, [1.0]), (2, 0, [1.0, 2.0])])


# -- sharding --------------------------------------------------------------------------------------------------------------


def sharded(spark, rows, schema="nct_id long, criteria string, gender string", **options):
    return [tuple(r) for r in shard_texts(spark.createDataFrame(rows, schema), **options).select("nct_id", "n_bytes", "checksum", "shard", "slot").collect()]


def test_shards_match_the_mixture_and_are_even(many_partitions):
    rng = random.Random(4)
    rows = [(i, f"text {i} é", "hot" if i % 3 == 0 else f"s{rng.randint(0, 20)}" if i % 5 else f"once{i}") for i in range(5003)]
    got = sharded(many_partitions, rows)
    shard = {k: s for k, _, _, s, _ in got}
    counts, source = Counter(shard.values()), {r[0]: r[2] for r in rows}
    assert set(shard) == set(source) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 16
    for s in range(16):
        assert sorted(slot for *_, at, slot in got if at == s) == list(range(counts[s]))
        share = Counter(source[k] for k, at in shard.items() if at == s)
        assert abs(share["hot"] / counts[s] - 1 / 3) < 0.02
    assert all(n == len(f"text {k} é".encode()) and c == zlib.crc32(f"text {k} é".encode()) for k, n, c, *_ in got)
    assert sorted(sharded(many_partitions, rows[::-1])) == sorted(got)
    assert sorted(sharded(many_partitions, rows, seed=7)) != sorted(got)


def test_shards_of_odd_rows(spark):
    rows = [(1, None, None), (None, "a", "x"), (None, "a", "x"), (None, "b", "x"), (2, "", ""), (3, "ß" * 100_000, "x")] + [(4, "copy", "x")] * 9000
    got = sharded(spark, rows)
    assert Counter((k, n, c) for k, n, c, *_ in got) == Counter((k, len((t or "").encode()), zlib.crc32((t or "").encode())) for k, t, _ in rows)
    assert len({(s, slot) for *_, s, slot in got}) == len(rows)
    assert sharded(spark, []) == []
    clashing = [(*r, 1, "h", 2, 3) for r in rows[:6]]
    assert len(sharded(spark, clashing, "nct_id long, criteria string, gender string, k int, h string, n int, rows int")) == 6
    assert len(sharded(spark, clashing, "nct_id long, criteria string, gender string, k int, h string, n int, rows int", stratum=("gender", "h"), shards=3)) == 6
