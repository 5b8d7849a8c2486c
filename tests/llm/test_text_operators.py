"""Word arrays, licenses, passages, decontamination and near-duplicates against plain Python on small and given tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from trialspark.llm import decontamination, simhash
from trialspark.llm.components import connected_components
from trialspark.llm.decontamination import find_contamination, remove_contamination
from trialspark.llm.licenses import BASE_PHRASES, NOTICES, find_licenses
from trialspark.llm.passages import candidate_pairs, compact_windows, exact_pairs, remove_repeats, repeated_passages
from trialspark.llm.registered import QUERIES
from trialspark.llm.text_arrays import column_bytes, window_hashes, word_hashes, word_spans

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = "nct_id long, criteria string, n_words string, k int, t int, spans string, fingerprint int, places int, item_ids int, score string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def texts(spark, rows, schema="nct_id long, criteria string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, 4, 5, "z") for i, t in rows], CLASH)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(n))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz 9.\n-éß中𝔘\t", max_size=40)), max_size=8), st.integers(1, 4))
def test_words_and_windows_equal_plain_python(rows, k):
    data, offsets = column_bytes(pa.array(rows, pa.string()))
    from trialspark.llm.text_arrays import LOWER as TABLE

    starts, ends, first = word_spans(TABLE[data], offsets)
    got = [TABLE[data][a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    want = [words(t) for t in rows]
    assert [got[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == want
    hashes = word_hashes(TABLE[data], starts, ends)
    assert len({int(h) for h in hashes}) == len(set(got))
    at, values = window_hashes(hashes, first, k)
    flat = [(i, tuple(w[i:i + k])) for w in want for i in range(len(w) - k + 1)]
    assert len(at) == len(flat) and len({int(v) for v in values}) == len({w for _, w in flat})


# -- license scans ---------------------------------------------------------------------------------------------------------


def base_places(text):
    w = words(text)
    return sorted((i, label) for label, phrase in BASE_PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())


def test_licenses_small_cases(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the Software), to deal in the Software without restriction")
    cases = {
        1: None, 2: "", 3: "Mit", 4: "Released UNDER the MIT-License. cc by nc cc by nc", 5: "Apache License, Version 2.0 and cc-by-nc 4.0",
        6: mit.replace("obtaining", "receiving").replace("a copy", "any one copy"), 7: prose(20_000, 1) + " under the mit license " + prose(20_000, 2),
        8: "under the mit", 9: "license under the mit licens", 10: mit[:60], 11: "under under the mit license license",
    }
    rows = list(cases.items()) + [(4, cases[4]), (None, "cc by nc")]
    got = find_licenses(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "cc by nc" if r.nct_id is None else cases[r.nct_id]
        assert [(p.start, p.label) for p in r.places if p.base] == base_places(text)
        assert r.n_words == len(words(text)) and all(0 <= p.score <= 1 for p in r.places)
    by = {r.nct_id: {p.label for p in r.places} for r in got}
    assert by[6] == {"mit"} and by[10] == set() and by[8] == set() and by[3] == set()
    assert find_licenses(clashing(spark, [])).count() == 0


MIT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
       "documentation files the software to deal in the software without restriction").split()


def edited(own, kind, n, at):
    """A notice with ``n`` words put in, left out or changed at one place, or one after every third word put in."""
    if kind == "in":
        return [*own[:at], *prose(n, n).split(), *own[at:]]
    if kind == "out":
        return [*own[:at], *own[at + n:]]
    if kind == "changed":
        return [*own[:at], *prose(n, n).split(), *own[at + n:]]
    return [w for i, o in enumerate(own) for w in ((o, "zzz") if i % 4 == 3 and i + 1 < len(own) else (o,))]


def test_licenses_with_edits_and_long_templates(spark):
    rng = random.Random(4)
    long = [f"w{rng.randrange(400)}" for _ in range(200)]
    notices = (("mit", " ".join(MIT)), ("long", " ".join(long)))
    cases = {}
    for own, label in ((MIT, "mit"), (long, "long")):
        for kind, share in (("in", 0.05), ("in", 0.28), ("in", 0.45), ("out", 0.1), ("out", 0.3), ("changed", 0.1), ("changed", 0.19), ("spread", 0)):
            for at in (5, len(own) // 2):
                inner = edited(own, kind, max(1, int(share * len(own))), at)
                cases[len(cases)] = (label, [*prose(40, 7).split(), *inner, *prose(30, 8).split()], 40, 40 + len(inner))
    two = [*MIT, *prose(3, 9).split(), *edited(MIT, "in", 4, 9)]
    rows = [(i, " ".join(w)) for i, (_, w, _, _) in cases.items()] + [(1000, " ".join(two))] + [(None, " ".join(MIT)), (None, "free of charge to any person"), (None, " ".join(MIT))]
    got = find_licenses(texts(spark, rows), notices=notices).collect()
    by = {r.nct_id: r for r in got if r.nct_id is not None}
    for i, (label, _, start, stop) in cases.items():
        assert [(p.label, p.start, p.stop) for p in by[i].places] == [(label, start, stop)], i
    assert [(p.start, p.stop) for p in by[1000].places] == [(0, len(MIT)), (len(MIT) + 3, len(two))]
    assert sorted(len(r.places) for r in got if r.nct_id is None) == [0, 1, 1]
    whole = find_licenses(texts(spark, [(1, " ".join(MIT)), (2, dict(NOTICES[13:])["mit"])])).collect()
    assert {r.nct_id: [(p.label, p.start) for p in r.places] for r in whole} == {1: [("mit", 0)], 2: [("mit", 0)]}


def test_license_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op1_licenses"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, text in docs.items():
        places = base_places(text)
        r = got[i]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r.base_labels == ",".join(sorted({p for _, p in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


# -- decontamination -------------------------------------------------------------------------------------------------------

ITEMS = [(1, prose(30, 5)), (2, "Short Item"), (3, None), (4, ""), (5, prose(30, 5)), (6, prose(12, 6)), (None, prose(12, 8)), (2, "Short Item")]


@pytest.mark.parametrize("values", [1, 3, 1 << 62])
def test_benchmark_windows_with_colliding_hashes(monkeypatch, values):
    plain = decontamination.window_hashes
    monkeypatch.setattr(decontamination, "window_hashes", lambda *a: (plain(*a)[0], plain(*a)[1] % np.uint64(values)))
    rng = random.Random(values)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, some(rng.randint(0, 7))) for i in range(40)] + [(40, None), (41, "a a a a a a a a")]
    docs = [some(rng.randint(0, 60)) for _ in range(20)] + ["", "a " * 30]
    data, offsets = column_bytes(pa.array(docs))
    hits, *_ = decontamination._hits(data, offsets, decontamination.window_block(items, 4))
    for i, text in enumerate(docs):
        own = [h for h in hits if h[0] == i]
        _, hit, names = contaminated(text, items, 4)
        assert {w for _, a, k, _ in own for w in range(a, a + k)} == hit and sorted({int(x) for h in own for x in h[3]}) == names


def contaminated(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for i, t in items:
        v = words(t)
        if i is None or not v:
            continue
        k = min(window, len(v))
        grams = {tuple(v[j:j + k]) for j in range(len(v) - k + 1)}
        for j in range(len(w) - k + 1):
            if tuple(w[j:j + k]) in grams:
                hit.update(range(j, j + k))
                names.add(i)
    return len(w), hit, sorted(names)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_contamination_equals_brute_force_in_one_and_many_blocks(spark, block):
    part = " ".join(ITEMS[0][1].split()[3:20])
    rows = [(1, None), (2, ""), (3, "a SHORT, item here"), (4, prose(50, 9) + " " + part + "; " + prose(5, 1)), (5, part + " " + part), (6, ITEMS[5][1].upper().replace("É", "é")),
            (7, prose(300, 10)), (8, prose(8, 5)), (3, "a SHORT, item here"), (9, prose(30_000, 11) + ITEMS[0][1])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = find_contamination(clashing(spark, rows), bench, block_chars=block).collect()
    assert len(got) == len(rows)
    for r in got:
        n, hit, names = contaminated(dict(rows)[r.nct_id], ITEMS)
        assert (r.n_words, r.item_ids) == (n, names)
        assert {i for s in r.spans for i in range(s.start, s.stop)} == hit
    kept = {r.nct_id: r.criteria for r in remove_contamination(clashing(spark, rows), bench, block_chars=block).collect()}
    assert set(kept) == {1, 2, 3, 4, 7, 8, 9} and kept[3] == "a  here" and kept[1] is None and kept[7] == rows[6][1]
    assert contaminated(kept[9], ITEMS)[1] == set() and len(words(kept[9])) == 30_000
    whole = remove_contamination(clashing(spark, rows), bench, remove="documents")
    assert {r.nct_id for r in whole.collect()} == {1, 2, 7, 8} and whole.columns == clashing(spark, rows).columns


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = find_contamination(texts(spark, [(1, "a b")]), none).collect()
    assert [(r.n_words, r.spans, r.item_ids) for r in got] == [(2, [], [])]
    assert find_contamination(texts(spark, []), spark.createDataFrame(ITEMS, none.schema)).count() == 0
    digest = QUERIES["op4_decontaminate"](spark, SF).where("n_items = 0").first().items_sha256
    assert digest == hashlib.sha256(b"").hexdigest()


# -- SimHash ---------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance=4):
    """{key: least key within chains of fingerprints} by comparing all pairs."""
    keys, out = sorted(prints), {}
    for k in keys:
        if k in out:
            continue
        todo = [k]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = k
                todo += [y for y in keys if y not in out and (prints[x] ^ prints[y]).bit_count() <= distance]
    return out


def test_near_duplicates_equal_brute_force(spark):
    base = prose(400, 21)
    rows = [(1, None), (2, ""), (3, "  \t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, base), (8, base.upper().replace("É", "é")), (9, base + " end"),
            (10, base.replace(" a", " b", 1)), (7, base), (11, prose(400, 22)), (None, "x"), (12, prose(60_000, 3))]
    got = simhash.near_duplicates(clashing(spark, rows)).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    assert len(got) == len(rows) - 1
    assert {r.nct_id: r.fingerprint & (1 << 64) - 1 for r in got} == prints
    assert {r.nct_id: r.component for r in got} == classes(prints)
    assert simhash.near_duplicates(texts(spark, [])).count() == 0


def test_simhash_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    got = QUERIES["op5_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: format(f, "016x") for i, f in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == classes(prints)


@pytest.mark.parametrize("crowd", [4096, 3])
def test_every_link_is_found_around_a_dense_centre(spark, crowd):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)})
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "id long, fingerprint long")
    plan = simhash.allocate(*simhash.bit_moments(rows), 4)
    want = {(i, j) for i, x in enumerate(prints) for j, y in enumerate(prints) if i < j and (x ^ y).bit_count() <= 4}
    assert {(r.a, r.b) for r in simhash.group_links(rows, plan, 4, None, crowd=crowd).collect()} == want
    few = {(r.a, r.b) for r in simhash.leader_links(rows, plan, 4, None, leaders=2).collect()}
    assert few <= want and len(few) < len(want) / 4


def test_edited_texts_are_found_by_word_sets_and_others_left_alone(spark):
    rng, rows, edited = random.Random(8), [], {}
    for i in range(60):
        text = prose(300, 1000 + i).split()
        rows.append((10 * i, " ".join(text)))
        for j in range(1, 4):
            other = list(text)
            for at in rng.sample(range(300), 4):
                other[at] = "edit%d%d%d" % (i, j, at)
            rows.append((10 * i + j, " ".join(other)))
            edited[10 * i + j] = 10 * i
    got = {r.nct_id: r.component for r in simhash.near_duplicates(
        texts(spark, rows), shingle=1, distinct=True, tables=3, distance=5, similarity=0.8).collect()}
    assert all(got[i] // 10 == i // 10 for i in got)
    assert sum(got[i] == base for i, base in edited.items()) >= 0.97 * len(edited)
    kept = simhash.drop_near_duplicates(clashing(spark, [*rows, (None, "x"), (None, "x")]), shingle=1, distinct=True, tables=3, distance=5, similarity=0.8)
    assert sorted(r.nct_id for r in kept.collect() if r.nct_id is not None) == sorted(set(got.values())) and kept.count() == len(set(got.values())) + 2


def similar_classes(rows, similarity=0.8):
    """{key: least key within chains of texts of that 5-word Jaccard similarity} by comparing all pairs."""
    sets = {i: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    out = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((out[i], out[j]))
                out = {k: low if c == high else c for k, c in out.items()}
    return out


def test_texts_with_a_block_added_cut_or_moved_are_found(spark):
    rng, rows = random.Random(9), []
    for i in range(40):
        text, other = prose(300, 3000 + i).split(), prose(70, 4000 + i).split()
        at, rows_of = rng.randrange(240), [text]
        rows_of.append(text + other)  # similarity 0.81
        rows_of.append(text[:at] + text[at + 58:])  # 0.8 or a little less
        rows_of.append(text[:at] + other[:60] + text[at:])
        rows_of.append(text[120:] + text[:120])
        rows += [(10 * i + j, " ".join(t)) for j, t in enumerate(rows_of)]
    want = similar_classes(rows)
    n = sum(k != c for k, c in want.items())
    got = {r.nct_id: r.component for r in simhash.near_duplicates(texts(spark, rows), shingle=1, distinct=True, distance=5, similarity=0.8).collect()}
    assert n > 100 and got == want


def test_links_are_verified_by_shingle_sets_in_a_crowd_of_templates(spark):
    base, rows = prose(300, 51).split(), []
    for i in range(60):  # 0.7 to each other
        rows.append((i, " ".join(base + prose(64, 5000 + i).split())))
    rows += [(100 + i, rows[i][1] + " " + prose(1, 6000 + i)) for i in range(0, 60, 3)]
    want = similar_classes(rows)
    got = {r.nct_id: r.component for r in simhash.near_duplicates(texts(spark, rows), shingle=1, distinct=True, distance=5, similarity=0.8).collect()}
    assert got == want and len(set(want.values())) == 60


def test_few_pairs_of_a_crowd_below_the_similarity_are_verified(spark, monkeypatch):
    base, rows, rng = prose(400, 71).split(), [], random.Random(72)
    for i in range(80):  # pairs of similarity 0.67, of which a sketch of 256 bits rules out few
        words_ = list(base)
        for at in rng.sample(range(400), 8):
            words_[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words_)))
    rows += [(100 + i, t + " one more word") for i, t in rows[:5]]
    met, join = [], simhash.group_links

    def counted(rows, plan, *rest, **options):
        found = join(rows, plan, *rest, **options)
        met.extend([found.count()] if plan is None else [])
        return found

    monkeypatch.setattr(simhash, "group_links", counted)
    got = {r.nct_id: r.component for r in simhash.near_duplicates(texts(spark, rows), shingle=1, distinct=True, distance=5, similarity=0.8).collect()}
    assert got == {i: i - 100 if i >= 100 else i for i, _ in rows}
    assert len(met) == 1 and met[0] < 600  # of 3,570


def test_a_text_of_many_pairs_is_dealt_over_copies(spark):
    rows = [(0, prose(100, 52))] + [(i, prose(100, 52) + (" " + prose(30 if i % 2 else 5, 7000 + i))) for i in range(1, 30)]
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    got = simhash.similar_pairs(pairs, texts(spark, rows, "k long, t string"), 0.8, hub=4).collect()
    assert sorted((r.a, r.b) for r in got) == [(0, i) for i in range(2, 30, 2)]


def test_thresholds_keep_the_pigeonhole_and_get_more_selective():
    rng = np.random.default_rng(1)
    bits = np.hstack([np.where(rng.random((5000, 64)) < 0.5, 1, -1), np.ones((5000, 1))])
    sums = (bits.T @ bits).astype(np.int64)
    chosen = [simhash.allocate(n, sums * n // 5000) for n in (10**4, 10**6, 10**8)]
    for plan in chosen:
        assert sum(t + 1 for _, t in plan) == 5 and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)
    assert min(len(g) for g, _ in chosen[2]) > min(len(g) for g, _ in chosen[0])


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(5, 5), (7, 6), (6, 7), (200, 150)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 150: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    n, sc = 300, spark.sparkContext
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 50)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sc.setJobGroup("components", "a chain")
        got = {r.node: r.component for r in connected_components(links).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(n + 1), 0)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    assert sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 3000  # before 16,435


# -- passages --------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(2, 6))
def test_compact_windows_cover_every_long_run_by_its_least_value(values, span):
    v = np.array(values, np.uint64) << np.uint64(32)  # zeros separate texts
    found = compact_windows(v, span)
    for a in range(len(v)):
        for b in range(a + span - 1, len(v)):
            least = v[a:b + 1].min()
            if least and (v[a:b + 1] == least).sum() == 1:
                c = a + int(v[a:b + 1].argmin())
                tied = [x for x in found if v[x[1]] == least and x[0] <= a and b <= x[2]]
                assert tied or any(v[x[1]] == least and abs(x[1] - c) < span for x in found)


def test_repeated_passages_small_cases(spark):
    shared, close = prose(70, 31), prose(80, 32).split()
    changed = list(close)
    changed[40] = "changedword"
    rows = [(1, prose(100, 41) + " " + shared + ". " + prose(30, 42)), (2, prose(10, 43) + " " + shared.upper().replace("É", "é")), (3, prose(300, 44)), (4, None), (5, ""),
            (6, " ".join(close)), (7, prose(60, 45) + " " + " ".join(changed)), (8, " ".join(shared.split()[:40])), (9, shared), (9, shared),
            (None, shared), (10, "the " * 5000), (11, "the " * 300), (12, prose(20_000, 46) + " " + shared)]
    got = {r.nct_id: r for r in repeated_passages(clashing(spark, rows)).collect()}
    assert set(got) == {2, 7, 9, 11, 12}
    assert got[2].first_nct_id == 1 and [(s.start, s.stop) for s in got[2].spans] == [(10, 80)]
    assert got[7].first_nct_id == 6 and got[11].first_nct_id == 10 and [(s.start, s.stop) for s in got[12].spans] == [(20_000, 20_070)]
    left = {r.nct_id: r.criteria for r in remove_repeats(clashing(spark, rows)).collect()}
    assert set(left) == {1, 2, 3, 4, 5, 6, 7, 8, 10, 12, None} and left[1] == rows[0][1] and len(words(left[2])) == 10 and left[None] == shared
    assert repeated_passages(texts(spark, [])).count() == 0


def test_signatures_are_computed_and_shuffled_once(spark):
    shared = prose(60, 51)
    rows = [(n, prose(20, 50_000 + n) + " " + shared + " " + prose(20, 60_000 + n) + " " + shared) for n in (3, 1, 2)] + [(0, prose(90, 52))]
    for found, scans in ((exact_pairs, 2), (candidate_pairs, 1)):  # the texts, and for exact pairs their runs
        pairs = found(texts(spark, rows))
        assert pairs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == scans
        assert {(r.k, r.first_k) for r in pairs.collect()} == {(2, 1), (3, 1)}
    # a place is compared with the first one of the first text, which lies on the diagonals 0 and 80
    assert {r.diagonal for r in exact_pairs(texts(spark, rows)).collect()} == {0, 80}


@pytest.mark.parametrize("repeat", [50, 51, 120])
def test_an_exact_repeat_is_found_behind_texts_that_have_its_single_shingles(spark, repeat):
    rows, n = [], 0
    for case in range(12):
        shared = prose(repeat, 800 + case).split()
        for at in range(repeat - 4):  # each shingle stands alone in an earlier text
            rows.append((n := n + 1, prose(50, 10_000 + n) + " " + " ".join(shared[at:at + 5]) + " " + prose(50, 20_000 + n)))
        for _ in range(2):
            rows.append((100_000 + len(rows), prose(60, 30_000 + len(rows)) + " " + " ".join(shared) + " " + prose(60, 40_000 + len(rows))))
    late = sorted(i for i, _ in rows if i > 100_000)
    got = {r.nct_id: r for r in repeated_passages(texts(spark, rows)).collect()}
    assert set(got) == set(late[1::2])
    assert all(got[b].first_nct_id == a and [(s.start, s.stop) for s in got[b].spans] == [(60, 60 + repeat)] for a, b in zip(late[::2], late[1::2], strict=True))


def test_exact_repeats_of_50_words_are_found_on_the_given_table(spark):
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, late = {}, set()
    for i in sorted(docs):
        for j in range(len(docs[i]) - 49):
            if first.setdefault(tuple(docs[i][j:j + 50]), i) != i:
                late.add(i)
    got = QUERIES["op3_passages"](spark, SF).collect()
    assert late and late <= {r.doc_id for r in got} and all(r.first_doc_id < r.doc_id for r in got)
    for r in got:  # and whatever is named is similar: most 5-word runs of the span are in the other text
        other = {tuple(docs[r.first_doc_id][j:j + 5]) for j in range(len(docs[r.first_doc_id]) - 4)}
        for s in r.spans:
            grams = [tuple(docs[r.doc_id][j:j + 5]) for j in range(s.start, s.stop - 4)]
            assert s.stop - s.start >= 45 and sum(g in other for g in grams) >= 0.75 * len(grams)


def test_a_similar_passage_is_found_behind_texts_that_hold_parts_of_it(spark):
    rows, late, n = [], {}, 0
    rng = random.Random(77)
    for case in range(40):
        shared = prose(60, 3000 + case).split()
        for at in (0, 20, 40, 5, 25, 0, 30, 15, 40, 10, 20, 35):  # earlier texts with a third or half of the passage
            n += 1
            rows.append((n, prose(50, 70_000 + n) + " " + " ".join(shared[at:at + (20 if n % 2 else 30)]) + " " + prose(50, 80_000 + n)))
        changed = list(shared)
        place = rng.randrange(5, 55)
        changed[place:place + 1] = [["changedword"], [], [shared[place], "putin"]][case % 3]
        late[100_001 + 2 * case] = 100_000 + 2 * case
        for k, words_of in ((100_000 + 2 * case, shared), (100_001 + 2 * case, changed)):
            rows.append((k, prose(40, 90_000 + k) + " " + " ".join(words_of) + " " + prose(40, 95_000 + k)))
    got = {(r.nct_id, r.first_nct_id) for r in repeated_passages(texts(spark, rows)).collect()}
    assert got <= set(late.items()) and len(got) >= 39
