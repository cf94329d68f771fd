import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import encoding, glyphs, leakage, lookalike, mixing, neardup, packing, quality, shared
from sparkloom.llm.words import shingles, words

DOCS = "doc_id bigint, text string, lang string, source string, site string"
PROSE = "The river rose by night and the people of the town went up to the hall with lamps and bread for the men who kept the bridge."


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, tiny, repeated, very long texts, null ids' neighbours and extra columns."""
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "A "), (4, "tiny", "b"), (5, PROSE, "a"), (5, PROSE, "a"), (6, PROSE, "b"), (7, "wörd " * 60_000, "a"), (8, "x" * 300_000, None)]
    return docs(spark, rows).withColumn("container_id", F.lit("clash")).withColumn("n_words", F.lit(0)).withColumn("cell", F.lit(1))


# --- one form ---


def test_rules_have_no_conflicts():
    assert glyphs.transducer().conflicts() == []


@pytest.mark.parametrize(
    "a, b",
    [("ＡＢｃ１", "ABc1"), ("é", "é"), ("a b", "a b"), ("so​ft­", "soft"), ("Аpple", "Apple"), ("ﬁlm", "film"), ("ё", "ë"), ("ợ", "ợ"), ("ｶﾞ", "ガ"), ("Νο", "No"), ("إ", "إ")],
)
def test_looks_alike(a, b):
    apply = glyphs.transducer().apply
    assert apply(a) == apply(b) and apply(apply(a)) == apply(a)


@pytest.mark.parametrize("a, b", [("a", "A"), ("é", "e"), ("1", "2"), ("a.", "a,"), ("a\tb", "a b"), ("👩‍👧", "👩👧")])
def test_differences_that_show_stay(a, b):
    apply = glyphs.transducer().apply
    assert apply(a) != apply(b)


def test_random_texts_keep_their_form():
    rnd, apply = random.Random(3), glyphs.transducer().apply
    for _ in range(400):
        s = "".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x300, 0x600), rnd.randrange(0x1E00, 0x2100), rnd.randrange(0xFF00, 0xFFF0), 0x1F469, 0x200D])) for _ in range(12))
        assert apply(apply(s)) == apply(s), s


def test_look_alike_pairs(spark, odd):
    other = PROSE.replace("o", "о").replace(" by", " by")
    got = lookalike.look_alike_pairs(docs(spark, [(9, other, None), (10, PROSE, None), (11, PROSE.upper(), None), (12, other, None)]))
    assert pairs(got) == [(9, 10), (10, 12)]
    assert pairs(lookalike.look_alike_pairs(odd)) == []
    assert pairs(lookalike.look_alike_pairs(odd.limit(0))) == []
    assert [r.one_form for r in lookalike.normalized(docs(spark, [(1, None, None), (2, "", None)])).orderBy("doc_id").collect()] == [None, ""]


# --- near duplicates ---


def brute(rows, threshold=0.55):
    sets = {i: set(zip(w, w[1:], w[2:])) for i, t in rows if len(w := words(t)) >= 12}
    ids = sorted(sets)
    return [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]


def edited(rnd, ws, edits):
    ws = list(ws)
    for _ in range(edits):
        ws[rnd.randrange(len(ws))] = f"new{rnd.randrange(10**6)}"
    return ws


def test_duplicates_match_brute_force(spark):
    rnd, rows = random.Random(5), []
    for base in range(60):
        ws = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 14, 20, 60, 300]))]
        rows.append((base * 10, " ".join(ws)))
        rows.append((base * 10 + 1, " ".join(edited(rnd, ws, max(1, len(ws) // 40)))))
        rows.append((base * 10 + 2, " ".join(edited(rnd, ws, len(ws) // 2))))
        rows.append((base * 10 + 3, "\n".join(ws).upper()))
    found = neardup.duplicate_pairs(docs(spark, [(i, t, None) for i, t in rows]))
    assert pairs(found) == brute(rows)


@pytest.mark.parametrize(("inner", "outer"), [(31, 56), (63, 105)])
def test_texts_inside_longer_versions_are_all_found(spark, inner, outer):
    rnd, rows = random.Random(inner), []
    for base in range(200):
        ws = [f"w{rnd.randrange(10**6)}" for _ in range(outer + 2)]
        rows += [(base * 2, " ".join(ws[: inner + 2]), None), (base * 2 + 1, " ".join(ws), None)]
    assert pairs(neardup.duplicate_pairs(docs(spark, rows))) == [(base * 2, base * 2 + 1) for base in range(200)]


def test_duplicate_groups(spark, odd):
    rnd = random.Random(1)
    ws = [f"w{i}" for i in range(80)]
    chain = [ws]
    for _ in range(5):
        chain.append(edited(rnd, chain[-1], 4))
    rows = [(i + 20, " ".join(w), None) for i, w in enumerate(chain)] + [(50, " ".join(ws), None), (60, PROSE, None)]
    got = {r.doc_id: (r.group_id, r.links) for r in neardup.duplicate_groups(docs(spark, rows)).collect()}
    assert {g for g, _ in got.values()} == {20} and set(got) == {*range(20, 26), 50}
    assert pairs(neardup.duplicate_pairs(odd)) == [(5, 6)]
    assert pairs(neardup.duplicate_pairs(odd.limit(0))) == []


def test_rtree_finds_what_the_bound_allows():
    rng = np.random.default_rng(0)
    pts = rng.poisson(1.5, (700, neardup.DIMS)).astype(np.uint8)
    pts[350:] = np.maximum(pts[:350], 1) - 1 + (rng.random((350, neardup.DIMS)) < 0.9)
    n = pts.sum(1, dtype=np.int64)
    tree = neardup.RTree(pts, n)
    for q in range(0, 700, 23):
        ok = neardup.overlap_bound(pts, pts[q], n, n[q]) >= neardup.needed(n, n[q], 0.55)
        ok &= n >= 0.55 * n[q]
        got = set(tree.search(pts[q], int(n[q]), 0.55).tolist())
        assert set(np.flatnonzero(ok).tolist()) <= got


def test_token_counts_take_every_document(spark):
    """More documents than a sample would hold: one token in all of them, another in two, the rest in one."""
    n = 60_000
    mine = [F.concat(F.lit(f"w{i}x"), "id") for i in range(8)]
    two = F.when(F.col("id") < 2, "in just two").otherwise("")
    rows = spark.range(n).select(F.concat_ws(" ", F.lit("one for all"), *mine, two, F.lit("end")).alias("text"))
    heat = neardup.token_heat(rows, 1 << 26)
    bits = len(heat).bit_length() - 1
    at = [int(neardup.mix(shingles([t.encode().split()])[0])[0]) >> (64 - bits) for t in ("one for all", "in just two")]
    assert heat[at[0]] == int(8 * np.log2(1 + n)) and heat[at[1]] >= int(8 * np.log2(3))
    counted = np.round(2 ** (heat / 8) - 1)
    # each document has ten tokens or more of its own besides the common one
    assert counted[counted < 50].sum() >= 0.9 * 9 * n


def test_tokens_of_one_document_make_no_postings():
    tokens, offsets = shingles([[b"%d" % i for i in range(40)]])
    for count, some in ((1, False), (2, True)):
        heat = np.full(1 << 16, int(8 * np.log2(1 + count)), np.uint8)
        assert bool(len(neardup.prefix_keys(tokens, offsets, heat, 0.55)[0])) == some


def test_pairs_of_copies_are_not_shuffled_to_be_distinct(spark):
    found = neardup.duplicate_pairs(docs(spark, [(i, PROSE, None) for i in range(6)]))
    assert "Aggregate [doc_id_a" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert pairs(found) == [(a, b) for a in range(6) for b in range(a + 1, 6)]


def test_large_cells_are_set_aside():
    cell = np.array([7] * 5 + [9] * 2, np.uint32)
    a, b, c, m = neardup._leaf_pairs(cell, np.array([5, 1, 2, 3, 4, 8, 9], np.uint64), largest=3)
    assert (a.tolist(), b.tolist()) == ([8], [9]) and m.tolist() == [1, 2, 3, 4, 5]


def versions(rnd, n, length=60):
    """Texts of one family: most are within the threshold of each other, some aren't, in three sizes."""
    base = [f"w{i}" for i in range(length)]
    return [(i, " ".join(edited(rnd, base[: length - i % 3 * (length // 4)], i % 9)), None) for i in range(n)]


@pytest.mark.parametrize("limits", [{"cell": 2, "block": 5}, {"cell": 2, "block": 1000}, {"hot": 4, "block": 7}, {"cell": 300}])
def test_cells_in_blocks_of_trees_lose_nothing(spark, limits):
    rows = versions(random.Random(4), 90)
    assert pairs(neardup.duplicate_pairs(docs(spark, rows), **limits)) == brute([(i, t) for i, t, _ in rows])


def test_one_id_with_two_texts(spark):
    rows = versions(random.Random(6), 6)
    rows += [(1, rows[0][1], None), (7, rows[3][1], None)]
    got = pairs(neardup.duplicate_pairs(docs(spark, rows)))
    assert len(got) == len(set(got)) and (3, 7) in got and {(a, b) for a, b in brute([(i, t) for i, t, _ in rows[:6]])} <= set(got)


def test_pairs_of_groups_in_blocks(spark):
    members = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 1), (3, 13)) for i in range(k * 100, k * 100 + n)], "g int, m int")
    by = {k: range(k * 100, k * 100 + n) for k, n in ((1, 40), (2, 1), (3, 13))}
    links = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    for block in (5, 100):
        assert pairs(shared.within(members, "g", "m", block)) == sorted((x, y) for g in by.values() for x in g for y in g if x < y)
        assert pairs(shared.across(links, members, "g", "m", block)) == sorted((x, y) for a, b in ((1, 2), (1, 3)) for x in by[a] for y in by[b])


# --- quality ---


def test_quality_on_odd_rows(spark, odd):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(100, 220):
        listing = i % 4 == 0
        lines = ["- " + rnd.choice(["cedar box", "iron nail", "green lamp", "old rope"]) + f" {rnd.randrange(9)}" for _ in range(12)] if listing else [PROSE, "He said that it was late, and they went home. It was the end of the day for all of us.", PROSE.lower()]
        rows.append((i, "\n".join(lines), None))
        labels.append((i, "list" if listing else "prose", "r", None))
    labels += [(100, None, "r", None), (100, "list", "s", None), (999, "junk", "s", None), (None, "junk", "s", None)]
    labels = spark.createDataFrame(labels, "doc_id bigint, kind string, rater string, labelled_at timestamp")
    common = spark.createDataFrame([("en", w, k) for k, w in enumerate("the by and of to up with for who that it was they all us he".split())] + [(None, "x", 1), ("en", None, 1)], "lang string, word string, freq_rank int")
    all_docs = docs(spark, rows).unionByName(odd.select(docs(spark, []).columns))
    got = {r.doc_id: r for r in quality.text_quality(all_docs.withColumn("kind", F.lit("clash")), labels, common).collect()}
    assert all(got[i].kind == ("list" if i % 4 == 0 else "prose") for i in range(100, 220))
    assert got[1].kind is None and got[2].n_words == 0 and got[3].outlying_share is None and got[7].n_words == 60_000
    r = got[101]
    assert r.n_words == len(words(rows[1][1])) and r.lang == "en" and abs(sum(r.contributions.values()) - r.distance) < 1e-6
    assert {r.doc_id for r in quality.not_prose(all_docs, labels, common).collect()} >= {i for i in range(100, 220) if i % 4 == 0}
    assert quality.text_quality(all_docs, labels, common).count() == all_docs.count()
    unrated = {r.doc_id: r for r in quality.text_quality(all_docs, labels.limit(0), common).collect()}
    assert unrated[101].n_words == r.n_words and unrated[101].kind is None and unrated[101].outlying_share is None
    assert quality.not_prose(all_docs, labels.limit(0), common.limit(0)).count() == 0
    assert quality.text_quality(all_docs.limit(0), labels, common).count() == 0


# --- packing ---

LIMITS = [("a", 100), ("b", 7), ("c", None), (None, 5), ("a", 120)]


def packed(spark, rows, **kw):
    records = spark.createDataFrame(rows, "record_id bigint, tool string, input_ids array<int>, capacity int, share int")
    return packing.pack(records, spark.createDataFrame(LIMITS, "tool string, max_length int"), **kw)


@pytest.mark.parametrize("fill", [True, False])
def test_packing_invariants(spark, fill):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("ab"), [1] * rnd.choice([0, 1, 5, 30, 51, 100, 101, 350]), 0, 0) for i in range(400)]
    rows += rows[:30] + [(500, None, [1], 0, 0), (501, "c", [1], 0, 0), (502, "zz", [1, 2], 0, 0), (503, "a", None, 0, 0), (None, "a", [1], 0, 0), (504, "a", [1] * 20_000, 0, 0)]
    got = packed(spark, rows, fill=fill, share=100).toPandas()
    assert set(got.record_id) == {r[0] for r in rows if r[0] is not None}
    inside = got[got.container_id.notna()]
    size = {r[0]: len(r[2] or []) for r in rows}
    assert inside.groupby("record_id").n_tokens.sum().to_dict() == {k: n for k, n in size.items() if n and k not in (None, 500, 501, 502)}
    assert ((inside.pieces > 1) == (inside.record_id.map(size) > inside.capacity)).all()
    for _, box in inside.sort_values("start").groupby("container_id"):
        ends = (box.start + box.n_tokens).tolist()
        assert box.tool.nunique() == 1 and all(e <= s for e, s in zip(ends, box.start.tolist()[1:], strict=False)) and ends[-1] <= box.capacity.iloc[0]


def test_harmonic_classes_hold_a_fixed_count():
    box, _, used = packing.harmonic(np.array([60, 51, 40, 34, 49, 30, 26, 33]), 100, fill=False)
    assert np.bincount(box).tolist() == [1, 1, 2, 1, 3] and used == 5
    # 49 fills the room beside 51, 40 that beside 60; of class 3 the last opens a container
    box, start, used = packing.harmonic(np.array([60, 51, 40, 34, 49, 30, 26, 33]), 100)
    assert used == 4 and box[0] == box[2] and box[1] == box[4] and box[3] == box[5] == box[7] and start[2] == 60
    assert packing.harmonic(np.array([60, 40, 50, 50, 25, 75]), 100)[2] == 3
    assert packing.harmonic(np.array([], np.int64), 100)[2] == 0


def test_filling_leaves_little_unused():
    rng = np.random.default_rng(1)
    n = np.minimum(rng.geometric(0.02, 5000), 256)
    for fill, most in ((True, 0.01), (False, 0.4)):
        used = packing.harmonic(n, 256, fill)[2]
        assert 1 - n.sum() / (used * 256) < most


def test_packing_nothing(spark):
    assert packed(spark, []).count() == 0


# --- mixing ---


def test_mix(spark, odd):
    rnd = random.Random(9)
    rows = [(i, f"text {i} " + "x" * rnd.randrange(50), "Big " if i % 3 else " big") for i in range(600)] + [(1000 + i, f"small {i} abcdefghij", "small") for i in range(20)] + [(2000 + i, "the same text in many copies", "few") for i in range(9)] + [(3000, "other", "none"), (3001, None, "big"), (3002, "null source", None)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("few", 0.1, 2), ("absent", 0.5, 2), (None, 1.0, 1), ("zero", 0.0, 1)], "source string, weight double, max_repeats int")
    uses, report = mixing.mix(docs(spark, rows).withColumn("weight", F.lit("clash")), targets)
    u, r = uses.toPandas(), {x.source: x for x in report.collect()}
    size = {i: len(t) for i, t, _ in rows if t}
    assert (u.n_chars == u.doc_id.map(size)).all()
    assert u.groupby("doc_id").size().max() <= 3 and len(u[u.source == "few"]) <= 2 and len(u.drop_duplicates(["doc_id", "use_no"])) == len(u)
    u = u.sort_values("start")
    assert u.start.tolist() == [0, *np.cumsum(u.n_chars).tolist()[:-1]] and u.finish.is_monotonic_increasing
    budget = sum(n for i, n in size.items() if i < 3000)
    assert set(r) == {"big", "small", "few", "absent"} and not r["absent"].reachable and r["absent"].used_chars == 0
    assert abs(sum(x.target_chars for x in r.values()) - budget) < 1e-6 and r["small"].reachable == (3 * r["small"].available_chars >= r["small"].target_chars)
    assert mixing.mix(odd, targets)[0].count() >= 0 and mixing.mix(odd.limit(0), targets)[0].count() == 0
    assert mixing.mixed_texts(uses, docs(spark, rows)).count() == len(u)


def test_mix_hits_reachable_shares(spark):
    rows = [(i, "y" * (20 + i % 17), "ab"[i % 2]) for i in range(4000)]
    targets = spark.createDataFrame([("a", 3.0, 4), ("b", 1.0, 1)], "source string, weight double, max_repeats int")
    _, report = mixing.mix(docs(spark, [(i, t + str(i), s) for i, t, s in rows]), targets)
    assert all(abs(r.actual_share - r.target_share) < 0.002 for r in report.collect())


@pytest.mark.parametrize("weights", [(1000.0, 1.0, 5.0), (1.0, 1.0, 1.0), (0.1, 900.0, 3.0)])
def test_mix_matches_all_uses_sorted(spark, weights):
    rnd = random.Random(11)
    rows = [(i, "z" * rnd.randrange(1, 60) + str(i), "abc"[min(2, i % 5)]) for i in range(300)]
    caps = (2, 40, 1)
    targets = spark.createDataFrame([(s, w, c) for s, w, c in zip("abc", weights, caps, strict=True)], "source string, weight double, max_repeats int")
    uses, report = mixing.mix(docs(spark, rows), targets, seed=7)
    mark = {r.doc_id: r.m for r in docs(spark, rows).select("doc_id", F.xxhash64(F.lit(7), "source", "doc_id").alias("m")).collect()}
    queue, budget = [], sum(len(t) for _, t, _ in rows)
    for s, w, c in zip("abc", weights, caps, strict=True):
        served = 0
        for use in range(1, c + 1):
            for i, t, own in sorted(rows, key=lambda r: (mark[r[0]], r[0])):
                if own == s:
                    served += len(t)
                    queue.append((served / w, s, i, use, len(t)))
    want, start = [], 0
    for finish, s, i, use, n in sorted(queue):
        if start < budget:
            want.append((i, s, use, n, finish, start))
        start += n
    assert sorted(map(tuple, uses.collect())) == sorted(want)
    by = {r.source: r for r in report.collect()}
    for s, w, c in zip("abc", weights, caps, strict=True):
        have = sum(len(t) for _, t, own in rows if own == s)
        assert by[s].reachable == (c * have >= w / sum(weights) * budget) and by[s].ran_out == (not by[s].reachable)


def test_virtual_time_and_rounds():
    assert mixing.last_finish([(1, 10), (3, 6)], 8) == 2 and mixing.last_finish([(1, 10), (3, 6)], 100) == 10 and mixing.last_finish([], 5) == 0
    assert mixing._rounds([(1, 10.0), (4, 5.0)], 15) == 1 and mixing._rounds([(1, 10.0), (4, 5.0)], 16) == 2 and mixing._rounds([(1, 10.0), (4, 5.0)], 99) == 4


# --- encoding ---


def test_ids_round_trip_and_match_the_public_library(spark, odd):
    tiktoken = pytest.importorskip("tiktoken")
    with open(encoding.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd, own = random.Random(8), encoding.encoder()
    texts = [PROSE, "<|endoftext|>", "  a\n\n b\t", "日本語テキスト", "नमस्ते दुनिया", "\U0001f469‍\U0001f467", *("".join(rnd.choice("ab é中#=-\n1") for _ in range(rnd.choice([3, 40, 700]))) for _ in range(200))]
    for t in texts:
        assert own.encode(t) == public.encode_ordinary(t)
        assert own.merged(t.encode()[:90] or b"a") == own.merged_long(t.encode()[:90] or b"a")
    got = [(r.doc_id, r.ids) for r in encoding.encode_corpus(odd).collect()]
    assert len(got) == 9 and all(ids == [] for i, ids in got if i in (1, 2))
    assert all(public.decode(ids) == t for (i, ids), t in ((g, t) for g in got for i, t in [(r.doc_id, r.text or "") for r in odd.collect()] if i == g[0]))
    assert encoding.encode_corpus(odd.limit(0)).count() == 0


# --- leakage ---

ITEMS = "item_id bigint, bench string, lang string, question string, numbers string, obj_label string, answers array<string>, context string"


def test_leaks(spark, odd):
    question = "which painter of the northern coast gave number1 lamps and number10 boats to the [MASK] of the old harbour town"
    items = spark.createDataFrame(
        [(1, "b", "en", question, " ".join(f"{i}7" for i in range(11)), "keeper", None, None), (2, "b", "zh", "在柯明城大火之前原和柯原悄悄交给那件地图", None, None, None, "a short context"), (3, "b", "en", None, None, None, None, None), (4, "b", "en", "too short to leak", None, None, None, None)], ITEMS
    )
    filled = "which painter of the northern coast gave 17 lamps and 107 boats to the keeper of the old harbour town"
    ws = filled.split()
    pad = " ".join(f"pad{i}" for i in range(12))
    rows = [(1, f"{pad} {' '.join(ws[3:11])}", None), (2, f"{pad} {' '.join(ws[3:10])} nothing", None), (3, filled.upper() + " " + pad, None), (4, pad + "在柯明城大火，之前原和柯原悄", None), (5, pad + "在柯明城大火之前原和柯", None), (6, " ".join(ws[:8]), None), (7, None, None)]
    found = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in leakage.leaked(docs(spark, rows), items).collect()}
    assert found == {(1, 1): (12, 8), (3, 1): (0, 20), (4, 2): (12, 13)}
    assert pairs(leakage.leaking_items(docs(spark, rows + rows), items)) == [(1, 1), (3, 1), (4, 2)]
    assert {r.doc_id for r in leakage.clean(docs(spark, rows), items).collect()} == {2, 5, 6, 7}
    one = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in leakage.leaked(docs(spark, rows), items, block_bytes=1).collect()}
    assert one == found
    assert leakage.leaked(odd, items).count() == 0 and leakage.leaked(odd, items.limit(0)).count() == 0


def test_clean_without_ids(spark):
    passage = "which painter of the northern coast gave lamps and boats to the keeper of the old harbour town"
    items = spark.createDataFrame([(1, "b", "en", passage, None, None, None, None)], ITEMS)
    rows = [(None, PROSE, "a"), (None, f"{PROSE} {passage}", "a"), (None, None, "a"), (1, f"{passage} {PROSE}", "a"), (2, PROSE, "a")]
    got = leakage.clean(docs(spark, rows), items)
    assert got.columns[0] == "doc_id" and sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == [(0, ""), (0, PROSE), (2, PROSE)]


@pytest.mark.parametrize("at_once", [1, 5, 1 << 20])
def test_suffix_arrays_match_brute_force(at_once):
    rnd = random.Random(6)
    vocabulary = [f"v{i}" for i in range(12)]
    passages = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 30)))) for i in range(20)]
    test = leakage.TestTexts(passages)
    text = [rnd.choice([*vocabulary, *passages[rnd.randrange(20)][1].split(), "none"]) for _ in range(3000)]
    for _ in range(40):
        p = passages[rnd.randrange(20)][1].split()
        at = rnd.randrange(len(text))
        text[at:at] = p[rnd.randrange(3) :]
    corpus = np.array([test.number.get(w.encode(), 0) for w in text])
    some = list(leakage.leaks(corpus, test, at_once))
    assert max(len(c) for c, *_ in some) <= max(at_once, 2 * at_once - 1)
    got = [(int(a), int(b), int(k)) for one in some for a, b, k in zip(*one, strict=True)]
    assert len(got) == len(set(got))
    got = set(got)
    want = set()
    for b in range(len(test.ids)):
        for a in range(len(corpus)):
            k = 0
            while a + k < len(corpus) and b + k < len(test.ids) and corpus[a + k] == test.ids[b + k] > 0:
                k += 1
            if k >= 8 and not (a and b and corpus[a - 1] == test.ids[b - 1] > 0):
                want.add((a, b, k))
    assert got == want and want


def test_words_and_shingles():
    assert words("Don't ＳＴＯＰ 中文 x_1") == [b"don", b"t", b"stop", "中".encode(), "文".encode(), b"x", b"1"]
    assert words(None) == words("…") == []
    tokens, at = shingles([[b"a", b"b", b"c", b"a", b"b", b"c"], [], [b"a", b"b"], [b"a", b"b", b"c"]])
    assert np.diff(at).tolist() == [3, 0, 0, 1] and tokens[-1] in tokens[:3]


def test_contributions_add_up_to_the_distance_that_decides():
    rnd = random.Random(8)
    texts = ["\n".join(rnd.choice([PROSE, "- a 1", "x | y | 3", "Yes, it was.", ""]) for _ in range(rnd.randrange(7))) for _ in range(200)] + [None, "", " \n "]
    common = quality.Common([("en", w) for w in "the of and by to for who it was".split()])
    lines = quality.Lines(texts, common)
    prose = np.array([PROSE in (t or "") for t in texts])
    x = lines.stats()
    mean, cov = quality.trimmed(x[prose[lines.doc]])
    model = quality.Model({"prose": {-1: (mean.tolist(), np.linalg.inv(cov).tolist())}, "threshold": 0.0, "other": {}})
    _, d, parts = model.score(lines)
    assert np.allclose(parts.sum(1), d)
    at = quality.median_lines(lines, d)
    assert (at >= 0).tolist() == [bool(t and t.strip()) for t in texts] and all(lines.doc[i] == doc for doc, i in enumerate(at) if i >= 0)
    for t in np.quantile(d, [0.1, 0.4, 0.5, 0.7, 0.95]):
        assert ((quality._share(lines, d > t) > 0.5) == (np.where(at >= 0, d[at], 0) > t)).all()


def test_sample_is_bounded(spark):
    rows = [(i, f"{i} " * 50, None) for i in range(40)]
    labels = spark.createDataFrame([(i, "prose") for i in range(40)], "doc_id bigint, kind string")
    assert quality.rated_sample(docs(spark, rows), labels, 10).count() == 10
    small = quality.rated_sample(docs(spark, rows), labels, 30, 1000).collect()
    assert 0 < len(small) < 30 and sum(len(r.text) for r in small) <= 1000 and all(r.text == rows[r.doc_id][1] for r in small)


def test_quality_held_out():
    """Fitted on half of the rated documents, judged on the other half; about one label in thirty is wrong."""
    duckdb = pytest.importorskip("duckdb")
    sf = os.environ.get("HELD_OUT_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect()
    common = quality.Common(con.sql(f"SELECT DISTINCT lang, word FROM '{sf}/common_words.parquet' WHERE lang IS NOT NULL AND word IS NOT NULL ORDER BY ALL").fetchall())
    rated = con.sql(f"SELECT doc_id, text, min(kind) FROM '{sf}/doc_labels.parquet' JOIN '{sf}/documents.parquet' USING (doc_id) WHERE kind IS NOT NULL AND text IS NOT NULL GROUP BY doc_id, text HAVING count(DISTINCT kind) = 1 ORDER BY md5(doc_id::VARCHAR)").fetchall()
    rated = [r for r in rated if len(words(r[1])) >= 12]
    half = len(rated) // 2
    train, test = rated[:half], rated[half:]
    facts = quality.fit([t for _, t, _ in train], np.array([k == "prose" for *_, k in train]), [k for *_, k in train], common)
    model, lines = quality.Model(facts), quality.Lines([t for _, t, _ in test], common)
    bad = quality._share(lines, model.score(lines)[1] > model.threshold) > 0.5
    truth = np.array([k != "prose" for *_, k in test])
    hit = int((bad & truth).sum())
    f1 = 2 * hit / (bad.sum() + truth.sum())
    print(f"held out: {len(test)} documents, precision {hit / bad.sum():.3f}, recall {hit / truth.sum():.3f}, F1 {f1:.3f}")
    assert f1 > 0.85
