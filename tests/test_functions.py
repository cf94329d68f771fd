"""Golden cases, invariants and edge rows of the functions and operators."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import arrays, folds, predicates, text, tools
from sparkloom.operators import collate, joins, metrics, ordered, relational
from sparkloom.plans import language, models, templates


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).collect()[0].r


@pytest.mark.parametrize(
    "t, want",
    [("we had 120 and 30 so 150 in all", True), ("5 and 6 make 11", False), ("200 50% 100", True), ("120 31 4 150", False), ("120 30 4 9", True), ("", False), ("300 x y 0 z 300", True), ("1 " * 150 + "200 100 300", True)],
)
def test_arithmetic_text(spark, t, want):
    assert one(spark, t, "string", predicates.arithmetic_text) is want


def test_predicates_on_null(spark):
    for f in (predicates.arithmetic_text, predicates.date_text, predicates.other_script, predicates.tokens):
        assert one(spark, None, "string", f) in (None, False)


@pytest.mark.parametrize("t, want", [("a" * 150 + "b", "ab"), ("a" * 100, "a" * 100), ("\n" * 300, "\n" * 300)])
def test_collapse_runs(spark, t, want):
    assert one(spark, t, "string", text.collapse_runs) == want


def test_strip_accents(spark):
    import unicodedata

    for t in ("Éçà ñ Việt", "हिन्दी में", "한국 ガ é é", "شُكْرًا Ё 𝅗𝅥", "", "plain\n"):
        want = "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
        assert one(spark, t, "string", text.strip_accents) == want
    assert one(spark, None, "string", text.strip_accents) is None


def test_selected_forms(spark):
    for t, want in (("ＡＢ１ ﾊﾟ", "AB1 ハ" + chr(0x309A)), ("⑩Ⅳ❷", " 10  4  2 "), ("㈱㍻㊙", "(株)平成秘"), (chr(0xF979) + "é½", "凉é½"), ("", "")):
        assert one(spark, t, "string", text.nfkc_selected) == want


@pytest.mark.parametrize("e, want", [("18 + 12 * 3", 54), ("7/2", 3.5), ("-(2)*3", -6), ("__import__('os')", None), ("2**9", None), ("1/0", None), ("(" * 500, None), ("", None), ("True", None)])
def test_calculate(e, want):
    assert tools.calculate(e) == want


def test_calculator_calls(spark):
    rows = ["[ Calculator(18 + 12 * 3) ]", "no call", "[ Calculator(5) ]", "[ Calculator(1+", "[ Calculator(8 / 4)", None, "[ Calculator(7 / 2) ] and more", "[ Calculator(7 / 0) ]", "[ Calculator(-12.5%) ]", "[ Calculator(1 + 1) ] (2) ]"]
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(tools.calculator(F.col("v")).alias("r"))
    want = ["[ Calculator(18 + 12 * 3)  -> 54 ]", "no call", "[ Calculator(5) ]", "[ Calculator(1+", "[ Calculator(8 / 4) -> 2.0 ]", None, "[ Calculator(7 / 2)  -> 3.5 ] and more", *rows[7:]]
    assert [r.r for r in df.collect()] == want


@pytest.mark.parametrize("t", ["2024-07-08", "on 2024/07/08.", "08-07-2024", "8/7/24", "8 Jul 2024", "8July2024", "July 8 2024", "Jul 8, 2024", "3 days ago", "in 5  days", "TODAY", "at thanksgiving time", "१२-०७-२०२४"])
def test_date_texts(spark, t):
    assert one(spark, t, "string", predicates.date_text) is True


@pytest.mark.parametrize("t", ["Monday", "x2024-07-08", "2024-07-081", "8.7.2024", "8 jul 2024", "July 8th 2024", "days ago", "in five days", ""])
def test_no_date_texts(spark, t):
    assert one(spark, t, "string", predicates.date_text) is False


def test_other_script_letters(spark):
    for c in "àãèìòõùĩũÀÃÉÍÑÓÜÚßäñéĂĐƠƯعअ中":
        assert one(spark, f"a{c}b", "string", predicates.other_script) is (c != "Ñ"), c
    for c in "¿¡ếạÑçøåЖ日本語"[:-3] + "ひ":
        assert one(spark, f"a{c}b", "string", predicates.other_script) is False, c


@pytest.mark.parametrize(
    "call, want",
    [
        ("[ Calendar(1998-12-25,Christmas) ]", "1998-12-25 is Friday, Christmas Day of 1998. Christmas is 1998-12-25, Friday. 1998-12-25 is Christmas.  ]"),
        ("[ Calendar(2024-6-25) ]", "2024-6-25 is Tuesday ]"),
        ("[ Calendar(Today) ]", "Today is 2024-06-01, Saturday ]"),
        ("[ Calendar(labor day) ]", "labor day is 2024-09-02, Monday ]"),
        ("[ Calendar(2024-5-30, today) ]", "2024-5-30 is Thursday. today is 2024-06-01, Saturday. The days from 2024-5-30 until today is 2 days.  ]"),
        ("[ Calendar(memorial,2023-01-01) ]", "memorial is 2024-05-27, Monday. 2023-01-01 is Sunday, New Year's Day of 2023. The days from 2023-01-01 until memorial is 512 days.  ]"),
        ("[ Calendar(2001-09-09,soon) ]", "2001-09-09 is Sunday.  ]"),
        ("[ Calendar(soon) ]", None), ("[ Calendar(2024-13-41) ]", None), ("[ Calendar(a,b,c) ]", None), ("no call", None), ("", None),
    ],
)
def test_calendar(spark, call, want):
    got = one(spark, call, "string", lambda c: tools.calendar(c, F.to_date(F.lit("2024-06-01"))))
    assert got == (call if want is None else call.split("]")[0] + "-> " + want)


def test_holidays(spark):
    days = {r.name: str(r.day) for r in tools.holidays(spark, 2024, 2024).collect()}
    assert days["Thanksgiving"] == "2024-11-28" and days["Memorial Day"] == "2024-05-27" and len(days) == 11


def test_pad_golden(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4]), (1, [5, 6, 7]), (1, [8, 9]), (2, None), (2, [])], "b int, x array<int>")
    got = sorted(map(tuple, collate.padded(df, "b", {"x": 0}).collect()))
    assert got == [(1, [1, 2, 3, 4]), (1, [5, 6, 7, 0]), (1, [8, 9, 0, 0]), (2, []), (2, [])]


def test_longest_first_matches_the_walk(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(12), rnd.randrange(12), rnd.randrange(14)) for _ in range(300)]
    a, b = collate.longest_first(F.col("a"), F.col("b"), F.col("r"))
    for r in spark.createDataFrame(rows, "a int, b int, r int").select("a", "b", "r", a.alias("x"), b.alias("y")).collect():
        x, y = r.a, r.b
        for _ in range(r.r):
            x, y = (x - 1, y) if x > y else (x, y - 1)
        assert (r.x, r.y) == (max(x, 0), max(y, 0)) or r.r > r.a + r.b


def test_span_pairs_golden(spark):
    df = spark.createDataFrame([([1, 2, 10], [4, 12]), ([], [1]), ([5], [])], "s array<int>, e array<int>")
    got = [[(p.s, p.e) for p in r.p] for r in df.select(ordered.pairs_by_end(F.col("s"), F.col("e")).alias("p")).collect()]
    assert got == [[(2, 4), (10, 12)], [], []]


def test_fixed_samples_reassemble(spark):
    rnd = random.Random(2)
    docs = [(i, [rnd.randrange(99) for _ in range(rnd.randrange(1, 9))]) for i in range(40)]
    stream = [t for _, d in docs for t in d]
    got = {r.sample: r.tokens for r in ordered.fixed_samples(spark.createDataFrame(docs, "id int, t array<int>"), ["id"], "t", 7).collect()}
    assert got == {i: stream[i * 7 : i * 7 + 8] for i in range((len(stream) - 1) // 7)}


def test_pack_greedily(spark):
    assert one(spark, [3, 4, 9, 1, 1, 20, 2], "array<int>", lambda c: ordered.pack_greedily(c, 8)) == [0, 0, 1, 2, 2, 3, 4]
    assert one(spark, [], "array<int>", lambda c: ordered.pack_greedily(c, 8)) == []


def test_viterbi(spark):
    assert one(spark, [[0.0, 5.0, 1.0], [0.0, 5.0, 0.0], [3.0, 0.0, 0.0], [0.0, 9.0, 1.0]], "array<array<double>>", ordered.viterbi) == [2, 1, 1, 1]
    assert one(spark, [[0.0, 5.0, 1.0], [9.0, 5.0, 0.0], [0.0, 3.0, 1.0]], "array<array<double>>", ordered.viterbi) == [2, 0, 2]


def test_lcs(spark):
    df = spark.createDataFrame([(list("abcbdab"), list("bdcaba")), ([], ["a"]), (["a"], [])], "a array<string>, b array<string>")
    assert [r.n for r in df.select(metrics.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()] == [4, 0, 0]


def test_numbered_and_top_k(spark):
    rows = [(i % 3, i * 7 % 50) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, v int")
    n = relational.numbered(df, ["v"]).collect()
    assert sorted((r.v, r.idx) for r in n) == [(i, i) for i in range(50)]
    top = relational.top_k(df, ["k"], [F.desc("v")], 2).collect()
    want = {(k, v) for k in range(3) for v in sorted((v for kk, v in rows if kk == k), reverse=True)[:2]}
    assert {(r.k, r.v) for r in top} == want
    assert relational.numbered(df.limit(0), ["v"]).count() == 0


@pytest.mark.parametrize("parts", ["3", "64"])
def test_numbers_of_many_rows(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # more rows than the sample behind the ranges, in more partitions than one; the number is read apart from other columns
        df = spark.range(60_000, numPartitions=9).select(F.xxhash64("id").alias("k"), (F.col("id") % 5).alias("v"), F.md5(F.col("id").cast("string")).alias("wide"))
        rows = sorted((r.k, r.v) for r in df.collect())
        n = relational.numbered(df, ["k"], total="all")
        assert n.select("idx").distinct().count() == 60_000
        assert sorted((r.idx, r.k, r.all) for r in n.select("idx", "k", "all").collect()) == [(i, k, 60_000) for i, (k, _) in enumerate(rows)]
        got = {r.k: r.b for r in relational.running(df, ["k"], "v", "b").select("k", "b").collect()}
        total = 0
        for k, v in rows:
            assert got[k] == total
            total += v
        down = relational.numbered(df.select("k"), [F.desc("k")])
        assert [r.k for r in down.where("idx < 3").orderBy("idx").collect()] == [k for k, _ in rows[::-1][:3]]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ranks_and_budgets_of_skewed_keys(spark):
    rnd = random.Random(7)
    rows = [(i, "ab"[i % 9 == 0] if i % 13 else None, rnd.randrange(50), rnd.randrange(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, k string, v int, n int")
    got = {r.i: (r.up, r.down, r.at) for r in relational.numbered_within(relational.ranked(relational.ranked(df, "k", "v", "up"), "k", "v", "down", down=True), "k", ["i"], "at").collect()}
    by = {}
    for i, k, v, _ in rows:
        by.setdefault(k, []).append((i, v))
    want = {i: (1 + sum(x < v for _, x in r), 1 + sum(x > v for _, x in r), sum(j < i for j, _ in r)) for r in by.values() for i, v in r}
    assert got == want
    total, fits = {}, set()
    for i, k, _, n in rows:
        total[k] = total.get(k, 0) + n
        if total[k] <= 300:
            fits.add((i, total[k]))
    assert {(r.i, r.total) for r in joins.within_budget(df, "k", F.col("i"), "n", 300).collect()} == fits


def test_ranges_of_skewed_orders_are_even(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        # nearly all values lie in a thousandth of the range
        df = spark.range(40_000, numPartitions=5).select("id", F.when(F.col("id") % 1000 == 0, F.col("id") * 1000.0).otherwise(F.col("id") / 40_000).alias("v"))
        fixed, part, _ = relational._parts(df, ["v", "id"])
        sizes = [r["count"] for r in fixed.groupBy(part.alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 40_000 / 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_nearest_points_match_all_distances(spark):
    rnd = random.Random(12)
    rows = [(i, [rnd.random() for _ in range(3)]) for i in range(120)] + [(500, [0.5, 0.5, 0.5]), (501, [0.5, 0.5, 0.5])]
    points = spark.createDataFrame(rows, "i int, v array<double>")
    for block in (7, 10_000):
        got = {(r.q, r["rank"]): r.i for r in joins.nearest(points, "i", "v", F.col("i") % 20 == 0, 3, arrays.euclidean, block).collect()}
        want = {}
        for q, x in rows:
            if q % 20 == 0:
                near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in rows if i != q)
                want |= {(q, n + 1): i for n, (_, i) in enumerate(near[:3])}
        assert got == want


def test_pairs_of_hot_keys_in_blocks(spark):
    a = [(i % 7 if i % 3 else 0, i) for i in range(200)]
    b = [(i % 5, -i) for i in range(90)] + [(None, 1)]
    left, right = spark.createDataFrame(a, "k int, x int"), spark.createDataFrame(b, "k int, y int")
    for block in (4, 1000):
        got = sorted(map(tuple, joins.paired(left, right, "k", block).select("k", "x", "y").collect()))
        assert got == sorted((k, x, y) for k, x in a for j, y in b if j == k)


def test_fuzzy_pairs_match_all_pairs(spark):
    rnd = random.Random(3)
    a = sorted({"".join(rnd.choice("aéc中") for _ in range(rnd.randrange(0, 9))) for _ in range(60)})
    b = sorted({"".join(rnd.choice("aéc中") for _ in range(rnd.randrange(0, 9))) for _ in range(60)})

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = _next(row, i, c, y)
        return row[-1]

    def _next(row, i, c, y):
        new = [i]
        for j, d in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        return new

    got = {(r.x, r.y) for r in joins.fuzzy_pairs(spark.createDataFrame([(x,) for x in a], "x string"), spark.createDataFrame([(y,) for y in b], "y string"), "x", "y").collect()}
    assert got == {(x, y) for x in a for y in b if edits(x, y) <= 2}
    both = spark.createDataFrame([(x, y) for x in a[:20] for y in b[:20]], "x string, y string").select("x", "y", F.levenshtein("x", "y").alias("n"))
    assert all(r.n == edits(r.x, r.y) for r in both.collect())


def test_segments():
    cut = folds.segmenter({"中文", "中文字", "学校"})
    assert cut("中文字学abc12、校 é学校") == ["中文字", "学", "abc12", "校", "学校"] and cut("") == []


@pytest.fixture(scope="module")
def model(spark):
    texts = ["a b c", "a b d", "a b c", "b a", "c", "d a b c d", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    m = language.trained(df, predicates.tokens(F.col("t"))).cache()
    after = {}
    for r in m.collect():
        after.setdefault(r.prev, {})[r.next] = r.logp
    return m, after


def test_beams_match_all_continuations(spark, model):
    m, after = model

    def all_of(last, steps):
        if steps == 0:
            return [((), 0.0, False)]
        out = []
        for w, p in after.get(last, {"": 0.0}).items():
            out += [((), p, True)] if w == "" else [((w, *more), p + q, done) for more, q, done in all_of(w, steps - 1)]
        return out

    start = spark.createDataFrame([(i, w) for i, w in enumerate(("a", "b", "c", "none"))], "i int, w string")
    got = {}
    for r in language.decoded(start, "i", "w", m, 3, beams=50).collect():
        got.setdefault(r.i, []).append((tuple(r.words), round(r.score, 6)))
    for i, w in enumerate(("a", "b", "c", "none")):
        want = sorted(((words, round(s, 6)) for words, s, _ in all_of(w, 3)), key=lambda x: (-x[1], x[0]))
        assert sorted(got[i], key=lambda x: (-x[1], x[0])) == want
    best = {r.i: r.words for r in language.decoded(start, "i", "w", m, 1).collect()}
    for i, w in enumerate(("a", "b", "c")):
        top = min(after[w].items(), key=lambda x: (-x[1], x[0]))[0]
        assert best[i] == ([top] if top else [])
    assert best[3] == []


def test_groups_of_beams_match_a_plain_search(spark, model):
    m, after = model
    steps, beams, groups, diversity = 3, 2, 2, 0.7

    def search(word):
        lives = [[(0.0, (), word, False)] for _ in range(groups)]
        for _ in range(steps):
            taken = {}
            for g in range(groups):
                found = [(x, False) for x in lives[g] if x[3]]
                for score, words, last, done in lives[g]:
                    for w, p in ({} if done else after.get(last, {"": 0.0})).items():
                        found.append(((score + p - diversity * taken.get(w, 0), words if w == "" else (*words, w), w, w == ""), True))
                found.sort(key=lambda x: (-round(x[0][0], 9), x[0][1]))
                lives[g] = [x for x, _ in found[:beams]]
                for x, new in found[:beams]:
                    if new:
                        taken[x[2]] = taken.get(x[2], 0) + 1
        return lives

    start = spark.createDataFrame([(i, w) for i, w in enumerate("abcd")], "i int, w string")
    got = {}
    for r in language.decoded_in_groups(start, "i", "w", m, steps, beams, groups, diversity).orderBy("i", "group", "beam").collect():
        got.setdefault((r.i, r.group), []).append((round(r.score, 6), tuple(r.words)))
    for i, w in enumerate("abcd"):
        for g, live in enumerate(search(w)):
            assert got[i, g] == [(round(s, 6), words) for s, words, _, _ in live]


def test_draws_follow_the_probabilities(spark, model):
    import math

    m, after = model
    start = spark.range(4000).select(F.col("id").alias("i"), F.lit("b").alias("w"))
    got = [tuple(r.words) for r in language.decoded(start, "i", "w", m, 1, temperature=1.0).collect()]
    assert len(got) == 4000
    for w, p in after["b"].items():
        assert abs(got.count((w,) if w else ()) / 4000 - math.exp(p)) < 0.03


def test_scores_of_word_pairs(spark, model):
    import math

    m, after = model
    q = spark.createDataFrame([(1, "a zz"), (2, "")], "i int, t string")
    got = {r.i: r.score for r in language.scores(q, "i", predicates.tokens(F.col("t")), m).collect()}
    v = len({w for by in after.values() for w in by})
    n = {(r.prev, r.next): (r.n, r.total) for r in m.collect()}
    chance = lambda a, b: math.log((n.get((a, b), (0, 0))[0] + 1) / (next((t for (x, _), (_, t) in n.items() if x == a), 0) + v))
    assert abs(got[1] - sum(chance(a, b) for a, b in (("", "a"), ("a", "zz"), ("zz", ""))) / 3) < 1e-9 and abs(got[2] - chance("", "")) < 1e-9


def test_folds():
    assert folds.word_pieces("unaffable", {"un", "##aff", "##able"}) == ["un", "##aff", "##able"]
    assert folds.word_pieces("xyz", {"x"}) == ["[UNK]"] and folds.word_pieces("a" * 101, {"a", "##a"}) == ["[UNK]"]
    assert folds.longest_common_run("xABCy", "zabcz") == (4, 3) and folds.longest_common_run("", "a") == (0, 0)
    assert folds.Phrases(["ab", "abc", "cd"]).find("abcd") == [(0, 2), (2, 3)]
    assert folds.tag_over(list("OOO"), [(1, 2)], "X") == ["O", "B-X", "I-X"]
    assert folds.whole_word_marks(list("学校很a"), {"学校"}) == ["学", "##校", "很", "a"]
    assert folds.whole_word_mask(["a", "##b", "c", "d", "e", "f"], [0, 1, 2], 0.2) == [False, False, True, False, False, False]


@pytest.mark.parametrize("words, want", [(["a", "", "", "b", ""], ["a", " ", "b"]), (["", "", "", "", ""], [" ", " "]), (["a", "b"], ["a", "b"]), ([""], []), (["a\nb", "", "", "", "", "c\t"], ["a\nb", " ", " ", "c\t"]), (["", "a", "", "", ""], ["a", " "])])
def test_restored_delimiters(spark, words, want):
    assert one(spark, " ".join(words), "string", folds.restored_delimiters) == want


def test_chunks(spark):
    tags = ["B-A", "I-A", "I-B", "O", "I-A", "S-A", "I-A", "B-A", "E-A", "I-A"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)] + [(2, 0, "O"), (3, 0, "I-A")], "k int, i int, t string")
    got = sorted(map(tuple, metrics.chunks(df, ["k"], "i", "t").collect()))
    assert got == [(1, "A", 0, 1), (1, "A", 4, 4), (1, "A", 5, 5), (1, "A", 6, 6), (1, "A", 7, 8), (1, "A", 9, 9), (1, "B", 2, 2), (3, "A", 0, 0)]


def test_templates():
    assert templates.parse('a {"mask": true}b') == [{"hard": "a "}, {"mask": True}, {"hard": "b"}]
    with pytest.raises(ValueError):
        templates.parse("{open")
    with pytest.raises(ValueError):
        templates.render('{"what": 1}')


def test_failing_client_keeps_the_input(spark):
    class Down:
        def complete(self, texts):
            raise OSError("down")

    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.output for r in models.completed(df, "t", Down()).collect()] == ["a", None]
    assert [r.output for r in models.completed(df, "t", models.Echo()).collect()] == ["a", None]


def test_softmax_and_masks(spark):
    assert abs(sum(one(spark, [1.0, 2.0, 1000.0], "array<double>", arrays.softmax)) - 1) < 1e-9
    assert one(spark, [1, 2, 3], "array<int>", lambda c: collate.stride_windows(c, 2, 1)) == [[1, 2], [2, 3]]
    assert one(spark, [1], "array<int>", lambda c: collate.stride_windows(c, 2, 1)) == [[1]]
