from pyspark.sql import functions as F

from threadloom.functions import expr as E
from threadloom.operators import authors, report, similarity

TOKENS = "author string, id long, token_count_approx double"


def test_budget_keeps_a_prefix_without_skipping_ahead(spark):
    rows = [("a", i, float(t)) for i, t in enumerate([400, 500, 200, 50])] + [*(("b", 9 + i, 2000.0 if i == 0 else 1.0) for i in range(40)), ("c", 3, None), ("c", 4, 10.0)]
    for slices in (1, 32):
        got = authors.budget_prefix(spark.createDataFrame(rows, TOKENS), 1000, ["id"], slices=slices)
        assert sorted((r.author, r.id) for r in got.collect()) == [("a", 0), ("a", 1), ("c", 4)]


def test_author_filters(spark):
    names = spark.createDataFrame([(n,) for n in ("[deleted]", "AutoModerator", "RoBoTx", "ann", None)], "a string")
    assert [r.a for r in names.where(E.is_person(F.col("a"))).collect()] == ["ann"]
    assert {r.a for r in names.where(E.is_person_by_case(F.col("a"))).collect()} == {"ann", "RoBoTx"}
    names = spark.createDataFrame([(n,) for n in ("xBot", "xbot", "botx", "[deleted]", "", None)], "a string")
    assert [r.a for r in names.where(E.is_target(F.col("a"))).collect()] == ["botx"]


def test_histogram_closes_last_bin_and_widens_one_value(spark):
    got = authors.histogram(spark.createDataFrame([(v,) for v in (1, 1, 2, 4)], "v long"), "v", 3)
    assert {r.bin: r.freq for r in got.collect()} == {0: 2, 1: 1, 2: 1}
    one = authors.histogram(spark.createDataFrame([(5,), (5,)], "v long"), "v", 4).collect()
    assert [(r.bin, r.freq, r.share) for r in one] == [(2, 2, 1.0)]


def test_top_members_mark_more(spark):
    rows = [(f"u{i:02}", 1) for i in range(11)] + [("top", 9)]
    got = {r.bin: r.members for r in authors.top_members(spark.createDataFrame(rows, "author string, count long"), 2).collect()}
    assert got == {0: ", ".join(f"u{i:02}" for i in range(10)) + ", ...", 1: "top"}


def test_texts_in_order_skip_nulls(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, None), ("b", 1, None)], "author string, at long, t string")
    got = {r.author: r.formatted_comment for r in authors.texts(rows, F.col("t"), ["at"]).collect()}
    assert got == {"a": "x\ny", "b": ""}


def test_seeded_sample_does_not_depend_on_partitions(spark):
    rows = spark.range(200)
    pick = lambda df: {r.id for r in authors.seeded_sample(df, ["id"], 10, 3).collect()}
    assert pick(rows.repartition(7)) == pick(rows.coalesce(1)) and len(pick(rows)) == 10
    assert len(pick(spark.range(4))) == 4


def test_last_row_and_keep_first(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, at long, v string")
    assert authors.last_row(rows, "at").first().v == "z"
    assert sorted(tuple(r) for r in authors.keep_first(rows, ["k"], ["at"]).collect()) == [("a", 1, "y"), ("b", 5, "z")]


def test_times_ids_and_tags(spark):
    rows = spark.createDataFrame([("1438603020", "t1_a_b"), (None, "abc"), ("x", "t3_s")], "t string, p string")
    got = rows.select(E.epoch_text(F.col("t")).alias("t"), E.id_kind(F.col("p")).alias("k"), E.id_key(F.col("p")).alias("i")).collect()
    assert [tuple(r) for r in got] == [("03-08-2015 11:57", "t1", "a_b"), ("[unknown_time]", None, None), ("[invalid_time]", "t3", "s")]
    texts = spark.createDataFrame([("<result>a</result> x <result> b \n</result>",), ("x",), (None,)], "t string")
    assert [r[0] for r in texts.select(E.result_tag(F.col("t"))).collect()] == ["b", None, None]
    assert spark.range(1).select(E.word_count(F.lit(" a  b\n"))).first()[0] == 2
    spaced = ["\u00a0a\u3000b c\u2009d\x1ce ", "", "\u00a0", "é à"]
    frame = spark.createDataFrame([(t,) for t in [*spaced, None]], "t string")
    assert [r[0] for r in frame.select(E.word_count(F.col("t"))).collect()] == [*(len(t.split()) for t in spaced), None]
    assert spark.range(1).select(E.result_tag(F.lit("<result>\u00a0b\u3000c\x1f\n</result>"))).first()[0] == "b\u3000c"
    far = spark.createDataFrame([("99999999999999999",), ("-99999999999999999",), ("253402300800",), ("253402300799",), ("1" * 30,)], "t string")
    assert [r[0] for r in far.select(E.epoch_text(F.col("t"))).collect()] == ["[invalid_time]"] * 3 + ["31-12-9999 23:59", "[invalid_time]"]
    assert far.where(E.epoch_timestamp(F.col("t")).isNull()).count() == 4
    assert spark.range(1).select(E.replace_all(F.lit("AB A"), {"A": "x", "AB": "y"})).first()[0] == "y x"
    assert spark.range(1).select(E.safe_name(F.lit("a/b é-1"))).first()[0] == "a_b_é_1"
    assert spark.range(1).select(E.normalised(F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == [0.6, 0.8]


def test_neighbours_leave_out_self_by_id(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (1, 100):
        got = similarity.top_k(base, base, 2, block=block).collect()
        near = {(r.query, r.place): (r.neighbour, r.similarity) for r in got}
        assert near[1, 1] == (2, 1.0) and near[2, 1] == (1, 1.0) and near[3, 1] == (1, 0.0) and len(near) == 8
    assert similarity.top_k(base.limit(0), base, 2).count() == 0


VERDICT = "model string, rank int, correct boolean, input_length long"


def test_leaderboard_counts_judged_rows(spark):
    rows = [("m", 1, True, 1), ("m", -1, None, 2), ("m", 3, False, 3), ("n", -1, None, 4)]
    got = report.leaderboard(spark.createDataFrame(rows, VERDICT)).collect()
    assert [tuple(r) for r in got] == [("m", 2.0, 2, 50.0, 2), ("n", None, 0, None, 0)]


def test_terciles(spark):
    frame = lambda values: spark.createDataFrame([("m", 1, True, v) for v in values], VERDICT)
    assert tuple(report.terciles(frame(range(1, 11)), "input_length").first())[:2] == (4, 7)
    sizes = {r.bucket: r.n_ranked for r in report.leaderboard_by_tercile(frame(range(1, 11))).collect()}
    assert sizes == {"Short": 4, "Medium": 3, "Long": 3}
    assert {r.bucket: r.n_ranked for r in report.leaderboard_by_tercile(frame([5, 5, 5, 9])).collect()} == {"Equal": 3, "Long": 1}
    assert report.leaderboard_by_tercile(frame([1, 2])).count() == 0
    many = [(i * 7919) % 10007 for i in range(3000)]
    q = report.terciles(frame(many), "input_length").first()
    assert (q.q1, q.q2) == tuple(sorted(many)[round(p * 2999)] for p in (0.333, 0.667))


def test_violation_reports(spark):
    counts = spark.createDataFrame([(0,), (2,), (-1,), (4,)], "violation_count int")
    assert tuple(report.violation_summary(counts).first()) == (3, 6, 2.0)
    texts = spark.createDataFrame([('{"A": 1, "B": 2}',), ('{"B": 1}',), ("[1]",), ("x",), (None,)], "v string")
    assert [tuple(r) for r in report.top_violations(texts, "v").collect()] == [("B", 2), ("A", 1)]


def test_unmask(spark):
    masks = spark.createDataFrame([(1, f"MODEL_{m}", f"m{i}") for i, m in enumerate("ABC", 1)], "sample_id long, mask string, model string")
    rank = lambda names: {
        r.model: r["rank"] for r in report.unmask(spark.createDataFrame([(1, names)], "sample_id long, ranking array<string>"), masks).collect()
    }
    assert rank(["MODEL_C", "MODEL_X", "MODEL_A"]) == {"m3": 1, "m1": 2, "m2": -1}
    assert rank(["MODEL_A", "MODEL_B", "MODEL_A"]) == {"m1": 3, "m2": 2, "m3": -1}
