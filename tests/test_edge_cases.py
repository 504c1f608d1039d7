"""Inputs that the driver tables do not hold: repeated lines and keys, skew, crowded scores, tiny fractions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regtext.operators import cleaning as C
from regtext.operators import metrics as M
from regtext.operators import pairs as J
from regtext.operators import prep as P
from regtext.operators import ranking as RK
from regtext.operators import split as R
from regtext.operators import tokens as TK
from regtext.plans.cohort import build_cohort


# ---------------------------------------------------------------- A1-A3
@pytest.mark.parametrize("chunk", [None, 2, 1000])
def test_a2_repeated_lines_kept_once(spark, chunk):
    df = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 5, "z"), (1, 5, "c")], "k int, line int, text string")
    assert [r.concat_text for r in P.ordered_concat(df, ["k"], "line", "text", chunk_lines=chunk).collect()] == ["a\nb\nc"]


def test_a3_in_one_aggregate(spark):
    df = spark.createDataFrame([(1, 2, "b", "x"), (1, 1, "a", "y"), (2, 1, None, "x")], "k int, line int, t string, tag string")
    out = P.sort_group_concat(df, ["k"], "t", "line", ["k", "concat_text", "tag"], "k")
    assert [tuple(r) for r in out.collect()] == [(1, "a\nb", "y")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a8_zero_cut_masks_nothing_and_columns_share_a_job(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "p string, q string")
    assert sorted(map(tuple, P.mask_rare(df, ["p", "q"], 0.0).collect()), key=str) == [("a", "x"), ("a", "y"), ("b", None)]
    assert P.frequent_values(df, ["p", "q"], 0.5) == {"p": ["a"], "q": ["x", "y"]}


# ---------------------------------------------------------------- K3 and the order statistics
def test_global_offsets_with_repeated_keys_and_a_far_key(spark):
    rows = [(7, i % 5, 1 + i % 3) for i in range(900)] + [(i, 0, 2) for i in range(100)] + [(10 ** 15, 0, 4)]
    df = spark.createDataFrame(rows, "k long, t long, w long")
    out, total = RK.global_offsets(df, ["k", "t", "w"], "w", rows_per_range=40)
    got = sorted((r.k, r.t, r.w, r.offset) for r in out.collect())
    assert total == sum(w for _, _, w in rows) and len({o for *_, o in got}) == len(rows)
    run = 0
    for k, t, w, o in sorted(got, key=lambda r: r[3]):
        assert o == run
        run += w
    assert [r[:3] for r in sorted(got, key=lambda r: r[3])] == sorted(rows)


def test_ranges_are_even_although_one_key_holds_most_rows(spark):
    df = spark.createDataFrame([(7, i) for i in range(5000)] + [(i + 10 ** 9, 0) for i in range(200)], "k long, t long")
    bounds = RK.range_bounds(df, ["k", "t"], 5200, 26)
    sizes = [r["count"] for r in df.groupBy(RK.range_number(df, ["k", "t"], bounds).alias("r")).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * 200


def test_k3_repeated_and_far_keys_in_many_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), [int(x) for x in rng.integers(0, 100, rng.integers(0, 9))]) for k in [3] * 200 + list(range(300)) + [10 ** 14]]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    blocks = TK.pack_blocks(df, "k", "ids", 64, rows_per_range=20).collect()
    total = sum(len(i) for _, i in rows)
    assert sorted(b.block_id for b in blocks) == list(range(total // 64)) and all(len(b.input_ids) == 64 for b in blocks)
    small = spark.createDataFrame([(1, [1, 2]), (1, [3, 4]), (2, [5, 6])], "k long, ids array<int>")
    got = {b.block_id: b.input_ids for b in TK.pack_blocks(small, "k", "ids", 2).collect()}
    assert sorted(map(tuple, got.values())) == [(1, 2), (3, 4), (5, 6)] and got[2] == [5, 6]


def test_k3_many_ranges_equal_one(spark):
    from regtext.functions import text as X
    from regtext.plans.tables import table

    from .conftest import SF_SMALL
    d = table(spark, SF_SMALL, "documents")
    ids = TK.to_ids(d, "doc_id", X.unicode_words("text"), TK.build_vocabulary(d, "text"))
    a, b = (sorted((r.block_id, tuple(r.input_ids)) for r in TK.pack_blocks(ids, "doc_id", "ids", 512, rows_per_range=n).collect()) for n in (7, 10 ** 6))
    assert a == b


def test_vocabulary_rank_in_many_ranges(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(j)),) for j in range(0, 60, 2)], "text string")
    v = [tuple(r) for r in TK.build_vocabulary(df, "text", rows_per_range=5).orderBy("token_id").collect()]
    want = sorted({(t, n) for t, n, _ in v}, key=lambda x: (-x[1], x[0]))
    assert [(t, n) for t, n, _ in v] == want and [i for *_, i in v] == list(range(4, 4 + len(v)))


def test_rows_with_one_key_keep_their_own_ids(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, []), (3, None)], "k long, w array<string>")
    vocab = spark.createDataFrame([("a", 1, 4), ("b", 1, 5)], "token string, n long, token_id int")
    got = sorted((r.k, r.ids) for r in TK.to_ids(df, "k", F.col("w"), vocab).collect())
    assert got == [(1, [4, 5]), (1, [5]), (2, []), (3, [])]


# ---------------------------------------------------------------- R3 / A13
def test_hash_sample_below_one_in_ten_thousand(spark):
    n = R.hash_sample(spark.range(200000), "id", 0.00004).count()
    assert 1 <= n <= 20


# ---------------------------------------------------------------- metrics
def _scores(spark, y, s, label="a"):
    return spark.createDataFrame([(i, label, a, b) for i, (a, b) in enumerate(zip(y, s))], "row_id long, label string, y_true int, score double")


def test_crowded_scores_spread_over_buckets(spark):
    n = 20000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.lit("a").alias("label"), (F.col("id") % 2).cast("int").alias("y_true"),
                               (F.lit(0.7) + F.col("id") * 1e-9).alias("score"))
    cum = M.cumulative_counts(df, score_buckets=64)
    assert cum.count() == n and M.roc_auc(cum).first().auc == pytest.approx(0.5, abs=1e-3)
    points = [i / 64 for i in range(1, 64)]
    q = df.agg(F.percentile_approx("score", points, 20 * 64)).first()[0]
    sizes = np.histogram(0.7 + np.arange(n) * 1e-9, bins=[0, *q, 1])[0]
    assert sizes.max() < 3 * n / 64


def test_null_and_nan_scores_are_left_out_everywhere(spark):
    good = _scores(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    bad = good.unionByName(_scores(spark, [1, 0, 1, None], [None, float("nan"), float("nan"), 0.9]))
    for f in (lambda d: M.label_stats(M.cumulative_counts(d)), lambda d: M.confusion(d, F.col("score") >= 0.5), M.losses,
              M.evaluation_report, M.logits_report):
        assert sorted(map(repr, f(bad).collect())) == sorted(map(repr, f(good).collect()))
    assert M.unusable_count(bad).first().n_unusable == 4


def test_m12_reads_its_input_once(spark):
    """The scored rows are read by the job that writes the per-score counts and by nothing after it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = _scores(spark, [0, 1, 1, 0], [-1.0, 2.0, 0.5, -0.2])
    out = M.logits_report(df.mapInPandas(count, df.schema))
    assert len(out.collect()) == 6 and seen.value == 4


def test_m15_wide(spark):
    df = _scores(spark, [1, 0], [0.9, 0.9]).unionByName(_scores(spark, [1], [0.1], "b"))
    texts = spark.createDataFrame([(0, "t0"), (1, "t1")], "row_id long, text string")
    got = sorted(tuple(r) for r in M.error_types_wide(df, F.col("score") >= 0.5, ["a", "b"], texts).collect())
    assert got == [(0, "tp", "fn", "t0"), (1, "fp", None, "t1")]


# ---------------------------------------------------------------- J7
def test_j7_repetitive_text_gives_linear_rows(spark):
    a = spark.createDataFrame([(1, "x " * 300), (2, "y " * 10 + "a b c d e f g h i " + "z " * 10)], "id long, t string")
    b = spark.createDataFrame([(9, "x " * 300), (8, "q a b c d e f g h i r")], "item long, t string")
    out = J.longest_shared_passage(a, "id", "t", b, "item", "t", k=8)
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 9, 0, 0, 300), (2, 8, 10, 1, 9)]
    # the join keeps ends of runs only: checked on its rows
    hits = J._hits(a, "id", "t", b, "item", "t", 8, 5, 4, "word")
    assert hits.filter("_key = 1").count() <= 4 * 300


def test_j7_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    left = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, 40))) for i in range(12)]
    right = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3, 25))) for i in range(6)]

    def longest(x, y, k):
        best = None
        for i in range(len(x)):
            for j in range(len(y)):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n >= k and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        return best and (best[1], best[2], -best[0])
    out = J.longest_shared_passage(spark.createDataFrame(left, "id long, t string"), "id", "t",
                                   spark.createDataFrame(right, "item long, t string"), "item", "t", k=4)
    want = [(i, j, *m) for i, x in left for j, y in right if (m := longest(x.split(), y.split(), 4))]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


# ---------------------------------------------------------------- the cohort
def _notes(spark):
    rows = [(1, "op", 1, "p1", "d1", "first note"), (1, "op", 2, "p1", "d1", "second line"), (1, "op", 2, "p1", "d1", "second line"),
            (2, "op", 1, "p1", "d1", "other note"), (3, "op", 1, "p2", "d2", "third note")]
    return spark.createDataFrame(rows, "note long, desc string, line int, pat string, surg string, t string")


def test_cohort_first_line_gives_one_row_per_surgery(spark):
    reg = spark.createDataFrame([("p1", "d1", 1), ("p2", "d2", None)], "pat string, surg string, SP_x int")
    out = build_cohort(_notes(spark), reg, "note", "desc", "line", "t", {"pat": "pat", "surg": "surg"}, ["SP_x"],
                       concatenate=False, preprocess=False, split=None)
    assert sorted((r.pat, r.SP_x, r.text) for r in out.collect()) == [("p1", 1, "first note"), ("p2", 0, "third note")]


def test_cohort_concat_drops_repeated_lines_and_extra_registry_rows(spark):
    reg = spark.createDataFrame([("p1", 1), ("p1", 0), ("p2", 1)], "pat string, SP_x int")
    out = build_cohort(_notes(spark), reg, "note", "desc", "line", "t", {"pat": "pat"}, ["SP_x"], preprocess=False, split=None)
    got = sorted((r.note, r.SP_x, r.text) for r in out.collect())
    assert got == [(1, 0, "first note\nsecond line"), (2, 0, "other note"), (3, 1, "third note")]


def test_cohort_raw_registry_one_hot_and_version_split(spark, tmp_path):
    n = 80
    notes = spark.createDataFrame([(i, "op", 1, f"p{i}", f"note {i}") for i in range(n)], "note long, desc string, line int, pat string, t string")
    reg = spark.createDataFrame([(f"p{i}", "odd" if i == 3 else ("yes" if i % 2 else "no")) for i in range(n)], "pat string, kind string")
    out = build_cohort(notes, reg, "note", "desc", "line", "t", {"pat": "pat"}, ["kind"], label_source="raw", preprocess=False, split=None)
    assert [c for c in out.columns if c.startswith("kind_")] == ["kind_NULL", "kind_no", "kind_yes"]
    assert out.agg(F.sum("kind_NULL"), F.sum("kind_no"), F.sum("kind_yes")).first()[:] == (1, 40, 39)
    versions = spark.createDataFrame([(f"p{i}", "main" if i < 60 else "else", 4.2 if i % 4 == 0 else 2.9) for i in range(n)],
                                     "pat string, site string, version double")
    split = build_cohort(notes, reg.withColumn("SP_x", F.lit(1)), "note", "desc", "line", "t", {"pat": "pat"}, ["SP_x"], preprocess=False,
                         split="version", versions=versions, site="main", test_version=4.2, export=str(tmp_path / "out"))
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 38, "validation": 7, "test": 15}
    assert spark.read.parquet(str(tmp_path / "out" / "split=test")).count() == 15


# ---------------------------------------------------------------- cleaning, registry scans, scratch tables
def test_cleaning_report_counts(spark):
    df = spark.createDataFrame([("a", "seen in May"), ("a", "at 10:30"), ("b", None), ("b", "plain")], "g string, text string")
    got = {(r.g, r.step): (r.n_rows, r.n_changed, r.n_emptied) for r in C.cleaning_report(df, ["time_info", "dr_names"], ["g"]).collect()}
    assert got == {("a", "time_info"): (2, 2, 0), ("a", "dr_names"): (2, 0, 0), ("b", "time_info"): (1, 0, 0), ("b", "dr_names"): (1, 0, 0)}
    assert [r.text for r in C.clean(df, ["dr_names"]).orderBy("text").collect()] == ["at 10:30", "plain", "seen in May"]


def test_csv_rejects_are_counted(spark, tmp_path):
    from pyspark.sql.types import StructType

    from regtext.sources.notes import read_table, scan_rejects
    p = tmp_path / "r.csv"
    p.write_text("k,v\n1,2\nx,3\n4,oops\n")
    schema = StructType.fromDDL("k int, v int")
    assert sorted(map(str, map(tuple, read_table(spark, str(p), "csv", schema, tolerant=True).collect()))) == ["(1, 2)", "(4, None)", "(None, 3)"]
    assert sorted(r._corrupt_record for r in scan_rejects(spark, str(p), schema).collect()) == ["4,oops", "x,3"]


def test_scratch_folder_is_refused_off_local_masters(spark, monkeypatch):
    from regtext import session

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_scratch_tables_go_when_the_application_ends(tmp_path):
    import subprocess
    import sys
    from pathlib import Path
    code = ("from regtext.session import build_session, materialize\n"
            f"s = build_session('local[1]', extra={{'spark.checkpoint.dir': '{tmp_path}'}})\n"
            "print(materialize(s.range(5), 'x').count())\ns.stop()\n")
    r = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, timeout=120)
    assert r.stdout.strip().endswith("5"), r.stderr[-500:]
    assert not list(tmp_path.glob("x-*"))


def test_ids_of_batches_send_a_word_once_and_rows_keep_theirs(spark, monkeypatch):
    monkeypatch.setattr(TK, "ROWS_PER_BATCH", 7)
    monkeypatch.setattr(TK, "LONG_ROW", 20)
    rows = [(i % 40 or None, None if i % 31 == 0 else [f"w{(i * j) % 13}" for j in range(i % 25)] + [None] * (i % 5 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, w array<string>").repartition(3)
    vocab = spark.createDataFrame([(f"w{i}", 1, 4 + i) for i in range(12)], "token string, n long, token_id int")
    out = TK.to_ids(df, "k", F.col("w"), vocab)
    ids = {f"w{i}": 4 + i for i in range(12)}
    assert sorted(map(str, ((r.k, r.ids) for r in out.collect()))) == sorted(str((k, [ids.get(x, 0) for x in w or []])) for k, w in rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan  # distinct words of a batch meet the vocabulary
    assert TK.to_ids(df, "k", F.col("w"), vocab.limit(0)).agg(F.max(F.array_max("ids"))).first()[0] == 0


def test_pack_ranges_are_bounded_by_ids(spark, monkeypatch):
    monkeypatch.setattr(TK, "IDS_PER_RANGE", 500)
    asked, offsets = [], RK.global_offsets
    monkeypatch.setattr(TK, "global_offsets", lambda df, order, w, per, **a: asked.append(per) or offsets(df, order, w, per, **a))
    df = spark.createDataFrame([(k, list(range(k, k + 50))) for k in range(200)], "k long, ids array<int>")
    got = {b.block_id: b.input_ids for b in TK.pack_blocks(df, "k", "ids", 64).collect()}
    flat = [x for k in range(200) for x in range(k, k + 50)]
    assert asked == [10] and got == {i: flat[64 * i:64 * i + 64] for i in range(len(flat) // 64)}


def test_first_words_equal_the_head_of_all(spark):
    from regtext.functions import text as X
    texts = [None, "", " ", "a", " a", "a b c", "a b c ", "-a b c d", "a b c d e.", "A--b", "..a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4):
        assert all(a == b for a, b in df.select(X.unicode_words("t", n), F.slice(X.unicode_words("t"), 1, n)).collect())


def test_sentence_words_are_cut_before_they_are_looked_up(spark, monkeypatch):
    written = []
    keep = TK.materialize_table
    monkeypatch.setattr(TK, "materialize_table", lambda df, name, *a: written.append((name, keep(df, name, *a))) or written[-1][1])
    vocab = spark.createDataFrame([(f"w{i}", 1, 4 + i) for i in range(40)], "token string, n long, token_id int")
    rows = [(n, [[f"w{i % 40}" for i in range(j, min(j + 3, n))] for j in range(0, n, 3)]) for n in (0, 1, 5, 6, 7, 8, 9, 50)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, s array<array<string>>")
    got = {r.k: (r.input_ids, r.attention_mask) for r in TK.encode_sentences(df, "k", "s", vocab, max_len=10).collect()}
    for k, lists in rows[:-1]:
        ids = [2] + [i for ws in lists for i in [*(4 + int(w[1:]) for w in ws), 3]]
        want = (ids[:9] + [3], [1] * 10) if len(ids) >= 10 else (ids + [1] * (10 - len(ids)), [1] * len(ids) + [0] * (10 - len(ids)))
        assert got[k] == want, k
    assert max(r[0] for n, t in written if n == "batched-words" for r in t.filter("_w IS NOT NULL").select(F.size("_w")).collect()) <= 10
