"""Flagship corpus query (C1–C9) on hand-made tables: cutoff, history, future, novelty."""
import datetime as dt

from casebook.operators import corpus

D = dt.date
COND = "START date, STOP date, PATIENT long, CODE string, DESCRIPTION string"
PAT = "ID long, BIRTHDATE date, GENDER string, RACE string, ETHNICITY string"


def _frames(spark, cond_rows, pat_rows):
    return spark.createDataFrame(cond_rows, COND), spark.createDataFrame(pat_rows, PAT)


def test_cutoff_is_exact_discrete_quantile(spark):
    c = spark.createDataFrame([(D(2000, 1, i), None, 1, "x", "y") for i in range(1, 11)], COND)
    # 0.8 quantile (discrete) of ten consecutive days is day 8
    assert corpus.temporal_cutoff(c).collect()[0].cutoff == D(2000, 1, 8)


def test_prompt_history_future_and_novelty(spark):
    cond = [(D(2000, 1, d), None, 1, f"c{d}", f"desc {d}") for d in range(1, 9)]
    cond += [(D(2000, 1, 9), None, 1, "c1", "desc 1"),        # repeats a past code
             (D(2000, 1, 10), None, 1, "c0", "later")]
    cond += [(D(2000, 1, 1), None, 2, "a", "x, y"), (D(2000, 1, 9), None, 2, "b", "new")]
    cond += [(D(2000, 1, 9), None, 3, "z", "future only")]    # no past -> no sample
    c, p = _frames(spark, cond, [(1, D(1950, 6, 1), "M", "White", ""), (2, None, "", None, "Hisp"),
                                 (3, D(1990, 1, 1), "F", "w", "e")])
    out = {r.patient_id: r for r in corpus.corpus_samples(c, p).collect()}
    assert set(out) == {1, 2}
    cutoff = corpus.temporal_cutoff(c).collect()[0].cutoff
    assert cutoff == D(2000, 1, 9)
    hist1 = "; ".join(f"c{d} (desc {d})" for d in range(1, 9))
    assert out[1].text == f"49-year-old M white unknown-ethnicity patient. History of: {hist1}.\n\nAI: c1"
    assert out[1].label == "c1"
    # ', ' inside a description is split like the reference does; unknown age / gender / race
    assert out[2].text == ("unknown-age-year-old unknown-gender unknown-race hisp patient. "
                           "History of: a (x; y).\n\nAI: b")
    novel = {r.patient_id for r in corpus.corpus_samples(c, p, allow_repeats=False).collect()}
    assert novel == {2}


def test_history_keeps_first_40_fragments(spark):
    cond = [(D(2000, 1, 1), None, 1, f"k{i:02d}", "d") for i in range(50)]
    cond += [(D(2001, 1, 1), None, 1, "f", "d")] * 20
    c, p = _frames(spark, cond, [(1, D(1960, 1, 1), "M", "r", "e")])
    t = corpus.corpus_samples(c, p).collect()[0].text
    hist = t.split("History of: ")[1].split(".\n\n")[0]
    assert hist.split("; ") == [f"k{i:02d} (d)" for i in range(40)]


def test_limit_and_count(spark):
    cond = [(D(2000, 1, 1), None, i, "a", "b") for i in range(5)] + \
           [(D(2000, 2, 1), None, i, "c", "d") for i in range(5)] + \
           [(D(2000, 3, 1), None, i, "e", "f") for i in range(5)]
    c, p = _frames(spark, cond, [(i, D(1970, 1, 1), "M", "r", "e") for i in range(5)])
    s = corpus.corpus_samples(c, p)
    assert corpus.count_samples(s).collect()[0].n_rows == 5
    assert [r.patient_id for r in corpus.limit_samples(s, 2).collect()] == [0, 1]
    assert corpus.limit_samples(s, 0).count() == 5


def test_approximate_cutoff_is_close(spark):
    c = spark.createDataFrame([(D(2000, 1, 1) + dt.timedelta(days=i), None, 1, "x", "y")
                               for i in range(1000)], COND)
    exact = corpus.temporal_cutoff(c).collect()[0].cutoff
    approx = corpus.temporal_cutoff(c, exact=False).collect()[0].cutoff
    assert isinstance(approx, dt.date) and abs((approx - exact).days) <= 1


def test_labels_without_text_are_the_samples_labels(spark):
    from casebook.sources import views as V
    sf = "/root/testdata/sf0.001"
    for repeats in (True, False):
        a = corpus.corpus_samples(V.conditions(spark, sf), V.patients(spark, sf), repeats, staged=repeats)
        b = corpus.corpus_labels(V.conditions(spark, sf), V.patients(spark, sf), repeats)
        assert sorted(map(tuple, a.select("patient_id", "label").collect())) == sorted(map(tuple, b.collect()))
        plan = b._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_repeated_patients_do_not_multiply_samples(spark):
    from casebook.sources import views as V
    sf = "/root/testdata/sf0.001"
    pts = V.patients(spark, sf)
    once = corpus.corpus_samples(V.conditions(spark, sf), pts).count()
    assert corpus.corpus_samples(V.conditions(spark, sf), pts.unionAll(pts)).count() == once
