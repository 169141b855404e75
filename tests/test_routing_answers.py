"""Routing (T1–T3) and answer handling."""
import random
import time

from pyspark.sql import functions as F

from casebook.operators import answers as A
from casebook.operators import routing as R

ROUTES = (R.Domain("cardio", ("chest pain", "palpitations", "heart failure"), "cardio"),
          R.Domain("gi", ("heartburn", "abdominal pain"), "gi"),
          R.Domain("musculo", ("ankle pain", "knee injury"), "musculo"),
          R.Domain("noagent", ("exam",), None),
          R.Domain("empty", ("",), "never"))
PROMPTS = [  # the reference's demo prompts
    (1, "Patient presents with chest pain and palpitations after exertion."),
    (2, "45-year-old female reports persistent heartburn and abdominal pain, worse after eating."),
    (3, "Fell yesterday, complaining of severe ankle pain and swelling."),
    (4, "Elderly patient with shortness of breath, history of heart failure and recent knee injury."),
    (5, "Routine physical exam for a healthy 20-year-old."),
    (6, ""),
]


def test_router_demo_prompts(spark):
    df = spark.createDataFrame(PROMPTS, "note_id long, text string")
    got = {r.note_id: r.agents for r in R.route(df, routes=ROUTES).collect()}
    assert got == {1: ["cardio"], 2: ["gi"], 3: ["musculo"], 4: ["cardio", "musculo"], 5: [], 6: []}


def test_router_word_boundaries_are_unicode(spark):
    routes = (R.Domain("fr", ("été",), "fr"), R.Domain("ci", ("CHEST PAIN",), "ci"))
    df = spark.createDataFrame([(1, "un été chaud"), (2, "étéx"), (3, "xété"), (4, "Chest pain."),
                                (5, "chest_pain")], "note_id long, text string")
    got = {r.note_id: r.agents for r in R.route(df, routes=routes).collect()}
    assert got == {1: ["fr"], 2: [], 3: [], 4: ["ci"], 5: []}


def test_automaton_gives_the_agents_of_the_regex(spark, monkeypatch):
    rnd = random.Random(4)
    alphabet = ["ab", "é", "ß", "K", "ſ", "x_", "1", "İ", "σ", "ς", "C++", "-", "."]
    word = lambda: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 3)))
    routes = tuple(R.Domain(f"d{i}", tuple(" ".join(word() for _ in range(rnd.randint(1, 2))) for _ in range(30)),
                            f"a{i % 9}" if i else None) for i in range(12))
    texts = [" ".join(rnd.choice((str, str.upper, str.lower))(word()) for _ in range(rnd.randint(0, 25)))
             for _ in range(300)] + [None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "note_id long, text string").repartition(3)
    fast = {r.note_id: r.agents for r in R.route(df, routes=routes).collect()}
    monkeypatch.setattr(R, "REGEX_KEYWORDS", 10 ** 6)
    slow = {r.note_id: r.agents for r in R.route(df, routes=routes).collect()}
    assert fast == slow and sum(map(len, fast.values())) > 300


def test_cost_does_not_depend_on_the_number_of_keywords(spark):
    words = [f"k{i:05d} tail" for i in range(10_000)]
    routes = (R.Domain("many", tuple(words), "many"), R.Domain("one", ("lone word",), "one"))
    text = "nothing here k00123 tails " * 2000
    seconds = []
    for some in (routes[1:], routes):
        find = R.KeywordAutomaton(some).agents
        start = time.perf_counter()
        for _ in range(5):
            assert find(text) == []
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 20 * seconds[0] + 0.5
    df = spark.createDataFrame([(1, "see K09999 TAIL."), (2, "k09999 tails"), (3, "a lone word")],
                               "note_id long, text string")
    assert {r.note_id: r.agents for r in R.route(df, routes=routes).collect()} == {1: ["many"], 2: [], 3: ["one"]}


def test_automaton_stops_when_every_agent_is_found():
    class Counted:
        def __init__(self, walk):
            self.walk, self.hits = walk, 0

        def iter(self, text):
            for hit in self.walk.iter(text):
                self.hits += 1
                yield hit

    found = R.KeywordAutomaton((R.Domain("a", ("one",), "1"), R.Domain("b", ("two",), "2")))
    found.walk = Counted(found.walk)
    assert found.agents("one two " + "one " * 1000) == ["1", "2"] and found.walk.hits == 2
    assert found.agents("one " * 10 + "TWO") == ["1", "2"]


def test_fold_case_is_character_by_character():
    for text in ("\u00c9T\u00c9 \u00fc", "\u039f\u03a3 \u03a3", "\u0130x", "Stra\u00dfe \u1e9e", "\u212a", "\ufb01"):
        assert R.fold_case(text) == text.translate(R._folds())


def test_routes_from_a_table(spark):
    table = spark.createDataFrame([("d", "a b", "1"), ("d", "c", "1"), ("e", "c", "2"), ("d", "", "1"), ("d", "c", "1")],
                                  "domain string, keyword string, agent_id string")
    assert R.routes_from(table) == (R.Domain("d", ("a b", "c"), "1"), R.Domain("e", ("c",), "2"))


def test_route_summary_and_fanout(spark):
    df = R.route(spark.createDataFrame(PROMPTS, "note_id long, text string"), routes=ROUTES)
    s = {r.label: r.n for r in R.route_summary(df).collect()}
    assert s["cardio"] == 2 and s["multi_routed"] == 1 and s["unrouted"] == 2
    answers = spark.createDataFrame([(4, "cardio", "CHF", 0.7), (4, "gi", "GERD", 0.2)],
                                    "case_id long, agent_id string, diagnosis string, confidence double")
    f = R.fan_out(df, answers).collect()
    assert [(r.case_id, r.agent_id) for r in f] == [(4, "cardio")]


def test_refinement_prompt_blocks(spark):
    cases = spark.createDataFrame([(1, "  72-year-old male with chest pain  ")], "case_id long, text string")
    cands = spark.createDataFrame(
        [(1, "Cardiology", " Likely STEMI. ", 0.825, 1), (1, "General", "Consider MI", None, 2)],
        "case_id long, agent_id string, answer string, confidence double, answer_seq int")
    p = A.refinement_prompts(cases, cands).collect()[0].prompt
    assert p == ("USER CASE:\n72-year-old male with chest pain\n\nCANDIDATE ANSWERS:\n"
                 "[Cardiology] (confidence=0.82):\nLikely STEMI.\n\n[General]:\nConsider MI\n\n")
    n = A.numbered_agent_list(cases, cands).collect()[0].prompt
    assert n.endswith("1. Agent: Cardiology, Diagnosis:  Likely STEMI. , Confidence: 0.82\n"
                      "2. Agent: General, Diagnosis: Consider MI, Confidence: N/A")


def test_parse_refined(spark):
    raw = spark.createDataFrame([
        ('{"diagnosis": "STEMI", "reasoning": "r", "confidence": "1.5"}',),
        ('{"diagnosis": "STEMI", "reasoning": "r", "confidence": 0.4, "x": 1}',),
        ('{"diagnosis": "STEMI", "confidence": 0.4}',),
        ('{"diagnosis": "STEMI", "reasoning": "r", "confidence": "high"}',),
        ('not json',)], "raw string")
    out = [(r.ok, r.reject_reason, r.confidence) for r in A.parse_refined(raw).collect()]
    assert out == [(True, None, 1.0), (False, "wrong_keys", None), (False, "wrong_keys", None),
                   (False, "bad_confidence", None), (False, "not_a_json_object", None)]


def test_parse_delimited(spark):
    lines = spark.createDataFrame([("cardio::STEMI::0.85",), (" gi::GERD::2 ",), ("a::b",),
                                   ("a::b::c::d",), ("a::b::x",)], "line string")
    out = [(r.ok, r.agent_id, r.diagnosis, r.confidence, r.reject_reason)
           for r in A.parse_delimited(lines).collect()]
    assert out == [(True, "cardio", "STEMI", 0.85, None), (True, "gi", "GERD", 1.0, None),
                   (False, None, None, None, "wrong_field_count"),
                   (False, None, None, None, "wrong_field_count"),
                   (False, None, None, None, "bad_confidence")]


def test_parse_sections(spark):
    df = spark.createDataFrame([
        ("Primary Diagnosis: STEMI\nSecondary Diagnoses: CHF; AF , \nRationale: ECG changes",),
        ("Primary Diagnosis: GERD\nSecondary Diagnoses: None\nRationale: burning",),
        ("no sections",)], "answer string")
    out = [(r.primary, r.secondary, r.rationale) for r in A.parse_sections(df).collect()]
    assert out == [("STEMI", ["CHF", "AF"], "ECG changes"), ("GERD", [], "burning"), (None, [], None)]


def test_format_fixed_matches_python(spark):
    from casebook.functions.columns import format_fixed
    vals = [0.825, 0.125, 0.375, 2.675, -0.825, -0.001, 0.0, 1.0, 99.995, 1e-9, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(format_fixed("x", 2)).collect()]
    assert got == [None if v is None else f"{v:.2f}" for v in vals]


def test_refinement_prompt_reference_demo(spark):
    case = "72‑year‑old male with crushing substernal chest pain,.."
    cands = [("Cardiology‑Phi2", "Likely STEMI. Recommend immediate PCI.", 0.82, 1),
             ("Metabolic‑Phi2", "Chest pain could be metabolic (DKA) but STEMI more probable. "
                                     "Suggest troponin & PCI.", 0.55, 2),
             ("General‑GPT35", "Consider acute MI; initiate MONA protocol.", 0.70, 3)]
    cases = spark.createDataFrame([(1, case)], "case_id long, text string")
    cdf = spark.createDataFrame([(1, a, t, c, s) for a, t, c, s in cands],
                                "case_id long, agent_id string, answer string, confidence double, "
                                "answer_seq int")
    got = A.refinement_prompts(cases, cdf, order_cols=("answer_seq",)).collect()[0].prompt
    blocks = "\n".join(f"[{a}] (confidence={c:.2f}):\n{t}\n" for a, t, c, _ in cands)
    assert got == f"USER CASE:\n{case}\n\nCANDIDATE ANSWERS:\n{blocks}\n"


def test_format_fixed_other_digits_and_specials(spark):
    from casebook.functions.columns import format_fixed
    vals = [2.5, 3.5, 0.0005, 1.2345, -1.5, float("nan"), float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r0 = [r[0] for r in df.select(format_fixed("x", 0)).collect()]
    r3 = [r[0] for r in df.select(format_fixed("x", 3)).collect()]
    assert r0[:5] == [f"{v:.0f}" for v in vals[:5]]          # 2.5 -> '2', 3.5 -> '4' (half-even)
    assert r3[:5] == [f"{v:.3f}" for v in vals[:5]]
    assert r0[5:] == ["nan", "inf", "-inf"]
