import pytest

from hirelode import rules
from hirelode.functions import classify


def test_zones_in_order(values):
    got = values(
        classify.location_zone, "Remote (Berlin)", "Berlin", "Kassel, Hessen", "KÖLN", "Leipzig",
        "Paris", "", None, "Home Office",
    )
    assert got == [
        "Remote", "Zone1_Berlin", "Zone3_Stretch", "Zone3_Stretch", "Zone2_Near", "Other", "Other",
        "Other", "Remote",
    ]
    word = lambda v: classify.location_zone(v, whole_word=True)
    assert values(word, "Kassel, Hessen", "Essen, NRW") == ["Other", "Zone3_Stretch"]


def test_region(values):
    # Folded "koeln" is not in the list; the state is.
    got = values(classify.is_in_region, "Köln", "Köln, NRW", "München", "Paris", "", None, "Sachsen")
    assert got == [False, True, True, False, False, False, True]


def test_skills_in_dictionary_order(values):
    got = values(
        classify.extract_skills,
        "SQL and Python; data  science, PowerBI, data analytic",
        "künstliche Intelligenz, KI und AI",
        "maintain pipelines, mysql, data engineering",
        None,
    )
    assert got == [
        ["Python", "SQL", "Data Science", "Power BI", "Data Analytics"],
        ["AI", "KI"],
        ["Data Engineering"],
        [],
    ]


@pytest.mark.parametrize("label,patterns,words", rules.CORE_SKILLS + rules.SUPPORTING_SKILLS)
def test_each_pattern_has_a_guard_word(label, patterns, words):
    assert len(patterns) == len(words)
    for pattern, word in zip(patterns, words, strict=True):
        assert word in pattern, label


def test_german_level(values):
    got = values(
        classify.german_level, "sehr gute Deutschkenntnisse", "gute Deutschkenntnisse",
        "Fließend Deutsch", "C1 level in German", "German at B2 or better", "German is a plus", "B1 German",
        "Deutschkenntnisse von Vorteil", "English only", None, "c1\ngerman", "verhandlungssicher",
        "deutsch in wort und schrift",
    )
    assert got == [
        "required", "preferred", "required", "required", "required", "preferred", "preferred",
        "preferred", "not_required", "not_required", "not_required", "required", "required",
    ]


def test_relevance(values):
    got = values(
        classify.relevance,
        ("Data intern", "Python, AWS"), ("Data intern", "AWS"), ("Data intern", "AWS, Excel"),
        ("Sales intern", "Python, SQL"), (None, None), columns=("title", "description"),
    )
    assert [(r["label"], r["score"]) for r in got] == [
        ("high_relevant", 3.0), ("non_relevant", 0.0), ("relevant", 2.0), ("non_relevant", 0.0),
        ("non_relevant", 0.0),
    ]


def test_keep_title(values):
    got = values(classify.keep_title, "Working Student X", "International Manager", "Engineer")
    assert got == [True, True, False]


def test_it_related(values):
    got = values(
        classify.it_related,
        ("Software intern", ""), ("HR Software", ""), ("Chrome developer", ""), ("IT Support", ""),
        ("Kit builder", ""), ("Analytics Werkstudent", "data"), ("Analytics Werkstudent", "office"),
        ("Werkstudent", "data engineer"), (None, None), columns=("title", "keyword"),
    )
    assert got == ["yes", "no", "no", "yes", "no", "yes", "no", "no", "no"]


def test_parse_scraped(values):
    got = values(classify.parse_scraped, "2026-04-01 09:30", "2026-4-1 9:30", " ", "01.04.2026", None, "2026-04-01 \t 09:30")
    assert got[0] == got[1] and got[0].minute == 30
    assert got[2:5] == [None, None, None] and got[5] == got[0]


FLAGS = ("pending boolean", "message boolean", "connect boolean", "follow boolean", "sent boolean")


def test_visit_status(values):
    t, f = True, False
    rows = [(t, t, t, t, t), (f, t, f, f, t), (f, t, t, f, t), (f, f, t, t, f), (f, f, t, f, f), (f, f, f, t, f)]
    got = values(lambda p, m, c, w, s: classify.visit_status(p, m, c, w, s), *rows, columns=FLAGS)
    assert got == ["already_pending", "already_connected", "connect", "follow", "visited_only", "follow"]
    only = values(lambda p, m, c, w, s: classify.visit_status(p, m, c, w, s, "connect"), *rows, columns=FLAGS)
    assert only[3] == "visited_only"
    three = values(
        lambda p, m, c, w, s: classify.visit_status(p, m, c, w, mode="connect", states=3), *rows, columns=FLAGS
    )
    assert three == ["visited_only", "visited_only", "connect", "connect", "connect", "follow"]


def test_run_mode_topics_are_complete():
    assert len(rules.SEARCH_KEYWORDS) == 7
    assert len(rules.DEVOPS_KEYWORDS) == 29
