"""Counting, positions, context and the agreement of the matching plans."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termscan.functions import grams
from termscan.functions.folding import case_variants, fold_string, folded
from termscan.functions.text import line_context
from termscan.operators import matching, ranking
from termscan.operators.matching import Term, prefix_free_layers, vocabulary
from termscan.plans.scan import hit_rows
from termscan.spec import ScanSpec


PLANS = [matching._search_each, matching._search_layers]


def counts(files, terms, plan=None):
    entries = vocabulary(terms)
    ready = matching.with_folded(files, matching.alphabet(entries))
    found = (plan or matching.match_terms)(ready, entries)
    return {(r.path, r.term): (r.frequency, r.position) for r in found.collect()}


@pytest.mark.parametrize(
    "text,terms,expected",
    [
        ("Irisification", ["Iris", "Irisification"], {"Iris": 1, "Irisification": 1}),
        ("aaaa", ["aa"], {"aa": 2}),
        ("a.b axb", ["a.b"], {"a.b": 1}),
        ("score CORE", ["Core"], {"Core": 2}),
        ("ÜBER über", ["über"], {"über": 2}),
        ("x\\E[y] \\E", ["\\E"], {"\\E": 2}),
        ("nothing here", ["absent"], {}),
        ("the end", [" ", "", "the"], {"the": 1}),
        ("\U00010400 \U00010428", ["\U00010428"], {"\U00010428": 2}),
    ],
)
@pytest.mark.parametrize("plan", PLANS)
def test_literal_counts(files_of, plan, text, terms, expected):
    got = counts(files_of(("/f", text)), terms, plan)
    assert {term: n for (_, term), (n, _) in got.items()} == expected


def test_first_spelling_of_a_repeated_term_is_kept():
    assert [t.term for t in vocabulary(["AlphaA", "alphaa", " ", "x"])] == ["AlphaA", "x"]


def test_table_of_terms_keeps_first_spelling(spark):
    table = spark.createDataFrame([(3, "alphaa"), (1, "AlphaA"), (2, "  "), (4, "x")], "term_id int, term string")
    assert sorted(map(tuple, matching.distinct_terms(table).collect())) == [(1, "AlphaA"), (4, "x")]


def test_layers_hold_no_prefix_of_each_other():
    layers = prefix_free_layers(["a", "ab", "abc", "b", "xab"])
    assert layers == [["a", "b", "xab"], ["ab"], ["abc"]]


def brute_force(text, term):
    low, needle = fold_string(text), fold_string(term)
    return low.count(needle), low.find(needle) + 1


words = st.text(alphabet="abAB.ß ſKİıσςΣé\n|", min_size=0, max_size=40)
term_lists = st.lists(st.text(alphabet="abk.sißσé|", min_size=1, max_size=4).filter(str.strip), min_size=1, max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(words, min_size=1, max_size=6), terms=term_lists)
def test_all_plans_agree_with_a_plain_loop(files_of, texts, terms):
    files = files_of(*[(f"/{i}", t) for i, t in enumerate(texts)])
    expected = {
        (f"/{i}", t.term): brute_force(text, t.term)
        for i, text in enumerate(texts) for t in vocabulary(terms) if brute_force(text, t.term)[0]
    }
    for plan in PLANS:
        assert counts(files, terms, plan) == expected


def test_counts_equal_the_case_insensitive_regex(files_of):
    text = "ſchver KELVIN Kelvin İstanbul ıstanbul ΣΑΣ σας µ μ Straße STRASSE ǅ ǆ ͅ ι"
    terms = ["schver", "kelvin", "istanbul", "σας", "μ", "ß", "ǆ", "ι", "s"]
    files = files_of(("/f", text))
    for term in terms:
        rx = F.lit("(?iu)" + re.escape(term))
        expected = files.select(F.regexp_count("text", rx), F.regexp_instr("text", rx)).first()
        assert counts(files, [term]).get(("/f", term)) == tuple(expected), term


def test_folding_agrees_with_the_regex_engine_on_every_character(spark):
    """Each character folds to something ``(?iu)`` calls equal, and no letter is missed."""
    # Characters unknown to this Python's Unicode tables, and surrogates, are left out.
    known = [chr(c) for c in range(1, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    chars = [(c, fold_string(c)) for c in known]
    table = spark.createDataFrame(chars, "c string, want string")
    letters = set(case_variants().values())
    got = table.select("c", "want", folded(F.col("c"), letters).alias("got"))
    assert got.where("got <> want").count() == 0
    quoted = F.concat(F.lit("(?iu)^\\x{"), F.lower(F.hex(F.encode("want", "UTF-32"))), F.lit("}$"))
    # Left out: letters newer than the engine's tables, and the capital sharp s,
    # which the engine finds by pattern and text in one direction only.
    changed = got.where((F.col("c") != F.col("want")) & F.rlike("c", F.lit("\\p{IsAssigned}")) & (F.col("c") != "ẞ"))
    assert changed.where(~F.rlike("c", quoted)).count() == 0
    # Characters equal to a letter but folding elsewhere would be missed matches.
    alphabet = sorted({want for _, want in chars if want != want.upper()})
    every = "(?iu)^[" + "".join(a for a in alphabet if a.isalpha()) + "]$"
    missed = got.where(F.rlike("c", F.lit(every)) & ~F.col("want").isin(alphabet))
    assert missed.count() == 0


@pytest.mark.parametrize(
    "text,position,expected",
    [
        ("first\nsecond line\nthird", 9, "second line"),
        ("a\t b\r\nnext", 1, "a b"),
        ("x" * 300 + "needle", 301, "x" * 240),
        ("one\n" + "y" * 260, 10, "y" * 240),
        ("last line no newline", 6, "last line no newline"),
        ("no\u00a0break\u2003space", 1, "no break space"),
        ("é\nünï x", 5, "ünï x"),
    ],
)
def test_line_context(spark, text, position, expected):
    table = spark.createDataFrame([(text, position)], "t string, p int")
    assert table.select(line_context(F.col("t"), F.col("p"))).first()[0] == expected


def test_long_layers_are_cut_into_patterns_without_changing_the_result(files_of, monkeypatch):
    terms = [f"t{i}x" for i in range(300)] + ["t1", "t12", "T5X"]
    text = " ".join(f"T{i}x" for i in range(0, 300, 3))
    files = files_of(("/f", text), ("/g", "t12 only"))
    whole = counts(files, terms)
    for plan in PLANS:
        assert whole == counts(files, terms, plan)
    monkeypatch.setattr(matching, "CHARS_PER_PATTERN", 100)
    assert counts(files, terms, matching._search_layers) == whole
    layers = prefix_free_layers([t.needle for t in vocabulary(terms)])
    assert len(matching._patterns(layers[0])) > 7


def test_one_rule_for_blank_and_equal_terms(spark):
    terms = ["\t", " ", "\u2003", "Zeta", "zeta", "ſun", "Sun", "\x1f", "K", "\u212a"]
    table = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    assert [(t.term_id, t.term) for t in vocabulary(terms)] == sorted(map(tuple, matching.distinct_terms(table).collect()))


def test_the_first_spelling_names_a_term(spark):
    rows = [("zeta", 2, 1), ("ZETA", 1, 3), ("Zeta", 0, 1), ("b", 5, 1)]
    hits = spark.createDataFrame([(t, i, n, "f", "c") for t, i, n in rows], "term string, term_id int, frequency int, file string, context string")
    assert [(r.term, r.total) for r in ranking.term_tiers(hits).collect()] == [("Zeta", 5), ("b", 1)]
    assert sorted(r.term for r in ranking.top_examples(hits).collect()) == ["Zeta", "b"]
    assert ranking.term_tiers(hits.drop("term_id")).first().term == "ZETA"


def test_hit_rows_have_the_full_schema_even_when_empty(files_of):
    spec = ScanSpec(anchor_terms=["absent"])
    hits = hit_rows(files_of(("/a/b/c.md", "text")), spec)
    assert hits.dtypes == [
        ("term", "string"), ("repo", "string"), ("file", "string"), ("ext", "string"),
        ("bucket", "string"), ("frequency", "int"), ("context", "string"),
    ]
    assert hits.count() == 0
    assert hit_rows(files_of(("/a", "text")), ScanSpec()).count() == 0


def test_hits_need_no_shuffle_and_no_python(files_of):
    spec = ScanSpec(anchor_terms=["a", "b"], planned_hints_regex="x|y")
    plan = hit_rows(files_of(("/a/b/c.md", "text")), spec)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Exchange", "Join", "Python", "CartesianProduct"):
        assert operator not in plan


def test_terms_are_plain_records():
    assert vocabulary(["A"]) == [Term(0, "A", "a")]


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_a_vocabulary_table_gives_the_rows_of_a_list(files_of, spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_BROADCAST_BYTES", most)
    texts = ["aaaa AAAA", "Straße ſtraße STRASSE", "naïve café CAFÉ\nİstanbul ısı", "a.b axb a.B", "x" * 50 + "needle" * 3, "", "日本語 日本", "ς σ Σ", "tab\tand\nline"]
    files = files_of(*[(f"/r/p{i % 3}/f{i}.md", t) for i, t in enumerate(texts + texts[:2])])
    terms = ["a", "aa", "AA", "aaa", "a.b", "straße", "café", "ISTANBUL", "needlen", "needleneedle", "日本", "σ", " ", "", "\n", "b a", "missing", "Kelvin", "ısı"]
    spec = ScanSpec(include_paths=["/r/"], anchor_terms=[t for t in terms if t])
    table = spark.createDataFrame([(t,) for t in terms], "term string")

    def rows(frame):
        return sorted((r.term.lower(), *tuple(r)[1:]) for r in frame.collect())

    want = rows(hit_rows(files, spec))
    assert rows(hit_rows(files, spec, table)) == want and len(want) > 15
    assert hit_rows(files, spec, table.limit(0)).count() == 0


@pytest.mark.parametrize("window,cells", [(64, 1 << 22), (64, 0), (1 << 18, 1 << 22)])
def test_layers_count_across_windows(files_of, monkeypatch, window, cells):
    """Terms of all lengths, nested, overlapping themselves and longer than a gram, in texts cut anywhere."""
    monkeypatch.setattr(grams, "WINDOW", window)
    monkeypatch.setattr(grams, "MOST_CELLS", cells)
    terms = ["a", "aa", "aaa", "ana", "anana", "banan", "bananas", "bananasplit", "bananasplitter", "bananasp", "nanananana", "ü", "üü", "日本語", "\0", "\0b", "n\na"]
    texts = ["banana" * 30 + "s", "a" * 201, "bananasplitters bananaspli", "ünï üüü 日本語日本", "", "n\na\0b\0" * 9, "x" * 63 + "bananasplitter", "bananas"]
    files = files_of(*[(f"/f{i}", t) for i, t in enumerate(texts)], ("/null", None))
    want = counts(files, terms, matching._search_each)
    assert counts(files, terms, matching._search_layers) == want and len(want) > 30


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abü", max_size=40), max_size=8), st.sets(st.text("abü", min_size=1, max_size=12), min_size=1, max_size=25))
def test_counts_of_a_batch_are_those_of_python(texts, terms):
    needles = sorted(terms)
    found = grams._counter([n.encode() for n in needles])(pa.array(["skipped", *texts]).slice(1))
    want = [{n: t.count(n) for n in needles if n in t} for t in texts]
    assert [{needles[f["needle"]]: f["n"] for f in row} for row in found.to_pylist()] == want


def test_large_vocabularies_are_not_searched_text_by_term(files_of, spark):
    """Neither a pattern over all places of a text nor a search of the whole text for each term in it."""
    files = files_of(("/f", "text"))
    table = spark.createDataFrame([("text",), ("ex",)], "term string")
    for hits in (hit_rows(files, ScanSpec(), table), hit_rows(files, ScanSpec(anchor_terms=["text", "ex"], search="layers"))):
        plan = ranking.term_tiers(hits)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "regexp_extract_all" not in plan and "replace(folded_text" not in plan
        assert {r.term: r.total for r in ranking.term_tiers(hits).collect()} == {"text": 1, "ex": 1}
