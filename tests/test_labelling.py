import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.functions import text
from panelmill.functions.patterns import factor
from panelmill.operators import label as lab
from panelmill.operators import rule_join, term_weight
from panelmill.sources import rules as rule_sources


def posts(spark, *rows):
    """Rows (id, author, content[, s_area_id])."""
    return spark.createDataFrame([(r[0], "WH_F0045", r[3] if len(r) > 3 else "a", r[1], "", r[2], datetime(2024, 1, 1))
                                  for r in rows], schemas.POST)


def counts(df, *args, **kw):
    out = df.select("id", lab.match_counts(*args, **kw).alias("m")).orderBy("id").collect()
    return [[(m["label"], m["n"]) for m in r["m"]] for r in out]


def test_regex_on_every_target(spark):
    df = posts(spark, ("1", "Alice", "我工作快三年了", "board_woman_talk"), ("2", "Bob", "我工作很久了"))
    rules = {"young": ["工作.{0,3}[一二三1-3]年"]}
    assert counts(df, "rule_model", rules) == [[("young", 1)], []]
    assert counts(df, "rule_model", {"female": ["alice"]}, "author_name") == [[("female", 1)], []]
    assert counts(df, "rule_model", {"female": ["board_woman"]}, "s_area_id") == [[("female", 1)], []]


def test_regex_dialect(spark):
    df = posts(spark, ("1", "a", "線上 ١٢ x"))
    assert counts(df, "rule_model", {"digits": [r"\d\d"], "word": [r"^\w+ "], "line": [r"x$", "^x"],
                                     "named": [r"(?P<c>上) (?P<d>\d)"]}) == [
        [("digits", 1), ("word", 1), ("line", 1), ("named", 1)]]
    with pytest.raises(Exception, match="PATTERN"):
        rule_sources.check_patterns(spark, ["(unclosed"])


def test_upper_case_pattern_never_matches_lowered_text(spark):
    df = posts(spark, ("1", "ALICE", "x"))
    assert counts(df, "rule_model", {"female": ["ALICE"]}, "author") == [[]]


def test_keyword_counts(spark):
    df = posts(spark, ("1", "a", "x", "board_woman_talk"))
    rules = {"female": [("woman_talk", "end"), ("_talk", "partially"), ("board", "partially"), ("woman", "partially")]}
    assert counts(df, "keyword_model", rules, "s_area_id") == [[("female", 2)]]
    both = {"female": [("board_woman_talk", "start,end"), ("board_woman_talk", ["absolutely"])]}
    assert counts(df, "keyword_model", both, "s_area_id") == [[("female", 3)]]


def test_case(spark):
    df = posts(spark, ("1", "Alice", "x"))
    rules = {"f": [("ALICE", "absolutely"), ("ali", "start"), ("LIC", "partially"), ("CE", "end")]}
    assert counts(df, "keyword_model", rules, "author") == [[("f", 4)]]
    assert counts(df, "keyword_model", rules, "author", case_sensitive=True) == [[]]
    assert counts(df, "keyword_model", {"f": [("Ali", "start")]}, "author", case_sensitive=True) == [[("f", 1)]]


def test_first_label_follows_rule_order(spark):
    df = posts(spark, ("1", "a", "both here"), ("2", "a", "only two here"), ("3", "a", "none"))
    rules = {"second": [("two", "partially"), ("both", "partially")], "first": [("both", "partially")]}
    got = df.select(lab.first_label("keyword_model", rules).alias("x")).collect()
    assert sorted(r["x"] for r in got) == ["", "second", "second"]


def test_unknown_inputs():
    with pytest.raises(ValueError, match="target"):
        text.target_name("body")
    with pytest.raises(ValueError, match="match type"):
        lab.keywords_by_type([("a", "middle")])


def test_panel_names(spark):
    df = spark.createDataFrame([("男性",), ("other",)], "p string")
    assert [r[0] for r in df.select(lab.panel_name(F.col("p"))).collect()] == ["/male", "/other"]


def test_trim_covers_unicode_blanks(spark):
    df = spark.createDataFrame([("x ",), ("x",), ("x\t",), ("　x\n",), (" x",), ("\x1fx",)], "source_author string")
    assert {r[0] for r in df.select(text.trim_author("source_author")).collect()} == {"x"}
    inner = spark.createDataFrame([(" a b ",)], "source_author string")
    assert inner.select(text.trim_author("source_author")).first()[0] == "a b"


# --- three ways to match rules against brute force ------------------------------------------

def brute(texts, rules, case_sensitive=False):
    out = set()
    for i, t in texts:
        t = t if case_sensitive else t.lower()
        for pos, (label, rs) in enumerate(rules.items()):
            n, inside = 0, False
            for kw, types in rs:
                k = kw if case_sensitive else kw.lower()
                for ty in types.split(","):
                    inside |= ty == "partially" and k in t
                    n += ty == "absolutely" and k == t
                    n += ty == "start" and t.startswith(k)
                    n += ty == "end" and t.endswith(k)
            if n + inside:
                out.add((i, pos, label, n + inside))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_all_ways_agree(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abAB女😀?é"
    word = lambda lo, hi: "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi)))
    texts = [(str(i), word(0, 12)) for i in range(150)]
    types = ["partially", "absolutely", "start", "end", "start,end", "partially,absolutely"]
    rules = {f"l{j}": [(word(1, 5), rnd.choice(types)) for _ in range(12)] for j in range(4)}
    df = posts(spark, *[(i, "a", t) for i, t in texts])
    frame = rule_sources.keyword_rule_frame(spark, rules)
    want = brute(texts, rules)
    rows = lambda d: {(r["id"], r["label_pos"], r["label"], r["n"]) for r in d.collect()}
    assert rows(rule_join.match_by_join(df, frame)) == want
    assert rows(rule_join.match_rules(df, frame)) == want
    for one_pass in (False, True):
        inline = df.select("id", F.explode(lab.match_counts("keyword_model", rules, one_pass=one_pass)).alias("m"))
        assert {(r["id"], r["m"]["label"], r["m"]["n"]) for r in inline.collect()} == {(a, c, d) for a, _, c, d in want}
    first = {i: min((p, label) for j, p, label, _ in want if j == i)[1] for i, *_ in want}
    for one_pass in (False, True):
        got = df.select("id", lab.first_label("keyword_model", rules, one_pass=one_pass).alias("panel")).collect()
        assert {r["id"]: r["panel"] for r in got} == {i: first.get(i, "") for i, _ in texts}
    joined = {r["id"]: r["panel"] for r in rule_join.first_labels(rule_join.match_by_join(df, frame)).collect()}
    assert joined == first


@pytest.mark.parametrize("rules", [
    {"l": [("ab", "start"), ("ab", "end")]}, {"l": [("", "end"), ("", "partially")], "m": [("", "start"), ("", "absolutely")]},
    {"l": [("a", "absolutely")], "m": []}, {"l": [("ab", "start"), ("ab", "start"), ("b", "partially"), ("b", "partially")]},
    {"l": [("ab" * n, t) for n in range(1, 700) for t in ("start", "end")] + [("x" * 1500, "partially")]}])
def test_odd_rules_agree(spark, rules):
    """No "partially" rule, empty and repeated keywords, over a thousand lengths."""
    texts = [("1", ""), ("2", "ab"), ("3", "abab" * 300), ("4", "b" + "x" * 1501), ("5", "a")]
    df = posts(spark, *[(i, "a", t) for i, t in texts])
    frame = rule_sources.keyword_rule_frame(spark, rules)
    want = brute(texts, rules)
    rows = lambda d: {(r["id"], r["label_pos"], r["label"], r["n"]) for r in d.collect()}
    assert rows(rule_join.match_by_join(df, frame)) == want
    for one_pass in (False, True):
        inline = df.select("id", F.explode(lab.match_counts("keyword_model", rules, one_pass=one_pass)).alias("m"))
        assert {(r["id"], r["m"]["label"], r["m"]["n"]) for r in inline.collect()} == {(a, c, d) for a, _, c, d in want}


def test_no_python_in_labelling(spark):
    df = posts(spark, ("1", "a", "x"))
    for n in (5, 3000):
        plan = lab.label_posts(df, "keyword_model", {"l": [(f"k{i}", "partially") for i in range(n)]})._jdf.queryExecution().toString()
        assert "EvalPython" not in plan


# --- term weights ---------------------------------------------------------------------------

TERMS = {"a": [("aa", 1.0), ("ab", 0.2)], "b": [("b", 0.25), ("哈哈", 0.9)]}


def test_term_weights_against_brute_force(spark):
    rnd = random.Random(7)
    texts = [(str(i), "".join(rnd.choice("aab哈 ") for _ in range(rnd.randint(0, 14)))) for i in range(200)]
    df = posts(spark, *[(i, "a", t) for i, t in texts])
    want = {}
    for i, t in texts:
        for label, tw in TERMS.items():
            hits = [(w, t.count(x)) for x, w in tw if t.count(x)]
            if hits:
                want[(i, label)] = sum(w * n for w, n in hits) / sum(n for _, n in hits)
    rows = [(label, t, w) for label, tw in TERMS.items() for t, w in tw]
    table = term_weight.score_with_table(df, spark.createDataFrame(rows, schemas.TERM_DICT))
    assert {(r["id"], r["label"]): round(r["score"], 9) for r in table.collect()} == {k: round(v, 9) for k, v in want.items()}
    got = {r["id"]: r["l"] for r in df.select("id", term_weight.labels(TERMS, na_label="none").alias("l")).collect()}
    assert got == {i: [x for x in TERMS if want.get((i, x), 0) > 0.3] or ["none"] for i, _ in texts}
    one = {r["id"]: r["l"] for r in df.select("id", term_weight.labels(TERMS, na_label="none", one_pass=True).alias("l")).collect()}
    assert one == got


def test_tokens(spark):
    df = spark.createDataFrame([("Hello wörld a b2 x", ), ("我愛你 ok", ), ("", )], "t string")
    got = [r[0] for r in df.select(text.word_tokens(F.col("t"))).collect()]
    assert got == [["hello", "wörld", "b2"], ["我愛", "愛你", "我愛你", "ok"], []]


# --- many rules -----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 49, 50, 51, 4_999, 5_001, 50_000])
def test_any_number_of_rules_gives_the_same_rows(spark, n):
    rnd = random.Random(n)
    word = lambda lo, hi: "".join(rnd.choice("abc女é") for _ in range(rnd.randint(lo, hi)))
    texts = [(str(i), word(0, 30)) for i in range(40)]
    rules = {f"l{j}": [] for j in range(3)}
    for _ in range(n):
        rules[f"l{rnd.randrange(3)}"].append((word(0 if rnd.random() < 0.01 else 3, 12), rnd.choice(["partially", "absolutely", "start", "end"])))
    for i in range(0, 40, 7):
        rules["l1"].append((texts[i][1], "absolutely"))
    df = posts(spark, *[(i, "a", t) for i, t in texts])
    want = brute(texts, rules)
    got = df.select("id", F.explode(lab.match_counts("keyword_model", rules)).alias("m")).collect()
    assert {(r["id"], r["m"]["label"], r["m"]["n"]) for r in got} == {(a, c, d) for a, _, c, d in want}
    if n in (5_001, 50_000):
        rows = lambda d: {(r["id"], r["label_pos"], r["label"], r["n"]) for r in d.collect()}
        frame = rule_sources.keyword_rule_frame(spark, rules)
        assert rows(rule_join.match_rules(df, frame)) == want == rows(rule_join.match_by_join(df, frame))


PATTERNS = ["ab", "a.b", "^ab", "ba$", "(ab|ba)c", "a(bc)?a", "(?i)AB", "[ab]{3}", "a{2,}b", "(?:ca)+b", "(a)\\1c", "c(?=ab)", "女+é", "a|b", "(ab){2}c", "x*", ""]


def test_literals_that_a_pattern_needs():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc女é") for _ in range(rnd.randint(0, 9))) for _ in range(3000)]
    for p in PATTERNS:
        need = factor(p)
        assert all(need in t for t in texts if re.search(p, t)), p
    assert [factor(p) for p in ("ab", "(?:ca)+b", "a(bc)?ade", "a|b", "(?i)ab", "[0-9]{3}", "tion[a-z]{0,3} the")] == ["ab", "ca", "ade", "", "", "", "tion"]


@pytest.mark.parametrize("n", [3, 60, 20_000])
def test_many_patterns_as_one_by_one(spark, n):
    rnd = random.Random(n)
    alphabet = "abcdefgh"
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    rules = {"x": PATTERNS[:n] + [f"{word(5)}[a-z]?{word(2)}" for _ in range(n // 2)], "y": [f"^{word(2)}.*{word(3)}" for _ in range(n // 2)] + ["ab"]}
    texts = [(str(i), word(rnd.randint(0, 60)).title()) for i in range(12 if n > 60 else 60)]
    df = posts(spark, *[(i, "a", t) for i, t in texts])
    want = {(i, label, c) for i, t in texts for label, ps in rules.items() if (c := sum(bool(re.search(p, t.lower())) for p in ps))}
    for one_pass in ((True, False) if n < 100 else (None,)):
        got = df.select("id", F.explode(lab.match_counts("rule_model", rules, one_pass=one_pass)).alias("m")).collect()
        assert {(r["id"], r["m"]["label"], r["m"]["n"]) for r in got} == want
    frame = spark.createDataFrame([(i, label, p) for i, (label, ps) in enumerate(rules.items()) for p in ps], "label_pos int, label string, keyword string")
    rows = rule_join.match_patterns(df, frame).collect()
    assert {(r["id"], r["label"], r["n"]) for r in rows} == want and all(r["label_pos"] == "xy".index(r["label"]) for r in rows)
    if n < 100:
        rows = rule_join.match_patterns_by_join(df, frame).collect()
        assert {(r["id"], r["label"], r["n"]) for r in rows} == want


def test_windows_only_where_a_word_may_begin(spark):
    """Words that begin alike meet a text only by the whole word, and places are those of the text."""
    long = "abcdefghijklmnopqrstuvwxyz" * 2
    words = ["an", "ana", "nab", "😀b", "]^-", long[:16], long[:17], long[:40], "zz"]
    texts = {"1": "banana]^-😀b", "2": long, "3": "", "4": None, "5": "an"}
    posts = spark.createDataFrame(list(texts.items()), "id string, content string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    found = rule_join.find_words(posts, table, "word", "content", places=True)
    want = {(i, w, p) for i, t in texts.items() for w in words for p in range(len(t or "")) if t.startswith(w, p)}
    assert {(r["id"], r["word"], r["place"]) for r in found.collect()} == want
    plain = rule_join.find_words(posts, table, "word", "content")
    assert {(r["id"], r["word"]) for r in plain.collect()} == {(i, w) for i, w, _ in want}
    # A word's anchor is the word itself, so words of one beginning do not meet each other's places.
    anchors = table.select(rule_join._anchor(F.col("word")).alias("a")).collect()
    assert [r["a"] for r in anchors] == ["an", "ana", "nab", "😀b", "]^-", long[:16], long[:16], long[:32], "zz"]
    # Only places where a word may begin give a window.
    assert rule_join._windows(table.where("word in ('ana', 'nab', ']^-')"), "word", [3]) == [(3, r"[\x{5D}\x{61}\x{6E}][\x{5E}\x{61}\x{6E}][\x{2D}\x{61}\x{62}]")]


@pytest.mark.parametrize("pattern", ["^th", "^", "tion[a-z]{0,3} the", "[.]\nthe", "(und|oder) die", "[0-9]{3}", "^a|b", "a$"])
def test_pattern_found_as_the_expression_itself(spark, pattern):
    from panelmill.functions.patterns import literal_start
    from panelmill.functions.text import java_pattern
    texts = ["the", "x the", "", None, "th", "nation the", "nations the", "x.\nthe", "und die", "a\nthe", "oder die 123", "ab", "ba"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(lab.pattern_found(F.col("t"), pattern).alias("a"), F.col("t").rlike(java_pattern(pattern)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    assert literal_start(pattern) == ("th" if pattern == "^th" else "")


def test_term_counts_leave_stop_words_out_of_single_terms(spark):
    """Texts with and without Han characters, upper case, accents, digits, single letters, no word and no text."""
    from panelmill.operators import features
    rows = [("1", "The cat, the ÉTÉ x 7 42"), ("2", "我愛 the 台灣人 cat_1"), ("3", "-- a b"), ("4", None), ("1", "cat")]
    df = spark.createDataFrame(rows, "id string, content string")
    counts = features.term_counts(df, "content", ["the", "愛"])
    assert sorted(tuple(r) for r in counts.collect()) == sorted([
        ("1", "cat", 2), ("1", "été", 1), ("1", "42", 1), ("2", "我愛", 1), ("2", "台灣", 1), ("2", "灣人", 1), ("2", "台灣人", 1), ("2", "cat_1", 1)])
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "the" in line for line in plan.split("\n"))
