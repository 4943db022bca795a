from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill import schemas
from panelmill.functions import slices
from panelmill.operators import clean, metrics

T0 = datetime(2024, 1, 1)
KEYS = ["task_id", "source"]
LABELS = ["/female", "/male", "/young"]


def results(spark, rows):
    """Rows (author, panel, time offset in hours[, id])."""
    data = [(r[3] if len(r) > 3 else f"{i:04d}", "t", r[0], r[1], T0 + timedelta(hours=r[2]), "s", "m")
            for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schemas.RESULT).withColumn("source", F.lit("src"))


def repeat(author, **n):
    return [(author, f"/{p}", i / 10) for p, k in n.items() for i in range(k)]


CASES = [
    (dict(male=3), "/male", "/male"), (dict(male=3, female=1), "/male", "/male"),
    (dict(male=2, female=2), None, "/male"), (dict(young=3, male=2, female=1), "/young", "/young"),
    (dict(young=2, male=2, female=1), None, "/young"),
]


@pytest.mark.parametrize("n, drop, first", CASES)
def test_vote(spark, n, drop, first):
    df = results(spark, repeat("a", **n))
    for tie, want in (("drop", drop), ("first_dropped", first)):
        got = [r["panel"] for r in clean.run_cleaning(df, ["source"], tie).collect()]
        assert got == ([want] if want else [])


def test_latest_row_and_blanks(spark):
    df = results(spark, [("x ", "/male", 1, "b"), ("x", "/male", 2, "c"), ("x\t", "/male", 2, "d"), ("　x", "/male", 0, "z")])
    row, = clean.run_cleaning(df, ["source"]).collect()
    assert (row["source_author"], row["id"]) == ("x", "d")
    row, = clean.latest_per_panel(clean.trimmed(df), ["source"]).collect()
    assert row["id"] == "d"


def test_slices_beat_posts(spark):
    rows = [("a", "/male", 0.1 * i) for i in range(5)] + [("a", "/female", 7), ("a", "/female", 13)]
    got = clean.two_stage_vote(results(spark, rows), T0).collect()
    assert [r["panel"] for r in got] == ["/female"]
    plain = clean.run_cleaning(results(spark, rows), ["source"]).collect()
    assert [r["panel"] for r in plain] == ["/male"]


def test_one_slice_is_the_plain_vote(spark):
    df = results(spark, repeat("a", male=2, female=1) + repeat("b", male=1, female=1) + repeat("c", young=1))
    key = lambda d: sorted((r["source_author"], r["panel"], r["id"]) for r in d.collect())
    assert key(clean.two_stage_vote(df, T0)) == key(clean.run_cleaning(df, ["source"]))


def test_hot_author_against_brute_force(spark):
    """A third of all rows belong to one author; the result has at most one panel per author."""
    import random
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.34 else f"u{rnd.randint(0, 40)}", rnd.choice(LABELS), rnd.uniform(0, 60))
            for _ in range(3000)]
    votes = Counter()
    per = Counter((a, int(h // 6), p) for a, p, h in rows)
    for a, s in {(a, s) for a, s, _ in per}:
        c = {p: per[(a, s, p)] for p in LABELS if per[(a, s, p)]}
        top = [p for p, n in c.items() if n == max(c.values())]
        if len(top) == 1:
            votes[(a, top[0])] += 1
    want = set()
    for a in {a for a, _ in votes}:
        c = {p: votes[(a, p)] for p in LABELS if votes[(a, p)]}
        top = [p for p, n in c.items() if n == max(c.values())]
        if len(top) == 1:
            want.add((a, top[0]))
    got = clean.two_stage_vote(results(spark, rows), T0).collect()
    assert {(r["source_author"], r["panel"]) for r in got} == want
    assert len(got) == len({r["source_author"] for r in got})
    slim = results(spark, rows).withColumn("slice", slices.slice_index("create_time", T0))
    panels = metrics.author_panels(slim, LABELS).where("panel is not null").collect()
    assert {(r["source_author"], r["panel"]) for r in panels} == want


@pytest.mark.parametrize("vote", [lambda df: clean.run_cleaning(df, ["source"]), lambda df: clean.two_stage_vote(df, T0)])
def test_votes_leave_texts_behind(spark, vote):
    """Texts take no part in a vote: a query that does not use them does not read them."""
    won = vote(results(spark, repeat("a", male=2, female=1)))
    plan = won.select("source_author", "panel")._jdf.queryExecution().optimizedPlan().toString()
    assert "match_content" not in plan
    assert [r["match_content"] for r in won.collect()] == ["m"]


def test_texts_of_rows_that_repeat_and_of_nulls(spark):
    rows = [("1", "t", "a", "/male", T0, "s", "x"), ("1", "t", "a", "/male", T0, "s", "y"), ("1", "t", "a", "/male", T0, "s", None),
            (None, "t", "b", "/male", T0, None, "z"), (None, "t", "b", "/male", T0, None, "z"), ("3", None, "c", "/male", None, "s", None)]
    for source in ("src", None):
        df = spark.createDataFrame(rows, schemas.RESULT).withColumn("source", F.lit(source))
        for got in (clean.run_cleaning(df, ["source"]), clean.two_stage_vote(df, T0)):
            assert {(r["id"], r["source_author"], r["source"], r["match_content"]) for r in got.collect()} == {
                ("1", "a", source, "y"), (None, "b", source, "z"), ("3", "c", source, None)} and got.count() == 3


def test_cleaning_counts_before_it_shuffles(spark):
    df = results(spark, repeat("a", male=1))
    plan = clean.run_cleaning(df, ["source"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2


@pytest.mark.parametrize("n", [1, 32, 33, 200])
def test_any_number_of_panels_votes_alike(spark, n):
    """Also panels that no rule names."""
    import random
    rnd = random.Random(n)
    names = [f"/p{i}" for i in range(n)] + ["/unknown", "/x"]
    rows = [(f"u{rnd.randint(0, 60)}", rnd.choice(names), rnd.uniform(0, 60)) for _ in range(1500)]
    rows += [("one", "/x", 1), ("one", "/x", 2), ("one", "/p0", 3)]
    per = Counter((a, p) for a, p, _ in rows)
    want = set()
    for a in {a for a, _ in per}:
        c = {p: m for (b, p), m in per.items() if b == a}
        top = [p for p, m in c.items() if m == max(c.values())]
        if len(top) == 1:
            want.add((a, top[0]))
    got = {(r["source_author"], r["panel"]) for r in clean.run_cleaning(results(spark, rows), ["source"]).collect()}
    assert got == want and ("one", "/x") in got


# --- slices ---------------------------------------------------------------------------------
def test_placed_rows_are_written_as_they_lie(spark, tmp_path, monkeypatch):
    """Rows with the parts of their table are those without, a small part of them is in one place (a larger one in cells),
    and the write shuffles them no more."""
    from panelmill.sources import tables
    rows = results(spark, [(f"a{i % 97}", "/male" if i % 3 else "/female", i / 7, None if i % 11 == 0 else f"{i // 2:04d}") for i in range(600)])
    rows = rows.withColumn("source", F.concat(F.lit("s"), F.length("source_author"))).withColumn("match_content", F.when(F.col("id") > "0040", F.col("id")))
    rows = rows.unionAll(rows.where("id < '0100'"))
    for cell, places in ((1000, 1), (5, 2)):
        monkeypatch.setattr(clean, "CELL", cell)
        for vote in (clean.two_stage_vote, clean.slice_votes):
            plain = vote(rows, T0, KEYS)
            placed = vote(rows, T0, KEYS, parts=tables.PARTS)
            assert Counter(placed.collect()) == Counter(plain.collect())
            seen = placed.select("source", F.spark_partition_id().alias("at")).distinct().groupBy("source").count().collect()
            assert len(seen) == 2 and (places > 1 or all(r["count"] == 1 for r in seen))
    path = str(tmp_path / "rows")
    tables.write_results(placed.drop("slice"), path, placed=True)
    assert Counter(tables.read_results(spark, path).select(*KEYS, "id", "panel").collect()) == Counter(placed.select(*KEYS, "id", "panel").collect())
    hints = []
    monkeypatch.setattr(type(placed), "hint", lambda df, *a: hints.append(a) or df)
    tables.write_results(placed.drop("slice"), path, placed=True)
    tables.write_task(placed.drop("slice"), path, "t", placed=True)
    assert not hints


def test_written_rows_are_found_where_they_lie(spark, monkeypatch):
    """With a part's rows in large numbers, texts are not shuffled for the write, and the rows are those of the shuffle:
    also those that pass a bit table by chance, that repeat, and that have nulls."""
    from panelmill.sources import tables
    rows = results(spark, [(f"a{i % 1500}", "/male" if i % 7 else "/female", i / 40, None if i % 11 == 0 else f"{i:05d}") for i in range(9000)])
    rows = rows.withColumn("source", F.lit("s")).withColumn("match_content", F.when(F.col("id") > "00040", F.concat("id", F.lit("x"))))
    again = rows.unionAll(rows.where("id > '08000'")).unionAll(rows.where("id > '08500'").withColumn("match_content", F.lit("z")))
    for cell, shuffled in ((10**6, True), (10, False)):
        monkeypatch.setattr(clean, "CELL", cell)
        for df in (rows, again):
            votes = clean.two_stage_vote(df, T0, KEYS, parts=tables.PARTS), clean.run_cleaning(df, KEYS, few=True, parts=tables.PARTS)
            for got, want in zip(votes, (clean.two_stage_vote(df, T0, KEYS), clean.run_cleaning(df, KEYS, few=True))):
                assert Counter(got.collect()) == Counter(want.collect()) and got.count() > 1000
            if df is rows:
                plan = votes[0]._jdf.queryExecution().optimizedPlan().toString()
                assert ("Repartition" in plan) == shuffled


def test_last_production_leaves_texts_where_they_lie(spark, monkeypatch):
    from panelmill.plans import dump
    rows = results(spark, [(f"a{i % 900}", "/male" if i % 3 else "/female", i / 40, f"{i:05d}") for i in range(3000)])
    rows = rows.withColumn("source", F.lit("s")).withColumn("match_content", F.col("id"))
    groups = spark.createDataFrame([("s", "g")], schemas.PRODUCTION_GROUP)
    seen = []
    for cell in (10**6, 10):
        monkeypatch.setattr(clean, "CELL", cell)
        got = dump.last_production(rows, groups)
        assert ("Repartition" in got._jdf.queryExecution().optimizedPlan().toString()) == (cell > 10)
        seen.append(Counter(got.collect()))
    assert seen[0] == seen[1] and sum(seen[0].values()) == 900


def sliced(spark, f, hours, at):
    df = spark.createDataFrame([(T0 + timedelta(hours=h),) for h in at], "post_time timestamp_ntz")
    out = f(df, T0, T0 + timedelta(hours=hours))
    return sorted(((r["post_time"] - T0).total_seconds() / 3600, r["slice"]) for r in out.collect())


def test_slices(spark):
    at = [0, 5.9, 6, 12, 12.5, 13]
    assert sliced(spark, slices.with_slices, 13, at) == [(0, 0), (5.9, 0), (6, 1), (12, 2), (12.5, 2)]
    assert sliced(spark, slices.with_slices_compat, 13, at) == [(0, 0), (5.9, 0), (6, 0), (6, 1), (12, 1)]
    assert slices.slice_count(T0, T0 + timedelta(hours=13)) == 3
    assert slices.slice_count(T0, T0 + timedelta(hours=13), tail=False) == 2


def test_slices_agree_off_the_boundary(spark):
    at = [0.5, 3, 7.25, 11.9]
    assert sliced(spark, slices.with_slices, 12, at) == sliced(spark, slices.with_slices_compat, 12, at)


def test_slice_predicates_cover_the_range():
    from panelmill.sources.posts import slice_predicates
    p = slice_predicates(T0, T0 + timedelta(hours=13))
    assert len(p) == 3 and p[0].startswith("post_time >= '2024-01-01 00:00:00' AND post_time < '2024-01-01 06:00:00'")
    assert p[-1].endswith("post_time < '2024-01-01 13:00:00'")


def test_slices_ignore_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        start = datetime(2024, 3, 30)
        df = spark.createDataFrame([(start + timedelta(hours=h),) for h in (26, 30)], "post_time timestamp_ntz")
        got = [r["slice"] for r in slices.with_slices(df, start, start + timedelta(days=3)).collect()]
        assert got == [4, 5]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize("rows, authors, want", [(236705, 1672893, 14.15), (10725, 50216, 21.36), (109614, 228206, 48.03)])
def test_rate(spark, rows, authors, want):
    assert spark.range(1).select(metrics.rate(F.lit(rows), F.lit(authors))).first()[0] == want
