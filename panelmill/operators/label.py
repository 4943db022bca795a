"""Labelling by rules: stateless column expressions, so a labelling pass never shuffles.

Rules map a label to its patterns; the order of the labels is their priority.  Keyword patterns are
pairs (keyword, match type or types), regex patterns are strings.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.constants import LABEL_NAMES, MATCH_TYPES
from panelmill.functions.anchors import constant, edges_of, words_in
from panelmill.functions.patterns import factor, literal_start
from panelmill.functions.text import java_pattern, let, target_name, target_text
from panelmill.operators import term_weight


#: "partially" keywords, or terms, from which one pass over a text (functions.anchors) is cheaper than a search for
#: each; both find the same.
ONE_PASS = {"content": 100, "title": 200, "author": 200, "s_area_id": 200}


#: Rules at the edges of a text, and regular expressions, from which they are looked up and not tried one by one.
MANY_EDGES, MANY_PATTERNS = 50, 50


def one_pass_pays(n_words: int, target: str) -> bool:
    return n_words > ONE_PASS[target_name(target)]


def keywords_by_type(rules: Sequence[tuple], case_sensitive: bool = False) -> dict[str, list[str]]:
    """match type -> keywords of one label; a rule may name several types, also as ``"start,end"``."""
    out: dict[str, list[str]] = {t: [] for t in MATCH_TYPES}
    for keyword, types in rules:
        for t in (types.split(",") if isinstance(types, str) else types):
            if t.strip() not in out:
                raise ValueError(f"unknown match type {t!r}, expected one of {MATCH_TYPES}")
            out[t.strip()].append(keyword if case_sensitive else keyword.lower())
    return out


def _count(text: Column, words: list[str], test) -> Column:
    return F.size(F.filter(F.lit(words), lambda k: test(text, k)))


def keyword_score(text: Column, kws: Mapping[str, Sequence[str]], inside: Column | None = None,
                  edges: Column | None = None) -> Column:
    """One point if any "partially" keyword is found, however many are, and one point for each other
    rule that holds.  ``inside`` says whether one is found, and ``edges`` how many others hold, if that is known already."""
    parts = []
    if inside is not None:
        parts.append(inside.cast("int"))
    elif kws["partially"]:
        parts.append(F.exists(F.lit(kws["partially"]), lambda k: F.contains(text, k)).cast("int"))
    if edges is not None:
        parts.append(edges)
    else:
        if kws["absolutely"]:
            parts.append(_count(text, kws["absolutely"], lambda t, k: t == k))
        if kws["start"]:
            parts.append(_count(text, kws["start"], F.startswith))
        if kws["end"]:
            parts.append(_count(text, kws["end"], F.endswith))
    total = F.lit(0)
    for p in parts:
        total = total + p
    return total


def _edge_hit(text: Column, words: Sequence[str], edge) -> list[Column]:
    """Prefixes or suffixes as set lookups, one per keyword length."""
    by_len: dict[int, list[str]] = {}
    for w in words:
        by_len.setdefault(len(w), []).append(w)
    return [edge(text, F.lit(n)).isin(ws) for n, ws in sorted(by_len.items())]


def keyword_hit(text: Column, kws: Mapping[str, Sequence[str]]) -> Column:
    """Whether any rule of a label holds: the cheap set lookups first, the text scan last."""
    tests = []
    if kws["absolutely"]:
        tests.append(text.isin(kws["absolutely"]))
    tests += _edge_hit(text, kws["start"], F.left) + _edge_hit(text, kws["end"], F.right)
    if kws["partially"]:
        tests.append(F.exists(F.lit(kws["partially"]), lambda k: F.contains(text, k)))
    hit = F.lit(False)
    for t in tests:
        hit = hit | t
    return hit


def pattern_found(text: Column, pattern: str) -> Column:
    """Whether a pattern is found anywhere in the text.  A literal that each of its matches holds is looked for first, as that
    is much faster; a literal at the start of the text is all there is to try."""
    start = literal_start(pattern)
    if start:
        return F.startswith(text, F.lit(start))
    found, need = text.rlike(java_pattern(pattern)), factor(pattern)
    return F.contains(text, F.lit(need)) & found if need else found


def regex_score(text: Column, patterns: Sequence[str]) -> Column:
    """Number of patterns found anywhere in the text."""
    total = F.lit(0)
    for p in patterns:
        total = total + pattern_found(text, p).cast("int")
    return total


def regex_hit(text: Column, patterns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | pattern_found(text, p)
    return hit


def _inside(text: Column, kws: Sequence[Mapping]) -> Column:
    """Numbers of the labels that have a "partially" keyword in the text."""
    entries = [(w, no, 0.0) for no, k in enumerate(kws) for w in dict.fromkeys(k["partially"])]
    return F.array_distinct(F.transform(words_in(text, entries), lambda e: e["no"]))


def _many(kws: Sequence[Mapping], target: str, one_pass: bool | None) -> bool:
    return one_pass_pays(sum(len(k["partially"]) for k in kws), target) if one_pass is None else one_pass


def match_counts(model: str, rules: Mapping, target: str = "content",
                 case_sensitive: bool = False, one_pass: bool | None = None) -> Column:
    """Matched labels of a row with their scores, by priority: array of (label, n).  ``one_pass`` asks for or against
    one pass for all keywords; by default their number decides."""
    def listed(scores):
        scored = F.array(*[F.struct(F.lit(label).alias("label"), n.alias("n")) for label, n in zip(rules, scores)])
        return F.filter(scored, lambda s: s["n"] > 0)

    if model == "rule_model":
        t = target_text(target, False)
        if sum(map(len, rules.values())) <= MANY_PATTERNS if one_pass is None else not one_pass:
            return let(t, lambda t: listed([regex_score(t, ps) for ps in rules.values()]))

        def number(found: Column, no: int) -> Column:
            return F.size(F.filter(found, lambda e: e["no"] == no))

        return let(t, lambda t: let(patterns_found(t, rules), lambda found: listed([number(found, no) for no in range(len(rules))])))
    text = target_text(target, case_sensitive)
    kws = [keywords_by_type(rs, case_sensitive) for rs in rules.values()]
    edge_rules = [(k, w, no) for no, by in enumerate(kws) for k in ("absolutely", "start", "end") for w in by[k]]
    one_pass = _many(kws, target, one_pass)
    lookup = len(edge_rules) > MANY_EDGES

    def scores(t: Column, found: Column | None, held: Column | None) -> Column:
        def inside(no):
            return None if found is None else F.array_contains(found, no)

        def edges(no):
            return None if held is None else F.aggregate(F.filter(held, lambda e: e["no"] == no), F.lit(0), lambda n, e: n + e["n"])

        return listed([keyword_score(t, k, inside(no), edges(no)) for no, k in enumerate(kws)])

    def with_edges(t: Column, found: Column | None) -> Column:
        return let(edges_of(t, edge_rules), lambda held: scores(t, found, held)) if lookup else scores(t, found, None)

    return let(text, lambda t: let(_inside(t, kws), lambda found: with_edges(t, found)) if one_pass else with_edges(t, None))


def patterns_found(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The patterns found in ``text``, as (no, pattern).  A pattern with a literal that each of its matches holds is
    only tried where that literal is; the others are tried on every text."""
    given = [(factor(p), no, java_pattern(p)) for no, ps in enumerate(rules.values()) for p in ps]
    named = words_in(text, [(f, i, 0.0) for i, (f, _, _) in enumerate(given)])
    of = constant([{"no": no, "pattern": p} for _, no, p in given], "array<struct<no:int,pattern:string>>")
    tried = F.transform(named, lambda e: F.get(of, e["no"]))
    return F.filter(tried, lambda e: F.rlike(text, e["pattern"]))


def multi_label(model: str, rules: Mapping, target: str = "content", case_sensitive: bool = False) -> Column:
    return F.transform(match_counts(model, rules, target, case_sensitive), lambda s: s["label"])


def first_label(model: str, rules: Mapping, target: str = "content", case_sensitive: bool = False,
                one_pass: bool | None = None) -> Column:
    """The matching label of highest priority, '' if none; later labels are not even tested."""
    names = list(rules)

    def chain(hits):
        out = None
        for label, hit in zip(names, hits):
            out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
        return F.lit("") if out is None else out.otherwise(F.lit(""))

    if model == "rule_model":
        # Regexes run as generated code when they stay outside a lambda.
        text = target_text(target, False)
        return chain([regex_hit(text, ps) for ps in rules.values()])
    text = target_text(target, case_sensitive)
    kws = [keywords_by_type(rs, case_sensitive) for rs in rules.values()]
    if not _many(kws, target, one_pass):
        return let(text, lambda t: chain([keyword_hit(t, k) for k in kws]))

    def body(t):
        inside = F.array_min(_inside(t, kws))
        rest = [keyword_hit(t, {**k, "partially": []}) for k in kws]
        other = F.coalesce(*[F.when(hit, F.lit(no)) for no, hit in enumerate(rest)])
        return F.coalesce(F.get(F.lit(names), F.least(inside, other)), F.lit(""))

    return let(text, body)


def _with_panel(posts: DataFrame, panel: Column, matched_only: bool) -> DataFrame:
    """Add the label; with ``matched_only`` as an exploded list of none or one.  A filter on the label
    would be pushed below the projection and find the label a second time."""
    if not matched_only:
        return posts.withColumn("panel", panel)
    return posts.select("*", F.explode(F.filter(F.array(panel), lambda p: p != "")).alias("panel"))


def label_posts(posts: DataFrame, model: str, rules, target: str = "content", case_sensitive: bool = False,
                na_label: str | None = None, matched_only: bool = False) -> DataFrame:
    """Add ``panel`` by the model that a job names, '' where nothing matches; ``matched_only`` leaves such
    posts out.

    ``rules`` is a rule mapping, a term dictionary ``label -> [(term, weight)]`` for
    ``term_weight_model``, or a fitted pipeline for ``random_forest_model``.
    """
    if model == "keyword_model":
        return _with_panel(posts, first_label(model, rules, target, case_sensitive), matched_only)
    if model == "rule_model":
        return _with_panel(posts, first_label(model, rules, target, case_sensitive), matched_only)
    if model == "term_weight_model":
        labels = term_weight.labels(rules, target, na_label=na_label)
        return _with_panel(posts, F.coalesce(F.get(labels, F.lit(0)), F.lit("")), matched_only)
    if model == "random_forest_model":
        from panelmill.operators import forest
        out = forest.predict(rules, posts, target).withColumnRenamed("predicted", "panel")
        return labelled_only(out) if matched_only else out
    raise ValueError(f"unknown model type {model!r}")


def labelled_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("panel") != "")


def panel_name(panel: Column) -> Column:
    """Short name of a label (unchanged if it has none) after a slash."""
    known = F.create_map(*[F.lit(x) for kv in LABEL_NAMES.items() for x in kv])
    return F.concat(F.lit("/"), F.coalesce(F.try_element_at(known, panel), panel))


def project_results(df: DataFrame, target: str, task_id: str | Column) -> DataFrame:
    """Result columns of labelled posts: author with its site, site and matched text."""
    return df.select("id", (F.lit(task_id) if isinstance(task_id, str) else task_id).alias("task_id"),
                     F.concat_ws("_", "s_id", "author").alias("source_author"),
                     F.col("post_time").alias("create_time"), "panel",
                     F.col("s_id").alias("field_content"),
                     F.col(target_name(target)).alias("match_content"),
                     *[c for c in ("source", "slice") if c in df.columns])


def route_to_sources(df: DataFrame, source_map: DataFrame, key: str = "s_id") -> DataFrame:
    """Add ``source`` by site id; rows of sites that belong to no source are dropped."""
    dim = source_map.select(F.col("s_id").alias(key), "source")
    return df.join(dim, key)
