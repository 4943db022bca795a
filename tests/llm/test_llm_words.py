"""Spelling variants, Merkle proofs and language-model scores against plain versions, and edge cases."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import attention_lm, html_text, merkle, pii, pivotal_words, queries, rank_language
from test_llm_operators import EDGE, SCHEMA, SF, edge

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
RANKS = queries.tokenizer("byte_bpe_50k.tiktoken")
FORMS = {
    "words": lambda d: pivotal_words.variants(pivotal_words.vocabulary(d, least=1)),
    "proofs": lambda d: merkle.proofs(d, FIELDS, "doc_id", "source"),
    "scores": lambda d: attention_lm.score(d, attention_lm.learn(d.where("doc_id is not null"), RANKS), ["doc_id"]),
    "pages": lambda d: html_text.extract(d, html_text.train(d, html="text"), ["doc_id"], html="text"),
}


@pytest.mark.parametrize("name", FORMS)
def test_edge_rows_and_clashing_columns(spark, name):
    out = FORMS[name](edge(spark)).collect()
    if name == "words":
        assert {r["word"] for r in out} == {"three", "naïve", "nicode"}
    else:
        assert len(out) == len(EDGE)
    if name == "proofs":
        assert all(r["verified"] for r in out)


@pytest.mark.parametrize("name", FORMS)
def test_empty_table(spark, name):
    assert FORMS[name](spark.createDataFrame([], SCHEMA)).count() == 0


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def near_by_hand(words):
    cuts = defaultdict(set)
    for w in words:
        cuts[w].add(w)
        for i in range(len(w)):
            cuts[w[:i] + w[i + 1:]].add(w)
    return {(a, b) for group in cuts.values() for a, b in itertools.combinations(sorted(group), 2) if one_edit(a, b)}


@pytest.mark.parametrize("letters, size", [("ab", 9), ("abcé", 12), ("abcdefghijkl", 24)])
def test_near_words_are_all_found(spark, letters, size):
    rng = np.random.default_rng(size)
    words = {"".join(rng.choice(list(letters), rng.integers(5, size))) for _ in range(250)}
    for w in list(words):
        i = int(rng.integers(0, len(w)))
        c = str(rng.choice(list(letters)))
        words |= {x for x in (w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]) if len(x) >= 5}
    d = spark.createDataFrame([(w, int(rng.integers(3, 99))) for w in sorted(words)], "word string, n long")
    got = pivotal_words.near_words(d).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted(near_by_hand(words))


def test_pivots_are_the_cheapest_disjoint_choice():
    rng = np.random.default_rng(2)
    for _ in range(300):
        places = sorted(rng.choice(12, rng.integers(3, 7), replace=False).tolist())
        cost = rng.integers(1, 9, len(places)).tolist()
        own = dict(zip(places, cost))
        want = min(own[a] + own[b] for a, b in itertools.combinations(places, 2) if b - a >= 2)
        a, b = pivotal_words.pivots(places, cost)
        assert b - a >= 2 and own[a] + own[b] == want


def test_forms_and_roots_by_hand(spark):
    docs = spark.createDataFrame([(1, "planet " * 40 + "plaet " * 9 + "plaett " * 3 + "garden " * 5 + "gardens " * 6 + "Ümlaut " * 3)], "doc_id long, text string")
    got = {r["word"]: r for r in pivotal_words.variants(pivotal_words.vocabulary(docs)).collect()}
    slips = sum(zlib.crc32(f"1:{w}".encode()) % 97 == 0 for w in ("planet", "plaet", "plaett", "garden", "gardens"))
    assert slips == 0 and "Ümlaut" in got
    assert (got["plaett"]["form"], got["plaett"]["root"], got["plaett"]["form_n"]) == ("plaet", "planet", 9)
    assert got["plaet"]["form"] == "planet" and got["plaet"]["n_near"] == 2
    assert got["garden"]["form"] is None and got["garden"]["n_near"] == 1 and got["garden"]["root"] == "garden"


def test_long_chains_of_forms(spark):
    rows = [(f"w{i:03}", f"w{i + 1:03}") for i in range(100)]
    got = dict(pivotal_words.roots(spark.createDataFrame(rows, "word string, form string")).collect())
    assert got == {w: "w100" for w, _ in rows}


def test_slips_follow_the_checksum(spark):
    rows = [(i, "Wörter SAMPLE letters") for i in range(200)]
    want = Counter()
    for i, t in rows:
        for run in t.replace("S", "s").lower().split():
            run = run.replace("Ö", "ö")
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    got = {r["word"]: r["n"] for r in pivotal_words.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 5}


# ---------------------------------------------------------------- Merkle proofs


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_hand(leaves):
    """Root, and the siblings of each leaf."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i in range(len(leaves)):
            run = at[i] // 3 * 3
            paths[i] += [d for j, d in enumerate(level[run:run + 3], run) if j != at[i]]
            at[i] //= 3
        level = [h(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


@pytest.mark.parametrize("n", [1, 3, 4, 243, 244, 900])
def test_proofs_by_hand(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, f"text {i}\nx" if i % 4 else f"text {i}", None if i % 9 == 0 else "en", None if i % 50 == 7 else "hot" if i % 3 else f"s{i % 5}ß", i) for i in range(n)]
    rng.shuffle(rows)
    rows = [(int(a), str(b), None if c is None else str(c), None if s is None else str(s), int(e)) for a, b, c, s, e in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    shown = merkle.leaf(d, FIELDS, text=F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text")))
    got = {r["doc_id"]: r for r in merkle.proofs(d, FIELDS, "doc_id", "source", shown).collect()}
    by = defaultdict(list)
    for r in sorted(rows):
        by[r[3]].append((r[0], h(enc(r[0]), enc(r[3]), enc(r[2]), enc(r[4]), enc(r[1]))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_by_hand([x for _, x in by[s]]) for s in names}
    root, above = tree_by_hand([trees[s][0] for s in names])
    assert len(got) == n
    for k, s in enumerate(names):
        for (i, x), path in zip(by[s], trees[s][1]):
            r, text = got[i], dict((a, b) for a, b, *_ in rows)[i]
            assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (x, trees[s][0], root, h(*path, *above[k]))
            assert r["verified"] == (r["folded_root"] == root) == (i % 2 == 1 or "\n" not in text)


def test_a_forged_row_does_not_verify(spark):
    d = spark.createDataFrame([(i, f"t{i}", "en", "a", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    shown = merkle.leaf(d, FIELDS, n_chars=F.when(F.col("doc_id") == 11, 2).otherwise(F.col("n_chars")))
    assert [r["doc_id"] for r in merkle.proofs(d, FIELDS, "doc_id", "source", shown).where("not verified").collect()] == [11]


# ---------------------------------------------------------------- language model


def test_base_scores_by_hand(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t.translate(lower)).split(" ") if w]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in split(t))
    ends = sum(not x for x in held.values())
    tokens, kinds = sum(c.values()) + ends, len(c) + 1
    for hot in (attention_lm.HOT, 3000):  # 3000: most words come by the join
        monkeypatch.setattr(attention_lm, "HOT", hot)
        for r in queries.op13_attention_lm(spark, SF).collect():
            own = split(texts[r["doc_id"]])
            counts = [c[w] for w in own] + [ends]
            want = sum(math.log10((n + 1) / (tokens + kinds + 1)) for n in counts)
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
                held[r["doc_id"]], len(counts), sum(n > 0 for n in counts), tokens)
            assert math.isclose(r["base_score"], want, rel_tol=1e-9)


def random_parameters(seed=1):
    rng = np.random.default_rng(seed)
    flat = attention_lm.start(rng.pareto(1, attention_lm.HEADS))
    return (flat + rng.normal(0, 0.1, len(flat))).astype(np.float32), rng


def plain_log_probability(p, context):
    """Log probabilities of all classes after ``context``, one place at a time, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    e = p["emb"][context] + p["pos"][:len(context)]
    q, k = np.split(e @ p["qk"], 2, axis=1)
    a = np.exp(k @ q[-1])
    s = (a / a.sum()) @ e @ p["wo"] + e[-1]
    g = s @ p["group"] + p["group_bias"]
    m = np.einsum("i,gim->gm", s, p["member"]) + p["member_bias"]
    norm = lambda z: z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
    return (norm(g)[:, None] + norm(m)).ravel()


def test_each_token_is_scored_once_from_its_window():
    flat, rng = random_parameters()
    p, lead, new = attention_lm.unpack(flat), attention_lm.OVERLAP + 1, attention_lm.NEW
    sizes = np.array([0, 1, new - 1, new, new + 1, 3 * new + 2])
    ids = rng.integers(0, attention_lm.HEADS, sizes.sum())
    seq, longer = attention_lm.framed(ids, sizes, 5)
    got = attention_lm.score_ids(p, seq, np.zeros(len(seq)), longer, chunk=2)
    at = 0
    for n, total in zip(longer, got):
        own, want = seq[at:at + n], 0.0
        at += n
        for i in range(lead, n):
            begin = (i - lead) // new * new
            want += plain_log_probability(p, own[begin:i])[own[i]]
        assert math.isclose(total, want, rel_tol=1e-4, abs_tol=1e-3)


def test_probabilities_sum_to_one():
    flat, rng = random_parameters(3)
    assert math.isclose(np.exp(plain_log_probability(attention_lm.unpack(flat), rng.integers(0, 99, 7))).sum(), 1, rel_tol=1e-9)


def test_each_id_is_learned_once():
    """The targets of a text's windows are its ids in order and its end, whatever its length; each behind what came before."""
    encode, lead = attention_lm.Subwords(RANKS), attention_lm.OVERLAP + 1
    for n in (0, 1, 3, 15, 16, 17, 400):
        words = [b"word%d" % i for i in range(n)]
        ids = [*encode.encode(words)[0].tolist(), encode.end]
        windows = attention_lm.windows_of(words, encode, 7)
        assert [i for w in windows for i in w[lead:].tolist() if i != attention_lm.NONE] == ids
        held = [encode.end] * lead + ids
        for k, w in enumerate(windows):
            at = k * attention_lm.NEW
            assert w[:lead].tolist() == held[at:at + lead]


def test_gradient_by_differences():
    flat, rng = random_parameters(2)
    x = rng.integers(0, attention_lm.HEADS, (3, attention_lm.WINDOW + 1))
    x[2, 9:] = -1
    y, use = np.maximum(x[:, 1:], 0), x[:, 1:] >= 0
    g = attention_lm.gradient(attention_lm.unpack(flat), np.maximum(x[:, :-1], 0), y, use)

    def loss(f):
        p = {k: v.astype(float) for k, v in attention_lm.unpack(f.astype(np.float64)).items()}
        s = attention_lm.hidden(p, np.maximum(x[:, :-1], 0))[-1]
        lead = attention_lm.OVERLAP
        return -(attention_lm.log_probabilities(p, s, y[:, lead:].ravel()) * use[:, lead:].ravel()).sum() / use[:, lead:].sum()

    for i in rng.choice(np.flatnonzero(np.abs(g) > 1e-4), 40, replace=False):
        up, down = flat.astype(np.float64), flat.astype(np.float64)
        up[i] += 1e-2
        down[i] -= 1e-2
        assert math.isclose((loss(up) - loss(down)) / 2e-2, g[i], rel_tol=0.08, abs_tol=2e-4)


def test_learning_helps_on_held_out_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    learned = docs.where("not held")
    score = {}
    for rounds in (0, 4):
        corpus = attention_lm.learn(learned, RANKS, rounds=rounds, every=2)
        score[rounds] = attention_lm.score(docs.where("held"), corpus, ["doc_id"]).agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert score[4] > score[0] + 0.3


# ---------------------------------------------------------------- pages, numbers, letters

ARTICLE = " ".join(f"w{i}" for i in range(80))


@pytest.mark.parametrize("learned", [False, True])
@pytest.mark.parametrize("page", [
    '<body class="no-sidebar"><p>{}</p></body>', '<body class="page with-comments"><p>{}</p></body>', '<body class="a cookies-not-set"><p>{}</p></body>',
    '<article class="ad-free"><p>{}</p></article>', '<main class="login-free"><p>{}</p></main>', '<div class="reader-view"><p>{}</p></div>',
    '<div class="widget"><article><p>{}</p></article></div>', '<body class="menu"><div class="comments">x y z</div><p>{}</p></body>'])
def test_names_of_frames_do_not_drop_an_article(spark, page, learned):
    model = html_text.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), pick=F.xxhash64("page_id")) if learned else {}
    assert html_text.Extractor(model).text(f"<html>{page.format(ARTICLE)}<footer>all rights</footer></html>") == ARTICLE


@pytest.mark.parametrize("unit", ["a <b ", "a <!x ", "<script ", "<a ' ", '<a "', "<b><div>x</div>", "<div>", "</i><b>"])
def test_broken_markup_takes_linear_time(unit):
    import time
    at = time.process_time()
    html_text.Extractor({}).text(unit * (400_000 // len(unit)))
    assert time.process_time() - at < 10


def test_region_is_the_best_run_of_tokens():
    rng = np.random.default_rng(6)
    x = html_text.Extractor({})
    for _ in range(60):
        page = "".join(rng.choice(["<p>", "</p>", "<i>", "word ", "two words ", "<div>", "</div>", "<hr>"], 40))
        scores = [len(v.split()) if k == "text" else -0.2 for k, v, _ in html_text.Parsed(page).tokens]
        best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
        got = sum(len(v.split()) if k == "text" else -0.2 for k, v, _ in x.region(page))
        assert math.isclose(got, best, abs_tol=1e-6)


@pytest.mark.parametrize("text, n", [("0" * 5000 + ".1.1.1", 1), ("9" * 5000 + ".1.1.1", 0), ("1.1.1." + "0" * 9000 + "7", 1), ("4" * 100_000, 0)])
def test_digit_runs_of_any_length(text, n):
    assert len(pii.find(text)["ip"]) == n and not pii.find(text)["card"]


def test_letters_are_those_of_unicode():
    p = rank_language.Profiles({"de": rank_language.ranked(*rank_language.grams("eine große übung")).tolist()}, 400)
    for t in ("½²", "²", "Ⅷ", "́", "12 ³"):
        assert p.guess(t) == ("und", 0.0)
    joined, split = rank_language.grams("été")[0], rank_language.grams("e te")[0]
    assert len(joined) > len(split) and p.guess("übung ½")[0] == "de"


def out_of_place(text, profiles, top):
    """Plain out-of-place distance with letters from the standard library."""
    import unicodedata
    s = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    words = s.split()
    c = Counter()
    t = f" {' '.join(words)} "
    for n in (1, 2, 3):
        for i in range(len(t) - n + 1):
            g = t[i:i + n]
            if g != " " and " " not in g[1:-1]:
                c[g] += 1
    own = sorted(c, key=lambda g: (-c[g], len(g), g))[:top]
    return own, c


def test_distance_by_hand(spark):
    texts = {"en": "the cat sat on the mat and the dog lay there", "de": "die katze saß auf der matte und der hund lag da", "fr": "le chat était sur le tapis et le chien là"}
    top = 30
    model = {k: rank_language.ranked(*rank_language.grams(t), top).tolist() for k, t in texts.items()}

    def key(g):
        k = 0
        for ch in g:
            k = (k << 21) | ord(ch)
        return k

    def profile(t):
        c = out_of_place(t, None, top)[1]
        return sorted((key(g) for g in c), key=lambda k: (-{key(g): n for g, n in c.items()}[k], k))[:top]

    plain = {k: profile(t) for k, t in texts.items()}
    assert plain == model
    p = rank_language.Profiles(model, top)
    for t in ("the hund was there", "le katze", "der the le", "aa bb", "xyz"):
        own = profile(t)
        far = {k: sum(min(abs(ranks.index(g) - i), top) if g in ranks else top for i, g in enumerate(own)) for k, ranks in plain.items()}
        want = min(sorted(far), key=far.get)
        assert p.guess(t) == (want, 1 - far[want] / (len(own) * top))
