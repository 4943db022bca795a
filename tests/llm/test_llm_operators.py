"""Each operator against a brute-force version, on the small tables and on hand-made rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import (chosen_path, components, fingerprint, fuzzy_lines, html_text, mixing, packing, pii, quality, queries,
                           rank_language, token_count)
from panelmill.session import materialize

SF = "/root/testdata/sf0.001"
EDGE = [(1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (None, "", "en", "a", 0),
        (3, "one two three four five six", "de", "b", 7), (3, "one two three four five six", "de", "b", 7), (4, " \n\t ", "en", None, 3),
        (5, "x", "en", "c", 1), (6, "naïve café — \U0001d518nicode 漢字 ' \n\n b", "fr", "c", 9), (7, "word " * 3000, "en", "a", 2)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["k", "t", "u", "size", "sig", "grams", "target", "_k", "_t", "row", "edge", "r", "x", "n_lines", "pii"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def edge(spark):
    d = spark.createDataFrame(EDGE, SCHEMA)
    return d.select("*", *[F.lit("clash").alias(c) for c in CLASH])


BPE = queries.tokenizer("byte_bpe_50k.json")
PIECES = queries.tokenizer("piece_bpe_32k.model")
FORMS = {
    "pii": lambda d: pii.digest(pii.find_pii(d)),
    "ledger": lambda d: quality.ledger(d, ["doc_id"]),
    "fingerprints": fingerprint.fingerprints,
    "pack": lambda d: packing.pack(d, BPE),
    "mix": lambda d: mixing.mix(d, ["doc_id"]),
    "mixed": mixing.mixed_documents,
    "lines": fuzzy_lines.dedup_lines,
    "count": lambda d: token_count.count_tokens(d, PIECES),
    "language": lambda d: rank_language.identify(d, rank_language.train(d), ["doc_id"]),
    "classes": chosen_path.jaccard_classes,
    "one": chosen_path.one_of_each,
}


@pytest.mark.parametrize("name", FORMS)
def test_edge_rows_and_clashing_columns(spark, name):
    out = FORMS[name](edge(spark)).collect()
    if name == "mixed":
        assert all(r["text"] and r["text"].strip() for r in out)
    elif name == "one":
        assert sorted(r["doc_id"] or 0 for r in out) == [0, 1, 2, 4, 5, 6, 7]
    elif name != "pack":
        assert len(out) == len(EDGE)


@pytest.mark.parametrize("name", FORMS)
def test_empty_table(spark, name):
    assert FORMS[name](spark.createDataFrame([], SCHEMA)).count() == 0


# ---------------------------------------------------------------- 1


def base_spans(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 13 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_plain_personal_data_is_that_of_the_patterns(spark, docs, texts):
    for r in pii.digest(pii.find_pii(docs)).collect():
        want = base_spans(texts[r["doc_id"]]["text"] or "")
        n = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [n[k] for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_plain_spans_on_random_text():
    rng = np.random.default_rng(5)
    parts = list("0123456789.@+-() ab_%é") + ["1.2.3.4", "256.1.1.1", "@a.b", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    for _ in range(3000):
        t = "".join(rng.choice(parts, rng.integers(1, 25)))
        assert [(k, a, b) for k, v in pii.find(t).items() for a, b in v] == base_spans(t), t


@pytest.mark.parametrize("text, kind, value", [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("jane dot roe at example dot co dot uk", "email", "jane dot roe at example dot co dot uk"),
    ("аdmin@exаmple.com!", "email", "аdmin@exаmple.com"),
    ("x ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("call plus four four two zero seven nine four six zero nine five eight.", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("ip 192 dot 168 [.] 0 dot 1", "ip", "192 dot 168 [.] 0 dot 1"),
    ("4111​1111 1111 1111", "card", "4111​1111 1111 1111")])
def test_disguises_map_back_to_the_source(text, kind, value):
    assert (kind, value, True) in [(k, text[a:b], d) for k, a, b, d in pii.spans(text)]


@pytest.mark.parametrize("text, kind, value", [
    ("call +49 one seven 123 four five 67 89 now", "phone", "+49 one seven 123 four five 67 89"),
    ("card 4111 1111 1111 11 one one now", "card", "4111 1111 1111 11 one one"),
    ("card 4111 one 111 1111 1111 now", "card", "4111 one 111 1111 1111"),
    ("plus four four two zero\nseven nine four six zero nine five eight.", "phone", "plus four four two zero\nseven nine four six zero nine five eight"),
    ("card 4111 1111 one one\r\n11 1111 now", "card", "4111 1111 one one\r\n11 1111")])
def test_numerals_and_digit_words_in_one_run(text, kind, value):
    assert (kind, value, True) in [(k, text[a:b], d) for k, a, b, d in pii.spans(text)]


def test_digit_words_beside_plain_spans_and_prose():
    assert pii.spans("ip 192.168.0.1 two of 3 one\n\ntwo") == [("ip", 3, 14, False)]


@pytest.mark.parametrize("text", ["look at example.com for more", "one two three go", "we met at noon. dot matters", "un dos tres"])
def test_no_disguise_in_plain_prose(text):
    assert not pii.spans(text)


# ---------------------------------------------------------------- 2


def test_ledger_by_hand_and_ablation(spark):
    good = " ".join("w" + "abcdefghij"[i // 10] + "klmnopqrst"[i % 10] for i in range(60))
    rows = [(1, good), (2, "a b c " * 30), (3, good + "#" * 30), (4, "short")]
    entries = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"])
    got = {r["doc_id"]: r["rule_bits"] for r in entries.collect()}
    assert got == {1: 0, 2: 2 | 16, 3: 4, 4: 1}
    cut = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in quality.ablation(entries).collect()}
    assert cut["symbols"] == (1, 1, 2) and cut["repeated_words"] == (1, 0, 1) and cut["too_few_words"] == (1, 1, 2)
    assert {r["doc_id"] for r in entries.where(quality.passes("v1")).collect()} == {1, 3}


# ---------------------------------------------------------------- 3


def test_prefix_hashes_answer_equality_and_extension():
    rng = np.random.default_rng(1)
    a = "".join(rng.choice(list("abc"), 400))
    b = a[100:300] + "".join(rng.choice(list("abc"), 100))
    p, q = fingerprint.Prefixes(a), fingerprint.Prefixes(b)
    for i, j, n in rng.integers(0, 90, (300, 3)).tolist():
        assert (p.span(i + 100, i + 100 + n) == q.span(j, j + n)) == (a[i + 100:i + 100 + n] == b[j:j + n])
        want = 0
        while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
            want += 1
        assert p.extension(i, q, j) == want


def test_fingerprints_of_neighbours(spark, docs, texts):
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert sorted(got) == ids
    for i, d in enumerate(ids):
        t, n = texts[d]["text"] or "", texts[ids[(i + 1) % len(ids)]]["text"] or ""
        new = fingerprint.edited(t, n)
        k = len(t) // 4
        assert new == (t[:-k] + n[:k] if k else t)
        assert got[d]["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        assert got[d]["fingerprint"] == fingerprint.fingerprint(fingerprint.Prefixes(t))
        assert (t == n) <= (got[d]["near_next"] == 1)
    whole = [r["near_edited"] for r in got.values() if r["n_chars"] > 400]
    assert np.mean(whole) > 0.65 and np.mean([r["near_next"] for r in got.values()]) < 0.05


def test_neighbours_over_many_ranges(spark):
    d = spark.createDataFrame([(i * 3, f"text {i} " * 5) for i in range(500)], "doc_id long, text string").repartition(7)
    rows = fingerprint.with_neighbours(d, "doc_id", "text", rows_per_range=20)
    assert rows.where("edge").count() > 10 and rows.where("not edge").count() == 500


# ---------------------------------------------------------------- 4


def test_packing_is_a_gapless_partition_with_little_padding(spark, docs, texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d, row in texts.items():
        got = b"".join(p["ids"] for p in sorted(by_doc[d], key=lambda p: p["start"]))
        want = [*t.encode(row["text"] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(got, "<u4").tolist() == want and {p["doc_tokens"] for p in by_doc[d]} == {len(want)}
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert len(by_seq) * 1024 < 1.02 * sum(r["length"] for r in rows) + 1024 * 8


def test_token_ids_are_the_library_s():
    from tokenizers import Tokenizer
    t, e, rng = Tokenizer.from_file(BPE), packing.encoder(BPE), np.random.default_rng(2)
    parts = [chr(c) for c in range(0x250)] + ["<|endoftext|>", "  ", "\n", "the", "'s", "漢", "12", " "]
    for _ in range(3000):
        s = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert e(s).tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)


def test_best_fit_takes_the_tightest_window():
    lengths = [700, 600, 424, 324, 100, 1024]
    assert sorted(map(sorted, packing.best_fit(lengths))) == [[0, 3], [1, 2], [4], [5]]


def test_small_buffer_packs_all(spark, docs):
    a = packing.pack(docs, BPE, buffer=4096).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    b = packing.pack(docs, BPE).agg(F.sum("length"), F.count_distinct("sequence_id")).first()
    assert a[0] == b[0] and a[1] < 1.1 * b[1] + 8


# ---------------------------------------------------------------- 5


def targets(sizes, most=3):
    """Water filling by bisection."""
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    low, high = 0.0, float(most * sum(sizes.values()) + 1)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w[s] * mid, most * sizes[s]) for s in sizes) < sum(sizes.values()) else (low, mid)
    return {s: min(w[s] * high, most * sizes[s]) for s in sizes}


def check_mix(rows):
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] in [k * r["size"] for k in range(4)]
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    assert sum(taken.values()) <= sum(sizes.values())


def test_mix_meets_its_targets(spark, docs):
    rows = mixing.mix(docs, ["doc_id"]).collect()
    check_mix(rows)
    again = mixing.mix(docs.repartition(5), ["doc_id"]).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}


def test_mix_of_uneven_sources(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(1, 30)), None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(2000)]
    check_mix(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id"]).collect())


def test_mixed_documents_repeat_as_taken(spark, docs):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs.withColumn("_key", F.col("doc_id")).withColumn("_text", F.xxhash64("text"))
             .withColumn("_source", F.col("source")), ["doc_id"]).collect()}
    out = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert abs(sum(out.values()) - sum(taken.values())) < 0.1 * len(taken)


# ---------------------------------------------------------------- 6


def normal_lines(rows):
    for i, x in rows:
        for p, line in enumerate((x or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                yield i, p, re.sub(r"[ \t-\r]+", " ", line.lower()).strip(" ")


def lines_by_hand(rows, links):
    """Texts without later lines of the groups that ``links`` between normal lines make."""
    occ = list(normal_lines(rows))
    up = {n: n for _, _, n in occ}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    seen, gone = set(), defaultdict(set)
    for i, p, n in occ:
        g = top(n)
        if g in seen:
            gone[i].add(p)
        seen.add(g)
    return {i: None if x is None else "\n".join(y for p, y in enumerate(x.split("\n")) if p not in gone[i]) for i, x in rows}


def distance(a, b):
    prev = np.arange(len(b) + 1)
    other = np.array(list(b))
    for i, x in enumerate(a, 1):
        cur = np.minimum(prev[1:] + 1, prev[:-1] + (other != x)) if len(b) else prev[1:]
        prev = np.minimum.accumulate(np.concatenate([[i], cur]) - np.arange(len(b) + 1)) + np.arange(len(b) + 1)
    return int(prev[-1])


def near_enough(a, b, similarity=0.8):
    most = int(max(len(a), len(b)) * (1 - similarity) + 1e-9)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def test_links_are_similar_and_decide_the_result(spark, docs, texts):
    rows = [(i, texts[i]["text"]) for i in sorted(texts)]
    base = "the quick brown fox jumps over the lazy dog near the old stone bridge and runs home again before it is dark"
    rows += [(10_000 + i, base.replace("stone", f"st{i}ne") + f"\nown line number {i} " + "x" * i) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lines = fuzzy_lines._lines(d, "doc_id", "text").cache()
    name = {r["h"]: r["norm"] for r in lines.select(*fuzzy_lines._hashes(), "norm").collect()}
    links = [(name[r["a"]], name[r["b"]]) for r in fuzzy_lines.line_links(d, fuzzy_lines.simhashed(lines), "doc_id", "text").collect()]
    assert all(near_enough(a, b) for a, b in links)
    got = {r["doc_id"]: r["text"] for r in fuzzy_lines.dedup_lines(d).collect()}
    assert got == lines_by_hand(rows, links)
    assert sum(got[10_000 + i].startswith("the quick") for i in range(12)) == 1


#: (words, of them changed): at most a fifth.
CHANGED = [(12, 1), (12, 2), (27, 1), (27, 3), (27, 5), (60, 3), (60, 12), (98, 5), (98, 19), (200, 10), (200, 40)]


def test_recall_against_edit_similarity_alone(spark, texts):
    """Pairs of random words with some changed, judged by edit similarity and nothing else."""
    rng = np.random.default_rng(4)
    words = [w for r in texts.values() for w in (r["text"] or "").lower().split()]
    pairs = []
    for n, c in CHANGED:
        found = 0
        while found < 30:
            one = [words[i] for i in rng.integers(0, len(words), n)]
            other = list(one)
            for at in rng.choice(n, c, replace=False):
                other[at] = words[rng.integers(0, len(words))]
            a, b = " ".join(one), " ".join(other)
            if a != b and near_enough(a, b):
                pairs.append((n, c, a, b))
                found += 1
    d = spark.createDataFrame([(2 * k + j, x) for k, (_, _, *ab) in enumerate(pairs) for j, x in enumerate(ab)], "doc_id long, text string")
    gone = {r["doc_id"] for r in fuzzy_lines.dedup_lines(d).where("n_removed > 0").collect()}
    met, all_ = Counter(), Counter((n, c) for n, c, _, _ in pairs)
    for k, (n, c, _, _) in enumerate(pairs):
        met[n, c] += 2 * k in gone or 2 * k + 1 in gone
    assert sum(met.values()) >= 0.93 * len(pairs)
    assert all(met[x] >= 0.8 * all_[x] for x in all_), met


def test_groups_of_copies_cost_no_pairs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base.replace(f"word{i % 60} ", f"other{i} ")) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in fuzzy_lines.dedup_lines(d).where("n_removed = 0").collect()] == [0]
    lines = fuzzy_lines.simhashed(fuzzy_lines._lines(d, "doc_id", "text"))
    assert fuzzy_lines.line_links(d, lines, "doc_id", "text").count() < 400 * 16


def test_repeated_rows_and_blank_lines(spark):
    rows = [(1, "same line here\n\nother"), (1, "same line here\n\nother"), (2, "SAME  line here"), (3, None)]
    out = fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out if r["text"] is not None) == [
        (1, "", 2, 2), (1, "same line here\n\nother", 2, 0), (2, "", 1, 1)]


def test_blocks_are_votes_of_neighbours(spark):
    line = " ".join(f"feature{i}" for i in range(30))
    h = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in line.split()], "w string").select("w", F.xxhash64("w")).collect()}
    hs = sorted(h.values())
    votes = [(a & b) | (a & c) | (b & c) for a, b, c in zip(hs, hs[1:], hs[2:])]
    mixed = sorted(r[0] for r in spark.createDataFrame([(v,) for v in votes], "v long").select(F.xxhash64("v")).collect())
    got = spark.createDataFrame([(line,)], "l string").select(fuzzy_lines.blocks(F.col("l")).alias("b")).first()["b"]
    assert got == mixed[:fuzzy_lines.BLOCKS]


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("path", [PIECES, BPE])
def test_chunks_splice_to_the_count_of_the_whole(texts, path):
    m = token_count.load(path)
    whole = " ".join(r["text"] or "" for r in texts.values())[:60_000]
    for text in (whole, "  a  b " * 900, "x" * 5000, whole[:900] + "▁" + whole[:900], "漢字 é\n" * 700, "a <|endoftext|> b " * 300):
        want = m.count([text])[0]
        for chunk, overlap in ((4000, 64), (900, 16), (333, 8)):
            assert token_count.count_huge(m, text, chunk, overlap) == want


def test_token_counts(spark, docs, texts):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in token_count.count_tokens(docs, PIECES, chunk=3000, overlap=64).collect():
        t = texts[r["doc_id"]]["text"] or ""
        n = len(sp.encode(t))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 4096)


# ---------------------------------------------------------------- 8

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p><b>First  &eacute; text<br>goes on<p>Second > one</p><ul><li>item</ul>
<aside>See also</aside><script>var t="</p>";</script><div class="comments"><p>Nice!</p></div><!-- x --></article><footer>&copy; me</footer>"""


def test_page_text():
    x = html_text.Extractor({})
    assert x.text(PAGE) == "Head & line\n\nFirst é text goes on\n\nSecond > one\n\nitem"
    assert x.text(None) == x.text("") == x.text("<p>") == ""
    assert x.text("<p>no end <b attr='") == "no end"


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_text.train(pages, pick=F.xxhash64("page_id"))
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages, model, ["page_id", "url"]).collect():
        h = html[r["page_id"]]
        body = h[h.index("<article>") + 9:h.index("</article>")]
        import html as entities
        want = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1|div|li|ul)>", body)]
        assert r["text"] == "\n\n".join(b for b in want if b) and r["n_chars"] == len(r["text"])


def test_training_counts_tokens_in_and_out():
    e = html_text.evidence(PAGE)
    assert e["in:footer"][0] == 0 and e["in:footer"][1] == 2 and e["in:.ad"] == [0, 2]
    assert html_text.evidence("<p>none</p>") is None


@pytest.mark.parametrize("n", [2, 5, 300])
def test_asides_in_labelled_articles_are_not_learned_as_main_text(n):
    def page(i):
        body = "".join(f"<p>{' '.join(f'text{i}x{k}x{j}' for j in range(100))}</p>" for k in range(4))
        return (f"<html><body><div class=top>{'site ' * 20}</div><article>{body}<div class=comments>{'said ' * 60}</div>"
                f"<div class=advert>{'buy ' * 20}</div><aside>{'more ' * 20}</aside></article></body></html>")

    sums = defaultdict(lambda: [0, 0])
    for i in range(n):
        for k, (a, b) in html_text.evidence(page(i)).items():
            sums[k][0] += a
            sums[k][1] += b
    x = html_text.Extractor(html_text.weights(sums))
    for i in range(n):
        assert x.text(page(i)) == "\n\n".join(" ".join(f"text{i}x{k}x{j}" for j in range(100)) for k in range(4))


@pytest.mark.parametrize("tag", ["article", "main"])
def test_boxes_within_an_article_do_not_cut_it(tag):
    body = " ".join(f"w{i}" for i in range(300))
    items = "".join(f"<li><a href=x>entry {i} of box</a></li>" for i in range(60))
    page = (f"<html><body><nav>{'menu ' * 30}</nav><{tag}><h1>Six words of a long headline</h1><div class=advert>{'buy ' * 80}</div>"
            f"<p>{body}</p><aside><ul>{items}</ul></aside><p>The last words.</p><div class=comments>{'said ' * 50}</div></{tag}>"
            f"<footer>{'foot ' * 30}</footer></body></html>")
    assert html_text.Extractor({}).text(page) == f"Six words of a long headline\n\n{body}\n\nThe last words."


# ---------------------------------------------------------------- 9


def test_held_out_languages(spark):
    rows = queries.op9_rank_order_language(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_undetermined_and_slices(monkeypatch):
    p = rank_language.Profiles({"en": rank_language.ranked(*rank_language.grams("the cat and the dog")).tolist()}, 400)
    assert p.guess(None) == p.guess("12 !?") == ("und", 0.0) and p.guess("the dog")[0] == "en"
    text = "Größe und Maß, été; the end of it " * 50
    k, c = rank_language.grams(text)
    monkeypatch.setattr(rank_language, "SLICE", 97)
    k2, c2 = rank_language.grams(text)
    assert (k == k2).all() and (c == c2).all()


# ---------------------------------------------------------------- 10


def classes_by_hand(rows):
    sets = {i: set(chosen_path.gram_set(t).tolist()) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    near = {(min(a, b), max(a, b)) for v in where.values() for a in v for b in v if a != b}
    up, links = {i: i for i in sets}, Counter()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: (top(i), links[i]) for i in sets}


@pytest.fixture(scope="module")
def near_rows(texts):
    rng = np.random.default_rng(8)
    rows = [(i, texts[i]["text"]) for i in sorted(texts)][:80]
    for g in range(6):
        words = [f"w{int(x)}" for x in rng.integers(0, 5000, 150)]
        for c in range(9):
            own = list(words)
            for at in rng.integers(0, 150, c % 5).tolist():
                own[at] = f"v{int(rng.integers(0, 9999))}"
            rows.append((1000 + 20 * g + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("how", [{}, {"split_above": 2, "block": 2, "exact_block": 2}])
def test_chosen_paths_find_all_links(spark, near_rows, how):
    d = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = {r["k"]: (r["class_id"], r["n_links"]) for r in chosen_path.jaccard_classes(d, **how).collect()}
    assert got == classes_by_hand(near_rows)


def test_one_of_each_keeps_clean_rows(spark, near_rows):
    d = spark.createDataFrame([*near_rows, near_rows[0]], "doc_id long, text string")
    kept = [r["doc_id"] for r in chosen_path.one_of_each(d).collect()]
    classes = {c for c, _ in classes_by_hand(near_rows).values()}
    assert len(kept) == len(set(kept)) == len(classes)


def test_runs_hold_the_recall_for_split_buckets(docs, monkeypatch):
    class Seen(Exception):
        pass

    def described(docs, key, text, n, runs, branch):
        meet = 1.0
        for _ in range(chosen_path.DEEPEST):
            meet = 1 - math.exp(-branch * 0.8 * meet)
        assert (1 - meet) ** runs <= 1e-4
        raise Seen

    monkeypatch.setattr(chosen_path, "described", described)
    with pytest.raises(Seen):
        chosen_path.jaccard_classes(docs)


def test_recall_of_runs():
    assert chosen_path.runs_for(0.9999, 0.8) > chosen_path.runs_for(0.99, 0.8) >= 3
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        both = rng.integers(0, 2 ** 63, 160, np.uint64)
        x = np.unique(np.concatenate([both, rng.integers(0, 2 ** 63, 20, np.uint64)]))
        y = np.unique(np.concatenate([both, rng.integers(0, 2 ** 63, 20, np.uint64)]))
        met += len(np.intersect1d(chosen_path.leaves(x, 8), chosen_path.leaves(y, 8))) > 0
    assert met >= 298


def test_long_lines_of_few_common_words_are_not_compared(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(4, 9))) for _ in range(400)]
    rows = []
    for n in (40, 80, 200):
        a = rng.sample(words, n)
        for share in (0.05, 0.2):
            b = list(a)
            for i in rng.sample(range(n), int(n * share)):
                b[i] = rng.choice(words)
            rows.append((" ".join(a), " ".join(b), True))
        rows.append((" ".join(a), " ".join(w[::-1] for w in a), False))
    rows.append(("short line", "another line", True))
    d = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert [r["got"] for r in d.select(fuzzy_lines.alike(F.col("a"), F.col("b")).alias("got")).collect()] == [r[2] for r in rows]


@pytest.mark.parametrize("large", [1, 4, 10_000])
def test_languages_of_many_and_of_few_rows_are_learned_alike(spark, monkeypatch, large):
    rows = [(i, ["aa", "bb", "cc", "dd", None][min(4, i % 9 // 2)], f"text {i * 7 % 13} of {'xyz'[i % 3] * (i % 4)}") for i in range(90)]
    rows += [(90, "ee", "once only"), (91, "aa", None)]
    d = spark.createDataFrame(rows, "_l long, lang string, text string")
    want = rank_language.train(d, per_language=5)
    monkeypatch.setattr(rank_language, "LARGE", large)
    assert rank_language.train(d, per_language=5) == want and set(want) == {"aa", "bb", "cc", "dd", "ee"}
    assert rank_language.train(d.where("lang = 'ff'")) == {}


def test_lines_that_lengths_tell_apart_get_no_texts(spark, monkeypatch):
    """Lines that hold another one and as much again share blocks with it, and are not sent to be compared."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = []
    for _ in range(20):
        w = [word() for _ in range(30)]
        lines += [" ".join(w), " ".join(w + [word() for _ in range(20)]), " ".join(w[:-1] + [word()])]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    found = fuzzy_lines._lines(d, "doc_id", "text")
    size = {r["h"]: r["n"] for r in found.select(*fuzzy_lines._hashes(), F.length("norm").alias("n")).collect()}
    sent, verified = [], fuzzy_lines._verified
    monkeypatch.setattr(fuzzy_lines, "_verified", lambda pairs, *a: sent.extend(pairs.collect()) or verified(pairs, *a))
    links = fuzzy_lines.line_links(d, fuzzy_lines.simhashed(found), "doc_id", "text").distinct().count()
    assert links >= 15 and all(abs(size[r["a"]] - size[r["b"]]) <= 0.2 * max(size[r["a"]], size[r["b"]]) + 1e-9 for r in sent)


def links_of_lines(spark, lines):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    found = fuzzy_lines._lines(d, "doc_id", "text").cache()
    name = {r["h"]: r["norm"] for r in found.select(*fuzzy_lines._hashes(), "norm").collect()}
    with_blocks = fuzzy_lines.simhashed(found)
    blocks = {name[r["h"]]: set(r["sim"]) for r in with_blocks.collect()}
    return [(name[r["a"]], name[r["b"]]) for r in fuzzy_lines.line_links(d, with_blocks, "doc_id", "text").collect()], blocks


def groups_of(lines, links):
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {frozenset(x for x in lines if find(x) == r) for r in map(find, lines)}


def test_all_pairs_that_share_a_block_are_linked(spark):
    """Chains of lines, each near the next only, and lines that share a block by chance: judged by edits of all pairs in a block."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    lines = []
    for _ in range(6):
        kept = [word() for _ in range(8)]
        for _ in range(3):  # chains that share a third of their words
            w = kept + [word() for _ in range(16)]
            for _ in range(9):
                lines.append(" ".join(w))
                for at in rng.sample(range(8, 24), 3):
                    w[at] = word()
    got, blocks = links_of_lines(spark, lines)
    want = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if blocks[a] & blocks[b] and near_enough(a, b)]
    assert groups_of(lines, got) == groups_of(lines, want)


def test_long_lines_whose_words_all_differ_by_a_letter_are_linked(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=9)) for _ in range(60)]
    # Three words in a row of their hashes stay as they are, and give the block that both lines have.
    h = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect()}
    one = " ".join(words)
    for at in range(58):
        kept = sorted(words, key=h.get)[at:at + 3]
        other = " ".join(w if w in kept else "k" + w[1:] for w in words)
        b = spark.createDataFrame([(one,), (other,)], "l string").select(fuzzy_lines.blocks(F.col("l")).alias("b")).collect()
        if set(b[0]["b"]) & set(b[1]["b"]):
            break
    assert near_enough(one, other) and not spark.range(1).select(fuzzy_lines.alike(F.lit(one), F.lit(other))).first()[0]
    assert [set(x) for x in links_of_lines(spark, [one, other])[0]] == [{one, other}]


@pytest.mark.parametrize("crowd", [0, 8])
def test_large_groups_that_share_a_block_are_linked_in_any_turn(spark, monkeypatch, crowd):
    monkeypatch.setattr(fuzzy_lines, "CROWD", crowd)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    kept, lines = [word() for _ in range(6)], []
    for _ in range(3):
        w = kept + [word() for _ in range(19)]
        lines += [" ".join(w)] + [" ".join(w[:i] + [word()] + w[i + 1:]) for i in range(6, 25)]
    got, blocks = links_of_lines(spark, lines)
    want = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if blocks[a] & blocks[b] and near_enough(a, b)]
    assert groups_of(lines, got) == groups_of(lines, want)


def test_work_tables_are_emptied(spark):
    top = Path(materialize(spark.range(1)).inputFiles()[0].removeprefix("file:")).parents[1]
    before = set(top.iterdir())
    d = spark.createDataFrame([(i, f"line {i % 7} of some words here\nother words {i % 5} of it") for i in range(60)], "doc_id long, text string")
    assert fuzzy_lines.dedup_lines(d).where("n_removed = 0").count() > 0
    made = [p for p in top.iterdir() if p not in before]
    full = {p.name.split("-")[1] for p in made if spark.read.parquet(str(p)).columns != ["id"]}
    assert len(made) > 8 and full == {"later", "touched"}
