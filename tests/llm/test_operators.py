"""Operators against brute force, round trips, held-out accuracy, and edge cases."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoset.llm import chat, decontam, graph, html, jaccard, langid, lines, mixing, oracle, queries, secrets, topk, toxicity
from chronoset.llm.words import WordTable
from tests.oracle import assert_same, connection

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    """Documents with the given (doc_id, text) and columns whose names clash with those of results."""
    rows = [(i, t, "en", "s", len(t) if t else None, -1.5, "x", 7) for i, t in texts]
    return spark.createDataFrame(rows, DOCS + ", score double, spans string, size int")


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_matches_sql(spark, small_dir, name):
    assert_same(spark, connection(small_dir), queries.QUERIES[name], oracle.ORACLE[name], small_dir)


# ---------------------------------------------------------------- 1

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main"><article><h1>Caf&eacute; &amp; bar</h1><p><b>One
 two</b><br>three<p>Four <a href="/x">five</a> six, and a good deal more text than a menu holds.</p><div class="ad">Buy</div>
<form><input value="q"><button>Go</button></form><section class="comments"><p>First!</p></section></article>
<aside>Side</aside></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(1, "http://www.a.com/1", PAGE), (2, "http://a.com/2", None), (3, None, ""), (None, "x", "<p>no host &lt;b&gt;</p>"), (5, "http://b.com", "<body><div><p>unclosed")]
    out = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    assert out[1]["text"] == "Café & bar\nOne two three\nFour five six, and a good deal more text than a menu holds."
    assert out[1]["n_chars"] == len(out[1]["text"])
    assert (out[2]["text"], out[3]["text"], out[None]["text"], out[5]["text"]) == ("", "", "no host <b>", "unclosed")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<a " * 100_000, '<a "x>" ' * 60_000, "<!x " * 100_000, "<b>" * 50_000 + "<h1></h1>" * 30_000, "<p><td>" + "<b>" * 40_000 + "<h1>x</h1>" * 20_000, "<script " * 50_000, "<div>" * 60_000 + "x"])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html.Page(page).votes()
    assert time.time() - began < 3


def text_of(page):
    held = html.Page(page)
    best = held.best()
    return held.text_of(best) if best is not None else ""


def test_words_do_not_drop_parts_of_an_article():
    page = ("<body><article><h1>Title</h1><p>Introduction of the matter, of some length.</p><section id='discussion'><p>What it means.</p></section><h2 id='comments'>Remarks</h2>"
            "<p>More.</p><div class='related-work'><p>Others.</p></div><div class='related-posts'>x</div><div class='ad'>Buy</div><section class='comments'><p>First!</p></section><div id='comment-list'>No</div></article></body>")
    assert text_of(page) == "Title\nIntroduction of the matter, of some length.\nWhat it means.\nRemarks\nMore.\nOthers."


def test_page_in_a_form_and_inline_elements():
    body = "<div class='content'><h1>H</h1><p>" + "word " * 100 + "</p></div>"
    assert text_of(f"<body><form action='x'><input type='hidden'>{body}<label>Search</label><select><option>A</option></select></form></body>") == "H\n" + " ".join(["word"] * 100)
    assert text_of("<body><div><p>A<script>x</script>B <button>Go</button>C</p><form><p>Sign here</p><input></form></div></body>") == "AB C"
    assert text_of("<div><p>1 < 2 and 3 > 2</p><p title='a > b'>c</p></div><p") == "1 < 2 and 3 > 2\nc"


def test_host_winner_decides(spark):
    long = "<p>" + "plenty of words here " * 8 + "</p>"
    many = [(i, "http://h.org/", f"<body><div class='story'>{long}</div><div class='box'><p>short</p></div></body>") for i in range(5)]
    odd = (9, "http://h.org/x", f"<body><div class='story'><p>the text</p></div><div class='box'>{long}</div></body>")
    out = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([*many, odd], "page_id long, url string, html string")).collect()}
    assert out[9] == "the text"


# ---------------------------------------------------------------- 2

def test_jaccard_against_brute_force(spark):
    base = [words(60, s) for s in range(6)]
    texts = []
    for b in base:
        for k in range(5):
            w = list(b)
            for p in random.Random(k).sample(range(60), k):
                w[p] = f"x{k}"
            texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), "one two", "one two", "", None, "...", "a " * 4000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id " + texts[1])]
    out = {r["doc_id"]: r for r in jaccard.jaccard_join(docs(spark, rows)).collect()}

    def shingles(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()) if t else []
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [shingles(t) for t in texts]
    for i, a in enumerate(sets):
        linked = [j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9]
        extra = sum(1 for b in [shingles(rows[-1][1])] if a and len(a & b) >= 0.8 * len(a | b))
        assert out[i]["n_links"] == len(linked) + extra
        assert out[i]["n_shingles"] == len(a)
        for j in linked:
            assert out[j]["class_id"] == out[i]["class_id"]
    assert len(out) == len(rows)
    assert jaccard.jaccard_join(docs(spark, rows).limit(0)).count() == 0


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.least_matches((16, 32, 64), 0.8, 1e-6)
    assert least[16] < least[32] < least[64] < 52
    a = np.zeros((3, 64), np.uint32)
    a[1, :8] = 1
    a[2] = np.arange(64) + 5
    i, j = jaccard.pruned_pairs(a, a, True, least)
    assert list(zip(i, j)) == [(0, 1)]


def test_dense_overlaps_equal_sparse_ones():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    i, j = np.tile(i, 3), np.tile(j, 3)
    assert jaccard.overlaps(sets, i, j, columns=16).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_rounds(spark, monkeypatch):
    """Chains whose links lie together are joined in their tasks; a round and one that changes nothing are left."""
    written = []
    monkeypatch.setattr(graph, "settle", lambda df, name, f=graph.settle: (written.append(name), f(df, name))[1])
    edges = [(1000 * c + i, 1000 * c + i + 1) for c in range(8) for i in range(200)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
    assert got == {1000 * c + i: 1000 * c for c in range(8) for i in range(201)} and len(written) <= 3
    monkeypatch.setattr(graph, "TOGETHER", 1)  # what lies apart is joined in rounds
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1000 * c + i: 1000 * c for c in range(8) for i in range(201)}


# ---------------------------------------------------------------- 3

def test_toxicity_held_out(spark):
    bad = ["scumword", "idiotic", "trashy"]
    rng = random.Random(0)
    texts = []
    for i in range(400):
        w = [f"w{rng.randrange(300)}" for _ in range(40)]
        label = int(i % 4 == 0)
        if label:
            for p in rng.sample(range(40), 3):
                w[p] = rng.choice(bad)
        texts.append((" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w), label))
    model = toxicity.fit([t for t, _ in texts[:300]], [y for _, y in texts[:300]], epochs=6)
    rows = [(i, t) for i, (t, _) in enumerate(texts[300:])] + [(900, None), (901, ""), (902, "İİ SCUMWORD " * 3000), (None, "..")]
    out = {r["doc_id"]: r for r in toxicity.tag(docs(spark, rows), model).collect()}
    assert np.mean([out[i]["predicted"] == y for i, (_, y) in enumerate(texts[300:])]) > 0.95
    assert out[900]["predicted"] == 0 and out[901]["score"] == out[900]["score"] and out[None]["spans"] == []
    assert out[902]["predicted"] == 1 and len(out[902]["spans"]) == 3000
    s = out[902]["spans"][0]
    assert rows[-2][1][s["start"] : s["end"]] == "SCUMWORD"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, start, moves = rng.normal(size=(1, 5)), rng.normal(size=2), rng.normal(size=(2, 2))
    z, p, pairs = toxicity.forward_backward(e, np.ones((1, 5), bool), start, moves)
    total, one, two = 0.0, np.zeros(5), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=5):
        w = np.exp(start[tags[0]] + sum(e[0, t] * tags[t] for t in range(5)) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        total += w
        one += w * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            two[a, b] += w
    assert np.allclose(z, np.log(total)) and np.allclose(p[0], one / total) and np.allclose(pairs, two / total)


# ---------------------------------------------------------------- 4

def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", s, 0) for i in range(300) for s in (["a"] if i % 3 else ["b"] if i % 2 else [None])]
    rows += [(1000, None, None, "c", 0), (1001, "", None, "c", 0), (None, "one", None, "a", 0)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("k", F.lit(1))
    out = mixing.mix(frame, bucket_rows=17).toPandas()
    assert len(out) == len(rows) and (out["taken"] <= 3 * out["size"]).all()
    assert out["taken"].sum() <= out["size"].sum()
    for s, g in out.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 7
        assert g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-9
    other = mixing.mix(frame.repartition(7), bucket_rows=50).toPandas()
    assert sorted(other["taken"]) == sorted(out["taken"])
    assert mixing.mix(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- 5

def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi </s>[INST] <|text|> \\l \\e"), (1, 1, "assistant", "a\\<|turn|>b"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "x"), (None, 0, "user", "é" * 50_000), (4, 1, "assistant", "y"), (4, 1, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    chats = chat.format_chats(frame)
    back = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    for c in (1, 2, 3, 4, None):
        want = sorted(((t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [w[1:] for w in want]
        assert back[c]["trained"] == [w[2] for w in want if w[1] == "assistant"]
    state = {r["conv_id"]: (r["valid"], r["ended"]) for r in chats.collect()}
    assert state == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False), None: (True, False)}
    d = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert d[1]["loss_sha256"] == hashlib.sha256(rows[1][3].encode()).hexdigest()
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0


# ---------------------------------------------------------------- 6

def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 340)] + [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, []), (None, rows[1][1]), (600, [0.5] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(frame, query_block=3, row_block=64).collect()}
    ints = {i: [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in ints if i % 50 == 0]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [(i, -s) for s, i in best]
    assert topk.search(frame.limit(0)).count() == 0


# ---------------------------------------------------------------- 7

def test_secrets(spark):
    rng = random.Random(1)
    token = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    model = secrets.fit([token(30) for _ in range(400)], ["".join(rng.choice(["the", "ing", "er", "com", "pute"]) for _ in range(5)) for _ in range(400)])
    text = f"é token: 'abc12345' PASSWORD=x secret=password=longenough AKIA{'A' * 12} {'a1' * 16} {token(40)}9 theingerthecomputeing1"
    found = secrets.digests(secrets.scan(docs(spark, [(1, text), (2, None), (3, ""), (None, "token = abcdefgh")]), model))
    out = {r["doc_id"]: r for r in found.collect()}
    base = [(m.start(), "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text, re.I | re.A) if len(m[2]) >= 8]
    base += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(base, key=lambda x: (x[0], secrets.KINDS.index(x[1]))))
    assert (out[1]["n_assign"], out[1]["n_access"], out[1]["n_hex"]) == (2, 1, 1)
    assert out[1]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[1]["spans"].count("markov") == 1
    assert out[2]["spans"] == out[3]["spans"] == "" and out[None]["n_assign"] == 1


# ---------------------------------------------------------------- 8

def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_similarity():
    rng = random.Random(0)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(14)))
        if rng.random() < 0.6:
            b = a[: rng.randrange(len(a) + 1)] + b[:2] + a[rng.randrange(len(a) + 1) :]
        d = levenshtein(a, b)
        for s in (0.5, 0.8):
            assert lines.edit_similarity(a, b, s) == (d <= int((1 - s) * max(len(a), len(b)) + 1e-9))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(words(40, 50 + s, 3000)) for s in range(12)]
    rows = []
    for d in range(14):
        ls = []
        for _ in range(4):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] += "s"
            ls.append(" ".join(w))
        rows.append((d, "\n".join([ls[0], "", *ls[1:], "Short  line", "short line"])))
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "x" * 70_000), (53, "x" * 70_000)]
    out = lines.dedup_lines(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    occ = [(d, i, " ".join(x.lower().split())) for d, t in rows[:14] for i, x in enumerate(t.split("\n")) if x.strip()]
    table = WordTable(lines._bits)
    sims, n = lines.simhashes([o[2] for o in occ], table)
    root = list(range(len(occ)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(occ)), 2):
        near = n[i] >= 5 and n[j] >= 5 and bin((int(sims[i]) ^ int(sims[j])) & (2**64 - 1)).count("1") <= 3 and lines.edit_similarity(occ[i][2], occ[j][2], 0.8)
        if occ[i][2] == occ[j][2] or near:
            root[max(find(i), find(j))] = min(find(i), find(j))
    kept = {occ[i][:2] for i in range(len(occ)) if find(i) == i}
    got = {r["doc_id"]: r for r in out}
    for d, t in rows[:14]:
        want = "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip() or (d, i) in kept)
        assert got[d]["text"] == want and got[d]["n_removed"] == len(t.split("\n")) - len(want.split("\n")) or want == ""
    assert got[50]["text"] is None and got[50]["n_lines"] == 0 and got[52]["text"] == "\n\n"
    assert [r["text"] for r in out if r["doc_id"] == 53] == ["x" * 70_000] * 2
    assert lines.dedup_lines(docs(spark, rows).limit(0)).count() == 0


def kept_lines(spark, ls, **options):
    """The kept ones of the lines of one document, by edit similarity alone."""
    row = lines.dedup_lines(docs(spark, [(1, "\n".join(ls))]), distance=None, **options).first()
    assert row["n_lines"] == len(ls) and row["n_removed"] == len(ls) - len(row["text"].split("\n"))
    return row["text"].split("\n")


def kept_by_edits(ls):
    """What brute force over edit similarity keeps, in no need of hashes."""
    root = list(range(len(ls)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(ls)), 2):
        if find(i) != find(j) and lines.edit_similarity(lines.normalised(ls[i]), lines.normalised(ls[j]), 0.8):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [x for i, x in enumerate(ls) if find(i) == i]


def test_line_dedup_reaches_edit_similarity(spark):
    rng = random.Random(5)
    ls = []
    for s in range(60):
        base = words((6, 8, 12, 20, 50, 100)[s % 6], 900 + s, 30_000)
        ls.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for k in rng.sample(range(len(base)), max(1, len(base) // 8)):
                other[k] = f"w{rng.randrange(30_000)}"
            ls.append(" ".join(other))
    want = kept_by_edits(ls)
    assert len(want) < 70 and kept_lines(spark, ls) == want


def test_line_dedup_compares_all_of_a_bucket(spark):
    rng = random.Random(6)
    ls = []
    for s in range(5):  # templates with one word changed, and the template's words in other orders
        base = words(40, 700 + s, 30_000)
        for _ in range(16):
            other = list(base)
            other[rng.randrange(40)] = f"w{rng.randrange(30_000)}"
            ls.append(" ".join(other))
        ls += [" ".join(rng.sample(base, 40)) for _ in range(4)]
    chain = words(40, 800, 30_000)  # each line is like the next, the ends are not alike
    for _ in range(24):
        ls.append(" ".join(chain))
        chain = chain[2:] + words(2, rng.random(), 30_000)
    rng.shuffle(ls)
    want = kept_by_edits(ls)
    assert len(want) == 5 + 20 + 1
    assert kept_lines(spark, ls, block=6) == want == kept_lines(spark, ls)
    group = [{"h": i, "norm": x, "b": 0, "i": 0, "j": 0} for i, x in enumerate(ls)]
    assert len(lines.group_links([group], 0.8)) == len(ls) - len(want)  # spanning links only


def test_line_dedup_of_short_lines(spark):
    ls = ["confirm your subscription now", "confirm yuor subscription now", "Unsubscribe", "Unsubscribed", "read more here", "read more  hree!",
          "contact us", "about us", "敏捷的棕色狐狸跳过了那只懒惰的狗然后离开", "敏捷的棕色狐狸跳过了那只懒惰的猫然后离开", "東京都は日本の首都であり人口が多い", "東京都は日本の首都であり人口が多い。",
          "ประเทศไทยมีเมืองหลวงคือกรุงเทพมหานคร", "ประเทศไทยมีเมืองหลวงคือกรุงเทพมหานคน", "abcde", "abcdf", "abcd", "x", "y"]
    want = kept_by_edits(ls)
    assert len(want) == 11 and kept_lines(spark, ls) == want


def test_line_dedup_compares_followers_of_leaders(spark):
    """Lines with the same clauses in other orders follow one leader; twins among them are like each other only."""
    rng = random.Random(8)
    clauses = [" ".join(words(4, 1200 + s, 30_000)) for s in range(16)]
    ls = []
    for _ in range(24):
        line = "; ".join(rng.sample(clauses, len(clauses)))
        ls += [line, line + " ok"]
    rng.shuffle(ls)
    want = kept_by_edits(ls)
    assert len(want) == 24
    assert kept_lines(spark, ls, block=6) == want


def test_line_dedup_writes_lines_not_pairs_of_large_buckets(spark, monkeypatch):
    """The second pass over a bucket writes its lines once for each pair of blocks at most, however many pairs there are."""
    rng = random.Random(8)
    clauses = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(4)) for _ in range(16)]
    orders = ["; ".join(rng.sample(clauses, len(clauses))) for _ in range(300)]
    ls = [x for o in orders for x in (o, o + " ok")]
    rng.shuffle(ls)
    written, settle = {}, lines.settle

    def counted(df, name):
        out = settle(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(lines, "settle", counted)
    kept = kept_lines(spark, ls)
    assert sorted(x.removesuffix(" ok") for x in kept) == sorted(orders)
    keys, blocks = lines.LONG[4], -(-len(ls) // 256)
    assert max(written.values()) <= len(ls) * keys * (blocks + 1), written


def test_pairs_are_compared_in_the_first_common_bucket():
    x, y = np.array([0, 0, 1]), np.array([1, 2, 2])
    buckets = [[7, 11, 15], [11, 15, 3], [15, 4]]
    assert lines.share_earlier(buckets, 15, x, y).tolist() == [True, False, False]
    assert lines.share_earlier(buckets, 11, x, y).tolist() == [False] * 3


def test_many_edit_distances_at_once():
    rng = random.Random(9)
    ls = []
    for n in (1, 3, 40, 63, 64, 65, 128, 129, 200, 300) * 8:
        x = [rng.choice("abcd é中") for _ in range(n)]
        y = list(x)
        for _ in range(rng.randrange(1 + n // 3)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = rng.choice(["", "a", "b "])
        ls += ["".join(x), "".join(y[len(y) // 6 :] + y[: len(y) // 8]), "".join(y)]
    pairs = [(i, j) for i in range(len(ls)) for j in range(i + 1, min(i + 4, len(ls)))]
    x, y = np.array(pairs).T
    for s in (0.5, 0.8, 0.95):
        got = lines.Comparer(ls, s).alike(x, y)
        assert got.tolist() == [levenshtein(ls[i], ls[j]) <= int((1 - s) * max(len(ls[i]), len(ls[j])) + 1e-9) for i, j in pairs]


def test_pairs_too_far_apart_are_left_out_early(monkeypatch):
    rng = random.Random(10)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    ls = []
    for n in (400, 500, 640) * 20:  # two unlike lines, and one like the first with scattered edits
        x = text(n)
        ls += [x, text(n + rng.randrange(20)), "".join("z" if k % 12 == 0 else c for k, c in enumerate(x))]
    pairs = [(i, i + k) for i in range(0, len(ls), 3) for k in (1, 2)] + [(i, i + 1) for i in range(1, len(ls), 3)]
    left, bound = [], lines._least_left
    monkeypatch.setattr(lines, "_least_left", lambda *args: left.append(len(args[-1])) or bound(*args))
    x, y = np.array(pairs).T
    assert lines.Comparer(ls, 0.8).alike(x, y).tolist() == [lines.edit_similarity(ls[i], ls[j], 0.8) for i, j in pairs]
    assert left[0] == 120 and 40 in left and left[-1] == 20, left


def test_components_of_few_edges_take_one_round(spark, monkeypatch):
    ids = random.Random(11).sample(range(10**6), 3001)
    edges = [*zip(ids[:1500], ids[1:1501]), *zip(ids[1501:-1], ids[1502:])]  # two chains
    random.Random(12).shuffle(edges)
    written, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: written.append(name) or settle(df, name))
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {k: min(part) for part in (ids[:1501], ids[1501:]) for k in part}
    assert written == ["edges"] * 2


# ---------------------------------------------------------------- 9

def test_decontamination_against_brute_force(spark):
    items = [(1, " ".join(words(30, 1))), (2, " ".join(words(12, 2))), (3, "Just three words"), (4, None), (5, "?!"), (None, " ".join(words(30, 1)))]
    w1, w2 = words(30, 1), words(12, 2)
    rows = [(1, "pre " + " ".join(w1[3:20]) + " mid " + " ".join(w2) + " JUST, three-words end"), (2, " ".join(w1[:9])), (3, None), (4, ""), (None, " ".join(w1[5:15])), (6, " ".join(words(5000, 9))), (7, "É just three words"), (7, "É just three words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(docs(spark, rows), bench).collect()
    clean = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = clean(t)
        for s in range(max(len(w) - 9, 1)) if w else ():
            wins.setdefault(tuple(w[s : s + 10]), set()).add(i)
    want = []
    for d, t in rows:
        w, hit, who = clean(t), set(), set()
        for g, ids in wins.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit |= set(range(s, s + len(g)))
                    who |= ids - {None}
        want.append((d, len(w), len(hit), ",".join(sorted(map(str, who))), bool(hit)))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontam.decontaminate(docs(spark, rows).limit(0), bench).count() == 0


# ---------------------------------------------------------------- 10

def test_language_held_out(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = queries.op10_langid(spark, small_dir).join(d.select("doc_id", "lang"), "doc_id")
    assert out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.9
    model = langid.fit(["the cat and the dog"] * 3 + ["der hund und die katze"] * 3 + ["le chat et le chien"] * 3 + ["хлеб и вода"] * 3, ["en"] * 3 + ["de"] * 3 + ["fr"] * 3 + ["ru"] * 3)
    rows = [(1, "the dog"), (2, "die katze und"), (3, "le chien et"), (4, "вода"), (5, None), (6, ""), (7, "123 !?"), (None, "the cat " * 5000)]
    found = {r["doc_id"]: r for r in langid.predict(docs(spark, rows), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, None)] == ["en", "de", "fr", "ru", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    none = langid.fit([], [])
    assert {r["lang_pred"] for r in langid.predict(docs(spark, rows), none).collect()} == {"und"}


# ---------------------------------------------------------------- edges

def test_deep_and_odd_pages(spark):
    deep = '<div class="aaa bbb">' * 16_000 + "<p>at the bottom</p>"
    inner = '<html><body><article><p>One.</p><div class="legal"><p>Part of the article.</p></div><p>Let <math><mi>x</mi></math> be.</p></article></body></html>'
    rows = [(1, "http://d.org/", deep), (2, "http://i.org/", inner), (2, "http://i.org/", inner)]
    out = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in out) == [(1, "at the bottom")] + [(2, "One.\nPart of the article.\nLet x be.")] * 2


def test_chains_are_not_cut():
    rng = np.random.default_rng(3)
    counts = np.array([300, 0, 1, 64, 65, 130], np.int64)
    e, start, moves = rng.normal(size=counts.sum()) * 2, rng.normal(size=2), rng.normal(size=(2, 2)) * 2
    p, pairs = toxicity.chain_marginals(e, counts, start, moves)
    at, total = 0, np.zeros((2, 2))
    for n in counts[counts > 0]:
        _, want, two = toxicity.forward_backward(e[None, at : at + n], np.ones((1, n), bool), start, moves)
        assert np.allclose(p[at : at + n], want[0])
        at, total = at + n, total + two
    assert np.allclose(pairs, total)


def test_mixing_of_equal_ids(spark):
    rows = [(i, None, f"w{i} " + "word " * 9, s) for i in range(50) for s in "abc"]
    frame = spark.createDataFrame(rows, "n long, doc_id long, text string, source string")
    got = {r["source"]: (r["t"], r["g"]) for r in mixing.mix(frame).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()}
    assert all(abs(t - g) <= 20 for t, g in got.values()) and len(got) == 3


def test_topk_edges(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (51, [1.0, 1.0]), (52, []), (100, []), (53, [0.5, -0.5])]
    out = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 15
    first = sorted((r["vec_id"], r["score"]) for r in out if r["query_id"] == 50 and r["rank"] == 1)
    assert first == [(51, 65536), (51, 65536)]
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"]) if r["query_id"] == 100] == [(50, 0), (50, 0), (51, 0), (52, 0), (53, 0)]


def test_lists_are_read_in_part_where_vectors_are_skewed():
    rng = np.random.default_rng(4)
    x = np.floor(256 * rng.pareto(1.2, (4000, 6))).astype(np.int64)
    q = np.zeros((20, 6), np.int64)
    q[np.arange(20), np.arange(20) % 6] = 256
    r, c, s, read = topk.nra_block(q, np.full(20, -1), x, np.arange(4000), 5)
    every = q @ x.T
    for k in range(20):
        want = sorted((-every[k, j], j) for j in range(4000))[:5]
        assert [(-v, j) for v, j in zip(s[r == k], c[r == k])] == want
    assert read < 0.2 * 20 * 4000


def test_numerals_are_no_letters(spark):
    model = langid.fit(["the cat and the dog"] * 3 + ["der hund und die katze"] * 3, ["en"] * 3 + ["de"] * 3)
    rows = [(1, "½ ² ⅓"), (2, "x² the dog")]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs(spark, rows), model).collect()} == {1: "und", 2: "en"}
    assert langid.predict(docs(spark, rows).limit(0), model).count() == 0


def test_markov_spans_of_planted_secrets(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secret = lambda n: "".join(rng.choice(letters) for _ in range(n))
    syllables = ["con", "ter", "ing", "pro", "ment", "able", "tion", "re", "der", "sta", "lin", "o", "per"]
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6)))
    rows = [(i, f"{' '.join(plain() for _ in range(40))} token={secret(24)} {' '.join(plain() for _ in range(40))}") for i in range(200)]
    model = secrets.train(docs(spark, rows))
    planted = [secret(rng.choice((16, 24, 32))) for _ in range(200)]
    test = [(i, f"{' '.join(plain() for _ in range(30))} {p} {' '.join(plain() for _ in range(30))}") for i, p in enumerate(planted)] + [(500, None), (501, "x" * 200_000), (0, "again")]
    found = {(r["doc_id"], r["spans"]) for r in secrets.digests(secrets.scan(docs(spark, test), model)).collect()}
    right = sum((i, f"markov:{t.index(p)}:{t.index(p) + len(p)}") in found for (i, t), p in zip(test, planted))
    assert right >= 190  # the only span, at the right place
    assert secrets.scan(docs(spark, rows).limit(0), model).count() == 0


def test_repeated_rows_of_jaccard_join(spark):
    text = " ".join(words(60, 5))
    out = jaccard.jaccard_join(docs(spark, [(1, text)] * 300 + [(2, text + " more")] * 3 + [(None, text)])).collect()
    assert len(out) == 304 and {r["class_id"] for r in out} == {1} and {r["n_links"] for r in out} == {303}
