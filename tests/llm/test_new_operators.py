"""Chosen-path near-dedup, divergence audit and hard negatives against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoset.llm import chosenpath, divergence, langid, mixing, negatives, topk, toxicity, vectors
from tests.llm.test_operators import docs, words

# ---------------------------------------------------------------- 11


def sets_of(text):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def brute_components(rows):
    """doc_id of each row's component, by all pairs."""
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        f = find(i)
        least[f] = d if least[f] is None else least[f] if d is None else min(least[f], d)
    return [least[find(i)] for i in range(len(rows))], [len(s) for s in sets]


def altered(text, n, seed):
    w, r = text.split(), random.Random(seed)
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def near_rows():
    base = [" ".join(words(150, s)) for s in range(12)]
    rows, n = [], 0
    for s, text in enumerate(base):
        for k in range(12):
            rows.append((n := n + 1, altered(text, k, 100 * s + k)))  # similarity from 1 to about 0.65
    rows += [(n + 1, base[0]), (n + 2, base[0].upper()), (n + 3, base[1].replace(" ", "  \n"))]
    return rows


def check_components(spark, rows, **options):
    out = chosenpath.near_duplicates(docs(spark, rows), **options).toPandas()
    component, sizes = brute_components(rows)
    want = sorted(zip([d for d, _ in rows], component, sizes), key=str)
    got = [tuple(None if pd.isna(v) else int(v) for v in r) for r in out[["doc_id", "component_id", "n_shingles"]].itertuples(index=False)]
    assert sorted(got, key=str) == want
    return out


def test_near_duplicates_match_all_pairs(spark):
    check_components(spark, near_rows())


def test_near_duplicates_in_blocks_and_deep_nodes(spark):
    """Leaves beyond the bound are cut into blocks and branch again; components stay the same."""
    text = " ".join(words(120, 77))
    rows = [(i, altered(text, i % 9, i)) for i in range(90)] + [(1000 + i, " ".join(words(60, 500 + i)) + " " + " ".join(text.split()[:20])) for i in range(30)]
    check_components(spark, rows, leaf=8, depth=3)
    check_components(spark, rows, leaf=8, depth=2)


def test_near_duplicates_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, "a b c d"), (7, "a b c d"), (8, "A b C d"), (None, "only here"), (9, "x " * 60_000)]
    out = check_components(spark, rows)
    kept = sorted((None if pd.isna(r.doc_id) else int(r.doc_id), bool(r.kept)) for r in out.itertuples() if not pd.isna(r.doc_id))
    assert kept == [(1, True), (2, True), (3, True), (4, True), (5, False), (6, True), (7, True), (7, True), (8, False), (9, True)]
    assert sorted(bool(r.kept) for r in out.itertuples() if pd.isna(r.doc_id)) == [False, True]  # no id is there for one of them
    assert chosenpath.near_duplicates(docs(spark, [])).count() == 0


def test_number_of_trees():
    assert chosenpath.trees_needed(0.85, 1, 0.99) < chosenpath.trees_needed(0.85, 3, 0.99) < chosenpath.trees_needed(0.85, 3, 0.9999)


# ---------------------------------------------------------------- 12


def brute_audit(rows, least_docs, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    in_docs, of_lang, of_group = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in texts:
        in_docs[lang].update(set(terms))
        of_lang[lang].update(terms)
        of_group[lang, source].update(terms)
    out = []
    share = lambda n, total, v: 1 + int(Fraction(10**9 * (n + 5), total + 5 * v))
    for lang, source in of_group:
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        p = {s: {t: share(of_group[lang, s][t], sum(of_group[lang, s][k] for k in kept), len(kept)) for t in kept} for x, s in of_group if x == lang}
        q = {t: share(of_lang[lang][t], sum(of_lang[lang][k] for k in kept), len(kept)) for t in kept}
        pairs = sorted(((-sum(abs(p[source][t] - p[s][t]) for t in kept), s.encode(), s) for s in p if s != source))
        out += [(lang, source, "pair", s, -v, i + 1) for i, (v, _, s) in enumerate(pairs)]
        terms = sorted((q[t] - p[source][t], t.encode(), t) for t in kept if of_group[lang, source][t] and p[source][t] > q[t])[:top]
        out += [(lang, source, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(terms)]
    return sorted(out)


def audit_docs(spark, rows):
    return spark.createDataFrame([(i, *r, 1.0, "x", 3) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, value double, item string, rank int")


def test_audit_matches_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["the", "of", "Ämter", "ämter", "word", "größe", "x"]
    rows = [(" ".join(r.choice(vocabulary) + r.choice([" ", ", ", "1", "_", ""]) for _ in range(r.randrange(40))), r.choice(["en", "de", None]), r.choice(["a", "b", "ü", None])) for _ in range(150)]
    rows += [("", "fr", "only"), (None, "fr", "other"), ("word", "", "a")]
    for blocks in ({}, {"shard_terms": 2, "source_block": 1}):
        out = divergence.audit(audit_docs(spark, rows), least_docs=9, top_terms=3, **blocks)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(map(tuple, out.collect())) == brute_audit(rows, 9, 3)


def test_audit_edges(spark):
    assert divergence.audit(audit_docs(spark, [])).count() == 0
    long = "alpha beta " * 40_000
    rows = [(long, "en", "a"), (long, "en", "a"), ("alpha", "en", "b"), ("", "en", "c"), (None, None, None)]
    assert sorted(map(tuple, divergence.audit(audit_docs(spark, rows), least_docs=2).collect())) == brute_audit(rows, 2, 50)
    # shares stay exact where a product with a billion leaves 64 bits
    n = 5 * 10**12
    one = spark.createDataFrame([(n, 2 * n, 7)], "c long, t long, v long").select(divergence.share(F.col("c"), F.col("t"), F.col("v"))).first()[0]
    assert one == 1 + (10**9 * (n + 5)) // (2 * n + 35)


# ---------------------------------------------------------------- 13


def brute_negatives(rows, every=100, scale=256):
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], label))
    width = max((len(v) for _, v, _ in held), default=0)
    held = [(i, v + [0] * (width - len(v)), label) for i, v, label in held]
    out = []
    for a, (i, v, label) in enumerate(held):
        if i % every:
            continue
        others = [(-sum(x * y for x, y in zip(v, w)), j, other == label) for b, (j, w, other) in enumerate(held) if b != a]
        for score, j in sorted((s, j) for s, j, same in others if same)[:5]:
            band = sorted((s, k) for s, k, same in others if not same and 30 * -score <= 100 * -s <= 90 * -score)[:10]
            cut = lambda s: min(max(-s, -(2**63)), 2**63 - 1)
            out += [(i, j, rank + 1, k, cut(score), cut(s)) for rank, (s, k) in enumerate(band)]
    return sorted(out)


def vectors_frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank int, anchor_id string")


def test_negatives_match_brute_force(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(4, 24)) / 5
    rows = [(i, (centres[i % 4] + r.normal(size=24) / 6).astype(np.float32).tolist(), int(r.integers(3)) if i % 4 else int(i % 3)) for i in range(400)]
    rows += [(100, rows[0][1], 0), (100, rows[0][1], 0), (7, rows[0][1], 1)]  # repeated ids, rows and scores
    for sizes in ({}, {"anchor_block": 2, "row_block": 50}):
        assert sorted(map(tuple, negatives.mine(vectors_frame(spark, rows), every=20, **sizes).collect())) == brute_negatives(rows, 20)


def test_negatives_edges(spark):
    one = [1.0, 0.5]
    rows = [(0, one, 1), (1, one, 1), (2, one, None), (3, None, 1), (4, [1.0, float("nan")], 1), (5, [1.0, float("inf")], 1), (6, [1.0, None], 1), (None, one, 1), (8, [0.5], 2), (9, [], 2), (10, [0.6, 0.3], 2), (11, [-1.0, -0.5], 3)]
    assert sorted(map(tuple, negatives.mine(vectors_frame(spark, rows)).collect())) == brute_negatives(rows)
    assert negatives.mine(vectors_frame(spark, [])).count() == 0
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [1.5e38, 1.0], 2), (3, [2.6e38, 0.0], 2), (4, [2.9e38, 0.0], 2), (5, [-3e38, 0.0], 3)]
    assert sorted(map(tuple, negatives.mine(vectors_frame(spark, huge)).collect())) == brute_negatives(huge)


@pytest.mark.parametrize("width", [1, 3, 64, 100])
def test_intervals_hold_every_score(width):
    r = np.random.default_rng(width)
    q, x = (np.floor(256 * r.normal(size=(n, width))) for n in (20, 300))
    x[0] = 0
    turn = negatives.rotation(width)
    assert np.allclose(turn @ turn.T, np.eye(width))
    block, stored = negatives.QueryBlock(q, turn), negatives.encode(x, turn)
    narrow = wider = 0
    one = negatives.encode(x, turn, 1)
    for i in range(len(q)):
        low, high = block.bounds(i, *stored)
        score = x @ q[i]
        assert (low <= score).all() and (score <= high).all()
        rough = block.bounds(i, *one)
        assert (rough[0] <= score).all() and (score <= rough[1]).all()
        narrow, wider = narrow + (high - low).sum(), wider + (rough[1] - rough[0]).sum()
    assert narrow < (0.4 * wider if width > 3 else wider + 1)


def test_exact_products_and_keys():
    r = np.random.default_rng(0)
    for top in (100, 2**28, 2**40, 2**100):
        q, x = (np.array([[float(int(v * top)) for v in row] for row in r.uniform(-1, 1, size=(n, 5))]) for n in (3, 7))
        want = [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]
        assert [[int(v) for v in row] for row in vectors.exact_products(q, x, top)] == want
        assert [int(v) for v in vectors.exact_products(q[0], x, top)] == want[0]
    scores = [-(10**90), -5, 0, 7, 10**80]
    keys = [vectors.key_of_score(s) for s in scores]
    assert keys == sorted(keys) and [vectors.score_of_key(k) for k in keys] == scores


# ---------------------------------------------------------------- scale of the earlier ones


def test_topk_of_huge_components(spark):
    """Scores beyond 64 bits keep their order; they come out as the nearest long."""
    rows = [(0, [2.0**40] * 64), (1, [2.0**40] * 64), (2, [2.0**39] * 64), (3, [-(2.0**40)] * 64), (4, [1.0] * 64), (50, [0.5] * 64)]
    out = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in out) == [(0, 1, 1), (0, 2, 2), (0, 3, 4), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert {r["score"] for r in out if r["query_id"] == 0 and r["rank"] < 3} == {2**63 - 1}


def test_mixing_without_ids(spark):
    """All ids null: rows are told by their texts, and the sums are those of one order over all."""
    rows = [(None, " ".join(["w"] * (1 + i % 7)) + f" x{i}", "en", "ab"[i % 2]) for i in range(300)] + [(None, "same text", "en", "a")] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(df).toPandas()
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert len(out) == 360 and not out.duplicated(["source", "finish"]).any() and abs(out["taken"].sum() - total) <= 3 * 8
    for _, part in out.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 3 * 8
    again = mixing.mix(df.repartition(5)).toPandas()
    assert sorted(out["taken"]) == sorted(again["taken"])


def test_copies_are_drawn_once_for_training(spark):
    texts = [(f"the house and the river of {i}", "en") for i in range(60)] + [(f"das haus und der fluss von {i}", "de") for i in range(60)]
    copied = spark.createDataFrame([(i, *t) for i, t in enumerate(texts * 40)], "doc_id long, text string, lang string")
    once = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    a, b = langid.train(copied, bound=10**6), langid.train(once, bound=10**6)
    assert np.allclose(a.weights, b.weights)
    docs_ = spark.createDataFrame([(1, "bad bad word")] * 500 + [(2, "good word")] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs_, labels)
    assert toxicity.tag(docs_, model).count() == 1000
