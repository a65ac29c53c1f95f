"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.llm.common import bounded_sample, settle
from chronoset.llm.words import WordTable, portions, sum_runs

_words = re.compile(r"[^\W\d_]+")
SEGMENT, PORTION = 64, 1 << 17


def features(word: str) -> list[str]:
    """The word, its first 4, 5 and 6 letters, and its last 4, for words that are longer."""
    return [f"w{word}"] + [f"p{word[:n]}" for n in (4, 5, 6) if len(word) > n] + ([f"s{word[-4:]}"] if len(word) > 4 else [])


def hashed(word: str, size: int) -> list[int]:
    return [zlib.crc32(f.encode()) % size for f in features(word)]


def label_tokens(texts: list[list[str]], toxic: list[int]) -> set[str]:
    """Features that mark toxic tokens, from words of texts with a label each.

    A feature is a marker if it occurs more in toxic texts than chance allows: of the features in three toxic texts
    or more, its log-likelihood ratio over the texts that hold it exceeds 2 ln(their number) + 2, and at least 9 in
    10 of those texts, after weighing the two classes alike, are toxic.
    """
    held: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(texts, toxic, strict=True):
        if label:
            held[1].update({f for w in set(words) for f in features(w)})
    wanted = {f for f, k in held[1].items() if k >= 3}  # others are no markers, whatever clean texts hold
    known: dict[str, tuple[str, ...]] = {}
    for words, label in zip(texts, toxic, strict=True):
        if not label:
            found: set[str] = set()
            for w in set(words):
                if w not in known:
                    known[w] = tuple(f for f in features(w) if f in wanted)
                found.update(known[w])
            held[0].update(found)
    n1 = max(sum(toxic), 1)
    n0 = max(len(toxic) - sum(toxic), 1)
    base = n1 / (n0 + n1)
    limit = 2 * np.log(max(sum(k >= 3 for k in held[1].values()), 2)) + 2
    marks = set()
    for f, k in held[1].items():
        if k < 3:
            continue
        other = held[0][f]
        share = k / (k + other)
        if k / n1 < 9 * other / n0 or share <= base:
            continue
        g = 2 * (k * np.log(share / base) + (other * np.log((1 - share) / (1 - base)) if other else 0.0))
        if g > limit:
            marks.add(f)
    return marks


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` holds a weight for each hashed feature (toxic against clean); ``start`` and ``moves`` are the
    log-potentials of the first tag and of tag pairs; ``logit`` turns document features into a score."""

    weights: np.ndarray
    bias: float
    start: np.ndarray
    moves: np.ndarray
    logit: np.ndarray

    def word_rows(self, words: list[str]) -> np.ndarray:
        found = [hashed(w, len(self.weights)) for w in words]
        flat = np.fromiter((h for f in found for h in f), np.int64)
        return sum_runs(self.weights[flat], np.array([len(f) for f in found], np.int64)) + self.bias

    def marginals(self, emissions: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(toxic) of each token, for texts of ``counts`` tokens one after the other; each text is one whole chain."""
        out = np.zeros(len(emissions))
        ends = np.cumsum(counts)
        # texts in portions of about PORTION tokens, so that memory follows the longest text, not their sum
        cuts = np.unique(np.searchsorted(ends, np.arange(PORTION, len(emissions), PORTION), side="right"))
        for some in np.split(np.arange(len(counts)), cuts):
            if len(some):
                start, end = int(ends[some[0]] - counts[some[0]]), int(ends[some[-1]])
                out[start:end] = chain_marginals(emissions[start:end], counts[some], self.start, self.moves)[0]
        return out

    def score(self, top: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """Document scores from the largest marginal and the expected number of toxic tokens."""
        x = doc_features(top, expected)
        return 1 / (1 + np.exp(-np.clip(x @ self.logit, -30, 30)))


def doc_features(top: np.ndarray, expected: np.ndarray) -> np.ndarray:
    odds = np.log(np.clip(top, 1e-6, 1 - 1e-6) / (1 - np.clip(top, 1e-6, 1 - 1e-6)))
    return np.stack([np.ones(len(top)), odds, np.log1p(expected)], axis=1)


def segments(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each token its segment and place, and the number of segments."""
    per = -(-counts // SEGMENT)
    first = np.cumsum(per) - per
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + place // SEGMENT, place % SEGMENT, int(per.sum())


def chain_marginals(emissions: np.ndarray, counts: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(tag 1) of each token and the expected counts of tag pairs, for whole chains of ``counts`` tokens.

    All segments of SEGMENT tokens step together. A first pass gives each segment's product of transfer matrices;
    products are chained text by text, which gives what enters each segment from either side; a second pass runs
    forward and backward from there. So results are those of the uncut chain, in time linear in tokens.
    """
    if not len(emissions):
        return np.zeros(0), np.zeros((2, 2))
    rows, cols, height = segments(counts)
    x, live, first = np.ones((SEGMENT, height)), np.zeros((SEGMENT, height), bool), np.zeros((SEGMENT, height), bool)
    x[cols, rows] = np.exp(np.clip(emissions, -30, 30))
    live[cols, rows] = True
    full = counts[counts > 0]
    opens = np.cumsum(full) - full
    first[cols[opens], rows[opens]] = True
    m, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    # transfer[a][b] of each token; a first token has no predecessor, a missing one changes nothing
    at = lambda a, b: np.where(first, s[b], m[a, b]) * (x if b else 1.0)
    move = [[np.where(live, at(a, b), float(a == b)) for b in (0, 1)] for a in (0, 1)]

    def through(v0: np.ndarray, v1: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        w0, w1 = v0 * move[0][0][t] + v1 * move[1][0][t], v0 * move[0][1][t] + v1 * move[1][1][t]
        total = (w0 + w1).sum(axis=0) if w0.ndim > 1 else w0 + w1
        return w0 / total, w1 / total

    one, none = np.ones(height), np.zeros(height)
    p0, p1 = np.stack([one, none]), np.stack([none, one])  # [entering tag, segment] of either leaving tag
    for t in range(SEGMENT):
        p0, p1 = through(p0, p1, t)
    per = -(-full // SEGMENT)
    begin = np.cumsum(per) - per
    before, after = np.full((2, height), 0.5), np.full((2, height), 0.5)
    for j in range(1, int(per.max(initial=1))):
        now = begin[per > j] + j
        v = before[:, now - 1]
        w = np.stack([(v * p0[:, now - 1]).sum(axis=0), (v * p1[:, now - 1]).sum(axis=0)])
        before[:, now] = w / w.sum(axis=0)
    ends = begin + per - 1
    for j in range(1, int(per.max(initial=1))):
        now = ends[per > j] - j
        v = after[:, now + 1]
        w = p0[:, now + 1] * v[0] + p1[:, now + 1] * v[1]
        after[:, now] = w / w.sum(axis=0)
    alpha = np.zeros((SEGMENT + 1, 2, height))
    alpha[0] = before
    for t in range(SEGMENT):
        alpha[t + 1] = through(alpha[t, 0], alpha[t, 1], t)
    p, pairs = np.zeros((SEGMENT, height)), np.zeros((2, 2))
    b0, b1 = after
    for t in range(SEGMENT - 1, -1, -1):
        z = alpha[t + 1, 0] * b0 + alpha[t + 1, 1] * b1
        p[t] = alpha[t + 1, 1] * b1 / z
        inner = live[t] & ~first[t]
        joint = [[alpha[t, a] * move[a][b][t] * (b1 if b else b0) for b in (0, 1)] for a in (0, 1)]
        total = joint[0][0] + joint[0][1] + joint[1][0] + joint[1][1]
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] += (joint[a][b] / total)[inner].sum()
        c0, c1 = move[0][0][t] * b0 + move[0][1][t] * b1, move[1][0][t] * b0 + move[1][1][t] * b1
        b0, b1 = c0 / (c0 + c1), c1 / (c0 + c1)
    return p[cols, rows], pairs


def forward_backward(e: np.ndarray, live: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Of padded chains with emissions ``e`` for tag 1 (0 for tag 0): log Z, P(tag 1), expected counts of tag pairs."""
    n, length = e.shape
    alpha = np.zeros((n, length, 2))
    beta = np.zeros((n, length, 2))
    alpha[:, 0, 0], alpha[:, 0, 1] = start[0], start[1] + e[:, 0]
    for t in range(1, length):
        to0 = np.logaddexp(alpha[:, t - 1, 0] + moves[0, 0], alpha[:, t - 1, 1] + moves[1, 0])
        to1 = np.logaddexp(alpha[:, t - 1, 0] + moves[0, 1], alpha[:, t - 1, 1] + moves[1, 1]) + e[:, t]
        on = live[:, t]
        alpha[:, t, 0] = np.where(on, to0, alpha[:, t - 1, 0])
        alpha[:, t, 1] = np.where(on, to1, alpha[:, t - 1, 1])
    for t in range(length - 2, -1, -1):
        on = live[:, t + 1]
        for s in (0, 1):
            step = np.logaddexp(moves[s, 0] + beta[:, t + 1, 0], moves[s, 1] + e[:, t + 1] + beta[:, t + 1, 1])
            beta[:, t, s] = np.where(on, step, 0.0)
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
    pairs = np.zeros((2, 2))
    on = live[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            m = alpha[:, :-1, a] + moves[a, b] + (e[:, 1:] if b else 0.0) + beta[:, 1:, b] - z[:, None]
            pairs[a, b] = np.exp(np.minimum(m, 0.0))[on].sum()
    return z, p, pairs


def fit_crf(texts: list[list[str]], tags: list[np.ndarray], *, size: int = 1 << 18, epochs: int = 12, batch: int = 1 << 15, rate: float = 0.3, l2: float = 1e-4, seed: int = 5) -> ToxicityModel:
    """Weights by AdaGrad on the conditional log-likelihood of tagged texts, with about ``batch`` tokens a step."""
    words = list(dict.fromkeys(w for t in texts for w in t))
    index = {w: i for i, w in enumerate(words)}
    feats = [hashed(w, size) for w in words]
    width = max((len(f) for f in feats), default=1)
    table = np.full((len(words), width), size, np.int64)
    for i, f in enumerate(feats):
        table[i, : len(f)] = f
    weights, seen = np.zeros(size + 1), np.full(size + 1, 1e-2)
    other, seen_other = np.zeros(7), np.full(7, 1e-2)  # bias, start (2), moves (4)
    other[0] = -4.0
    chains = [(np.array([index[w] for w in t], np.int64), np.asarray(y)) for t, y in zip(texts, tags, strict=True) if len(t)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        tokens = np.cumsum([len(chains[i][0]) for i in order])
        for some in np.split(order, np.searchsorted(tokens, np.arange(batch, tokens[-1] if len(tokens) else 0, batch))):
            if not len(some):
                continue
            ids, y = (np.concatenate([chains[i][k] for i in some]) for k in (0, 1))
            counts = np.array([len(chains[i][0]) for i in some], np.int64)
            p, pairs = chain_marginals(weights[table[ids]].sum(axis=1) + other[0], counts, other[1:3], other[3:].reshape(2, 2))
            gap = y - p
            grad = np.zeros(size + 1)
            hot = np.abs(gap) > 1e-4
            np.add.at(grad, table[ids[hot]].reshape(-1), np.repeat(gap[hot], width))
            grad[size] = 0.0
            touched = np.nonzero(grad)[0]
            g = grad[touched] - l2 * weights[touched] * (counts.sum() / SEGMENT)
            seen[touched] += g * g
            weights[touched] += rate * g / np.sqrt(seen[touched])
            opens = np.cumsum(counts) - counts
            inner = np.ones(len(y), bool)
            inner[opens] = False
            at = np.nonzero(inner)[0]
            real = np.bincount(2 * y[at - 1].astype(int) + y[at].astype(int), minlength=4).reshape(2, 2)
            begun = (y[opens] - p[opens]).sum()
            g = np.concatenate([[gap.sum(), -begun, begun], (real - pairs).reshape(-1)])
            seen_other += g * g
            other += 0.1 * g / np.sqrt(seen_other)
    return ToxicityModel(weights[:size], float(other[0]), other[1:3].copy(), other[3:].reshape(2, 2).copy(), np.array([0.0, 1.0, 0.0]))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the ridge pulls towards the odds of the largest marginal."""
    prior = np.array([0.0, 1.0, 0.0])
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.diag([0.01, 1, 1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * len(y) * np.array([0.01, 1, 1]) * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], toxic: list[int], drawn: tuple[float, float] = (1.0, 1.0), **limits) -> ToxicityModel:
    """Label tokens, fit the field on them, then the document score on the field's marginals.

    Tokens are labelled by what all texts hold; the field is fitted on the toxic texts and as many clean ones, the
    score on all. ``drawn`` tells which shares of the clean and of the toxic texts these are, so that scores follow
    the odds of all labelled texts.
    """
    one: dict[str, str] = {}  # each word is held once
    split = [[one.setdefault(w, w) for w in _words.findall(t.lower())] for t in texts]
    marks = label_tokens(split, toxic)
    marked: dict[str, bool] = {}
    for words, label in zip(split, toxic, strict=True):
        if label:
            for w in words:
                if w not in marked:
                    marked[w] = any(f in marks for f in features(w))
    clean = [k for k, label in enumerate(toxic) if not label]
    chosen = [k for k, label in enumerate(toxic) if label]
    step = max(1, len(clean) // max(len(chosen), 1))
    chosen = sorted(chosen + clean[::step])
    tags = [np.array([marked[w] if toxic[k] else False for w in split[k]], np.int64) for k in chosen]
    model = fit_crf([split[k] for k in chosen], tags, **limits)
    counts = np.array([len(w) for w in split], np.int64)
    new = list(dict.fromkeys(w for ws in split for w in ws))
    known = dict(zip(new, model.word_rows(new).tolist(), strict=True)) if new else {}
    p = model.marginals(np.fromiter((known[w] for ws in split for w in ws), np.float64, int(counts.sum())), counts)
    top, expected = summaries(p, counts)
    y = np.array(toxic)
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, 1 / drawn[1], 1 / drawn[0])
        logit = _calibrated(doc_features(top, expected), y, weight / weight.mean())
        model = ToxicityModel(model.weights, model.bias, model.start, model.moves, logit)
    return model


def summaries(p: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest marginal and the sum of marginals of each text; zeros without tokens."""
    top, expected = np.zeros(len(counts)), np.zeros(len(counts))
    full = np.nonzero(counts)[0]
    if len(full):
        at = (np.cumsum(counts) - counts)[full]
        top[full], expected[full] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    return top, expected


def train(docs: DataFrame, labels: DataFrame, *, bound: int = 3000, clean: int = 4, chars: int = 100_000, **limits) -> ToxicityModel:
    """Fit on about ``bound`` / 2 toxic documents at most and up to ``clean`` times as many clean ones.

    Whole texts are learned from; documents beyond ``chars`` characters are not drawn for fitting. ``labels`` holds
    doc_id and toxic; rows with a null label are left out, and so are documents without text. A doc_id with both
    labels counts as toxic. Repeated rows are one; documents that share an id are thinned out by their texts if they
    exceed the bound.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return ToxicityModel(np.zeros(1), -20.0, np.zeros(2), np.zeros((2, 2)), np.array([0.0, 1.0, 0.0]))
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(23)), 11) / F.lit(float(1 << 53))
    most = {1: bound / 2, 0: bound / 2 * clean}
    shares = {k: min(1.0, most[k] / max(counts.get(k, 0), 1)) for k in (0, 1)}
    drawn = known.where(F.when(F.col("toxic") == 1, part < shares[1]).otherwise(part < shares[0]))
    total = (1 + clean) * bound
    rows = docs.where(F.length("text") <= chars).join(F.broadcast(drawn.limit(total)), "doc_id")  # drawn to about half as many
    rows = bounded_sample(settle(rows.select("doc_id", "text", "toxic").dropDuplicates(), "toxicity-sample"), total, "doc_id", "text")
    sample = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"] for r in sample], [int(r["toxic"]) for r in sample], (shares[0], shares[1]), **limits)


def tag(docs: DataFrame, model: ToxicityModel, *, least: float = 0.5) -> DataFrame:
    """Score every whole text of ``docs`` and list its toxic spans.

    Returns the columns of docs and score (0 to 1), predicted (score >= 0.5) and spans array<struct<start, end, p>>:
    the tokens with P(toxic) >= ``least``, as code points, ends exclusive; columns of docs with these names are
    replaced. Null and empty texts have the score of a text without toxic tokens. Repeated rows and null ids give a
    row each; an empty table gives an empty table.
    """
    docs = docs.drop("score", "predicted", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 numbers at most, a parameter of the fit
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = WordTable(m.word_rows)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            for start, end in portions(texts):
                split = [_words.findall(t.lower()) if t else [] for t in texts[start:end]]
                counts = np.array([len(w) for w in split], np.int64)
                ids = table.ids([w for ws in split for w in ws])
                p = m.marginals(table.rows[ids] if len(ids) else np.zeros(0), counts)
                scores[start:end] = m.score(*summaries(p, counts))
                ends = np.cumsum(counts)
                by_text: dict[int, list[int]] = {}
                for i in np.nonzero(p >= least)[0]:
                    by_text.setdefault(int(np.searchsorted(ends, i, side="right")), []).append(int(i))
                for k, hits in by_text.items():
                    first = int(ends[k] - counts[k])
                    spans[start + k] = _spans(texts[start + k], [h - first for h in hits], p[first : ends[k]])
            out = {n: batch.column(n) for n in batch.schema.names} | {"score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32)), "spans": pa.array(spans, kind)}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    schema = docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "spans": F.array().cast("array<struct<start:int,end:int,p:double>>")}).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(run, schema)


def _spans(text: str, hits: list[int], p: np.ndarray) -> list[dict]:
    """Places of the given words of a text; a text that lower case makes longer is searched in lower case."""
    low = text.lower()
    found = [(m.start(), m.end()) for m in _words.finditer(low)]
    if len(low) != len(text):
        grown = np.cumsum([0] + [len(c.lower()) for c in text])
        found = [(int(np.searchsorted(grown, s, side="right")) - 1, int(np.searchsorted(grown, e, side="left"))) for s, e in found]
    return [{"start": found[h][0], "end": found[h][1], "p": float(p[h])} for h in hits]
