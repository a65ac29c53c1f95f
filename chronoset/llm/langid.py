"""Hierarchical language identification: families first, then one-versus-one linear SVMs inside a family."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoset.llm.common import give_back, lean, settle
from chronoset.llm.words import WordTable, portions, sum_runs

# The family of a language code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indo-aryan": ("hi", "ur", "bn", "pa", "gu", "mr", "ne"),
    "semitic": ("ar", "he", "mt", "am"),
    "sinitic": ("zh", "yue", "wuu"),
}
UNDETERMINED = "und"
_words = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; numerals that are no digits, as in "x²", end a word."""
    found = _words.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


def family_of(language: str) -> str:
    return next((f for f, langs in FAMILIES.items() if language in langs), f"only {language}")


def grams(words: list[str], size: int, longest: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of words with marked edges.

    Returns an array (characters of all marked words, n) of features, -1 where a gram would leave its word, and the
    number of characters of each marked word.
    """
    joined = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(joined))
    out = np.full((len(joined), longest), -1, np.int64)
    h = np.zeros(len(joined), np.uint64)
    for n in range(1, longest + 1):
        h = h * np.uint64(1_000_003)
        h[: len(joined) - n + 1] += joined[n - 1 :] + np.uint64(1)
        mixed = (h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(20)
        inside = left >= n
        out[inside, n - 1] = (mixed[inside] % np.uint64(size)).astype(np.int64)
    return out, lengths


@dataclass(frozen=True)
class LanguageModel:
    """Linear separators over hashed n-grams of words.

    Each column of ``weights`` is one separator: first one for each family against the rest, then one for each pair
    of languages in a family. ``bias`` has their offsets and ``scale`` turns margins into probabilities.
    """

    families: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    lonely: tuple[tuple[str, str], ...]  # (family, its only language)
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    @property
    def size(self) -> int:
        return len(self.weights)

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sums of its weights, and in the last column its number of features."""
        ids, lengths = grams(words, self.size)
        table = np.concatenate([self.weights, np.ones((self.size, 1), np.float32)], axis=1)
        table = np.concatenate([table, np.zeros((1, table.shape[1]), np.float32)])  # for -1
        of_char = table[ids[:, 0]]
        for n in range(1, ids.shape[1]):
            of_char += table[ids[:, n]]
        return sum_runs(of_char, lengths)

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language and the confidence of each row of margins (the mean of the weights, without bias)."""
        p = 1 / (1 + np.exp(-np.clip(self.scale * (margins + self.bias), -30, 30)))
        nf = len(self.families)
        fam = p[:, :nf] / p[:, :nf].sum(axis=1, keepdims=True) if nf > 1 else np.ones((len(p), 1))
        best = fam.argmax(axis=1)
        langs, scores = [], np.zeros(len(p))
        members: dict[str, dict[str, list[tuple[int, bool]]]] = {f: {} for f in self.families}
        for f, lang in self.lonely:
            members[f][lang] = []
        for i, (a, b) in enumerate(self.pairs):
            members[family_of(a)].setdefault(a, []).append((nf + i, True))
            members[family_of(a)].setdefault(b, []).append((nf + i, False))
        for r, f in enumerate(best):
            votes = {lang: np.mean([p[r, c] if first else 1 - p[r, c] for c, first in duels]) if duels else 1.0 for lang, duels in members[self.families[f]].items()}
            lang = max(sorted(votes), key=votes.get)
            langs.append(lang)
            scores[r] = fam[r, f] * votes[lang]
        return langs, scores


def _svm(x: np.ndarray, y: np.ndarray, *, steps: int = 150, c: float = 10.0) -> tuple[np.ndarray, float, float]:
    """A linear SVM (squared hinge, classes weighted alike) by accelerated gradient descent: weights, bias, scale."""
    side = np.where(y, 1.0, -1.0).astype(np.float32)
    weight = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = w.copy(), b
    rate = 1.0 / (1.0 / c + 2.0 * float(np.einsum("ij,ij->i", x, x).max(initial=0.0) + 1))
    for t in range(steps):
        slack = np.maximum(0, 1 - side * (x @ vw + vb))
        pull = 2 * weight * slack * side
        nw, nb = vw + rate * (x.T @ pull - vw / c * 1e-3), vb + rate * float(pull.sum())
        vw, vb = nw + t / (t + 3) * (nw - w), nb + t / (t + 3) * (nb - b)
        w, b = nw, nb
    m = side * (x @ w + b)
    spread = float(np.median(np.abs(m))) or 1.0
    return w, b, 4.0 / spread


def shares(words: list[str], size: int) -> np.ndarray:
    """The share of each hashed n-gram in all of a text's words."""
    ids = grams(words, size)[0]
    ids = ids[ids >= 0]
    return (np.bincount(ids, minlength=size) / len(ids)).astype(np.float32)


def fit(texts: list[str], languages: list[str], *, size: int = 1 << 12, factor: float = 100.0) -> LanguageModel:
    """Fit on labelled texts; texts without a letter are left out."""
    some = [(shares(words, size), lang) for text, lang in zip(texts, languages, strict=True) if (words := words_of(text))]
    return fit_rows(np.array([x for x, _ in some], np.float32).reshape(-1, size), [lang for _, lang in some], factor)


def fit_rows(x: np.ndarray, kept: list[str], factor: float = 100.0, times: float = 1.0) -> LanguageModel:
    """Fit on :func:`shares` of texts, ``times`` that number, one row each, and their languages."""
    size = x.shape[1]
    x = np.array(x, np.float32)  # the only copy
    if not kept:
        return LanguageModel((), (), (), np.zeros((size, 0), np.float32), np.zeros(0), np.zeros(0))
    y = np.array(kept)
    x *= np.float32(factor / times)
    centre = x.mean(axis=0)
    x -= centre
    langs = sorted(set(kept))
    families = tuple(sorted({family_of(v) for v in langs}))
    of = {f: [v for v in langs if family_of(v) == f] for f in families}
    fams = np.array([family_of(v) for v in kept])
    pairs = tuple(p for f in families for p in combinations(of[f], 2))
    solved = [_svm(x, fams == f) if len(families) > 1 else (np.zeros(size, np.float32), 1.0, 1.0) for f in families]
    for a, b in pairs:
        rows_in = (y == a) | (y == b)
        solved.append(_svm(x[rows_in], y[rows_in] == a))
    weights = np.stack([s[0] for s in solved], axis=1) * factor
    bias = np.array([s[1] - float(centre @ s[0]) for s in solved])
    lonely = tuple((f, of[f][0]) for f in families if len(of[f]) == 1)
    return LanguageModel(families, pairs, lonely, weights.astype(np.float32), bias, np.array([s[2] for s in solved]))


def train(docs: DataFrame, usable: Column | None = None, *, bound: int = 3000, size: int = 1 << 12, chars: int = 250_000) -> LanguageModel:
    """Fit on at most about ``bound`` labelled documents with a letter, drawn for each language alike by a hash of text;
    copies of a text are one of them.

    Tasks turn whole texts into ``size`` shares each, and only those go to the driver; a text beyond ``chars``
    characters is counted in portions.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    counts = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")), "languages")
    n = counts.count()
    if not n:
        return fit([], [], size=size)
    part = F.shiftrightunsigned(F.xxhash64("text", "lang", F.lit(11)), 11) / F.lit(float(1 << 53))
    drawn = rows.select("text", "lang").join(counts, "lang").where(part * F.col("__n") < F.lit(bound / n)).select("text", "lang").dropDuplicates()  # copies of a text share its hash

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                total, seen = np.zeros(size), 0
                for start in range(0, len(text), chars):
                    if words := words_of(text[start : start + chars]):
                        ids = grams(words, size)[0]
                        ids = ids[ids >= 0]
                        total, seen = total + np.bincount(ids, minlength=size), seen + len(ids)
                if seen:
                    langs.append(lang)
                    found.append((total / seen * 64).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(langs, pa.string())], ["shares", "lang"])

    table = drawn.mapInArrow(lean(counted), "shares binary, lang string").toArrow()  # about ``bound`` rows of 2 * size bytes
    table = table.sort_by([("lang", "ascending"), ("shares", "ascending")])
    x = np.zeros((table.num_rows, size), np.float16)
    for i, v in enumerate(table.column("shares")):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    langs = table.column("lang").to_pylist()
    table = v = None
    model = fit_rows(x, langs, times=64.0)
    del x
    give_back()  # the driver goes on with the next stages
    return model


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Predict the language of every whole text of ``docs``; the columns lang_pred and score come after all others.

    ``und`` with score 0 for null texts, texts without a letter, and if no language was learned. Columns of docs that
    are called lang_pred or score are replaced. Repeated rows and nulls elsewhere give a row each; an empty table
    gives an empty table.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # size x separators, set by the parameters of fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        table = WordTable(m.word_rows)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            for start, end in portions(texts) if m.families else ():
                split = [words_of(t) if t else [] for t in texts[start:end]]
                counts = np.array([len(w) for w in split], np.int64)
                rows = np.nonzero(counts)[0]
                if len(rows):
                    ids = table.ids([w for ws in split for w in ws])
                    sums = sum_runs(table.rows[ids], counts)[rows].astype(np.float64)
                    found, conf = m.decide(sums[:, :-1] / sums[:, -1:])
                    for r, lang in zip(rows, found, strict=True):
                        langs[start + r] = lang
                    scores[start + rows] = conf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    for f in schema.fields:
        f.nullable = True
    return docs.mapInArrow(lean(run), schema)
