"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoset.llm.common import settle

# The three base patterns, their least lengths, and the kinds in their order.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")

_assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{32,}")  # a run is maximal, so this is HEX with the failing matches dropped
_keywords = ("password", "passwd", "secret", "token", "apikey", "api_key")
_token = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
# letters with digits, or capitals after small letters
_mixed = re.compile(r"[A-Za-z].*[0-9]|[0-9].*[A-Za-z]|[a-z].*[A-Z]")
#: Runs of so many characters are judged whatever they are of.
LONG_RUN = 20
_ident = re.compile(r"[A-Za-z_-]{6,}|[0-9-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CODES = np.full(128, 0, np.int64)
for _i, _c in enumerate(ALPHABET):
    CODES[ord(_c)] = _i + 1
STATES = len(ALPHABET) + 1
#: Judged tokens that a task remembers.
REMEMBERED = 200_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, sorted by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(k in low for k in _keywords):
        found += [(m.start(), m.end(), "assign") for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _access.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in _hex.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _encoded(token: str) -> np.ndarray:
    return CODES[np.frombuffer(token.encode("ascii"), np.uint8)]


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of character transitions, random strings against ordinary identifiers."""

    ratio: np.ndarray
    threshold: float = 0.6
    least_total: float = 8.0

    def score(self, token: str) -> tuple[float, float]:
        """The ratio per transition, and in total."""
        x = _encoded(token)
        total = float(self.ratio[x[:-1], x[1:]].sum())
        return total / max(len(x) - 1, 1), total

    def is_secret(self, token: str) -> bool:
        mean, total = self.score(token)
        return mean >= self.threshold and total >= self.least_total


def transitions(tokens: list[str]) -> np.ndarray:
    counts = np.zeros((STATES, STATES))
    for t in tokens:
        x = _encoded(t)
        np.add.at(counts, (x[:-1], x[1:]), 1)
    return counts


def fit(randoms: list[str], ordinary: list[str], *, smoothing: float = 0.5, backing: float = 5.0, false_share: float = 1e-4, **limits) -> MarkovModel:
    """First-order models of both classes; transitions back off to the class's single characters with the weight of
    ``backing`` observations, and those to a uniform choice. The least total ratio is raised until at most
    ``false_share`` of the ordinary tokens reach it."""
    logs = []
    for tokens in (randoms, ordinary):
        c = transitions(tokens)
        single = c.sum(axis=0) + smoothing
        logs.append(np.log((c + backing * single / single.sum()) / (c.sum(axis=1, keepdims=True) + backing)))
    model = MarkovModel(logs[0] - logs[1], **limits)
    totals = np.sort([total for mean, total in map(model.score, ordinary) if mean >= model.threshold])[::-1]
    allowed = int(false_share * len(ordinary))
    if len(totals) > allowed and totals[allowed] >= model.least_total:
        model = replace(model, least_total=float(totals[allowed]) + 1e-9)
    return model


def labelled_tokens(docs: DataFrame, *, bound: int = 4000, per_class: int = 20000, chars: int = 200_000) -> tuple[list[str], list[str]]:
    """Tokens of at most ``bound`` documents, labelled by the base patterns.

    What a base pattern marks as a value is a random string; words, snake-case identifiers and numbers outside the
    spans are ordinary. The documents are those with a base pattern whose hashes are smallest; only hashes are sorted;
    texts beyond ``chars`` characters are scanned but not learned from. At most ``per_class`` tokens of each class go
    to the driver.
    """
    texts = docs.where(F.length("text") <= chars).select("doc_id", "text")
    marked = texts.where(F.col("text").rlike(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}|(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]"))
    key = F.xxhash64("doc_id", "text", F.lit(7)).alias("key")
    keys = settle(marked.select(key).orderBy("key").limit(bound), "secrets-keys").distinct()
    drawn = texts.select("text", key).join(F.broadcast(keys), "key")  # ``bound`` numbers at most
    drawn = settle(drawn.groupBy("key").agg(F.first("text").alias("text")), "secrets-sample")

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                last = 0
                for s, e, kind in base_spans(text):
                    value = text[s:e]
                    if kind == "assign":
                        value = _assign.match(value)[2].replace(".", "")
                    if len(value) >= 8 and value.isascii():
                        rows.append((1, value))
                    rows += [(0, w) for w in _ident.findall(text[last:s])]
                    last = max(last, e)
                rows += [(0, w) for w in _ident.findall(text[last:])]
            yield pd.DataFrame(rows, columns=["secret", "token"]).drop_duplicates()

    out = settle(drawn.mapInPandas(gather, "secret int, token string").distinct(), "secrets-tokens")
    sides = []
    for label in (1, 0):
        rows = out.where(F.col("secret") == label).orderBy(F.xxhash64("token")).limit(per_class).collect()
        sides.append(sorted(r["token"] for r in rows))
    return sides[0], sides[1]


def train(docs: DataFrame, **bounds) -> MarkovModel:
    randoms, ordinary = labelled_tokens(docs, **bounds)
    return fit(randoms, ordinary)


def spans_of(text: str, model: MarkovModel, known: dict[str, bool] | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: the model adds runs of eight token characters or more outside base spans that
    look random; of a run that a base span cuts, what is left is judged. Runs below LONG_RUN characters are judged if
    they mix letters with digits or have capitals after small letters. ``known`` remembers judgements."""
    known = {} if known is None else known
    base = base_spans(text)
    more = []
    for m in _token.finditer(text):
        pieces, at = [], m.start()
        for s, e, _ in base:
            if s < m.end() and e > at:
                pieces.append((at, s))
                at = max(at, e)
        for s, e in [*pieces, (at, m.end())]:
            if e - s >= 8:
                token = text[s:e]
                verdict = known.get(token)
                if verdict is None:
                    known[token] = verdict = (e - s >= LONG_RUN or _mixed.search(token) is not None) and model.is_secret(token)
                if verdict:
                    more.append((s, e, "markov"))
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))) if more else base


def scan(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """Scan every whole text of ``docs`` (doc_id, text).

    Returns doc_id, base array<struct<kind, start, end>> and spans (the same of all spans, base ones included), both
    by start, then kind as listed; offsets are code points, ends exclusive. Null and empty texts have no spans;
    repeated rows and null ids give a row each; an empty table gives an empty table; other columns are ignored.
    """
    schema = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
    held = docs.sparkSession.sparkContext.broadcast(model)  # 69 x 69 numbers

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        shape = lambda spans: [{"kind": k, "start": s, "end": e} for s, e, k in spans]
        known: dict[str, bool] = {}
        for batch in batches:
            if len(known) > REMEMBERED:
                known.clear()
            found = [spans_of(t, m, known) if t else ([], []) for t in batch.column("text").to_pylist()]
            sides = [pa.array([shape(x[i]) for x in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sides], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of :func:`scan`'s rows."""
    joined = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
