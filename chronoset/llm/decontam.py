"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoset.llm.common import row_key, settle, small

#: A word, with A-Z as letters; they are lowered word by word afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lowered, all other characters as they are; null has none."""
    found = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(found, lambda w: F.when(F.lower(w) == w, w).otherwise(F.translate(w, UPPER, LOWER)))


def _beside(left: str, right: str, shift: int, join) -> Column:
    """join(left[i], right[i + shift]) for all i for which both exist."""
    n = F.greatest(F.least(F.size(left), F.size(right) - F.lit(shift)), F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), join)


def with_grams(df: DataFrame, length: int) -> DataFrame:
    """Adds g<length>, the hashes of all runs of ``length`` words, from g1; shorter runs are built on the way.

    Each step is a projection of its own, so that no step is evaluated twice.
    """
    name = f"g{length}"
    if name in df.columns:
        return df
    half = 1 << ((length - 1).bit_length() - 1)
    df = with_grams(with_grams(df, half), length - half)
    return df.withColumn(name, _beside(f"g{half}", f"g{length - half}", half, lambda a, b: F.xxhash64(a, b)))


def with_fingerprints(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds fp, the distinct minima of g<k> over every ``window`` consecutive grams (none if there are fewer)."""
    df = with_grams(df, k).withColumn("least1", F.col(f"g{k}"))
    span = 1
    while span < window:
        step = min(span, window - span)
        df = df.withColumn(f"least{span + step}", _beside(f"least{span}", f"least{span}", step, lambda a, b: F.least(a, b)))
        span += step
    return df.withColumn("fp", F.array_distinct(F.col(f"least{span}")))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def benchmark_windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(length, hash, gram, items): every distinct window of the benchmark with the ids of its items as strings."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    runs = F.expr(f"transform(sequence(0, greatest(size(words) - {length}, 0)), i -> slice(words, i + 1, least(size(words), {length})))")
    runs = items.select("item", F.explode(runs).alias("gram"))
    return runs.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.size("gram").alias("length"), "gram", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, length: int = 10, k: int = 8) -> DataFrame:
    """Find the words of ``docs`` (doc_id, text) inside occurrences of windows of ``benchmark`` (item_id, text).

    A window is ``length`` consecutive words of an item, or all words of a shorter item. Winnowing keeps the least
    hash of k words over every ``length - k + 1`` consecutive ones, so two texts that share ``length`` words share a
    fingerprint. Documents with a common fingerprint have all their windows compared, first by hash, then word for
    word. Windows of short items are compared by the hash of the whole window.

    Returns row (a key of doc_id and text), doc_id, n_words, n_hit, n_items, items (sorted array of ids as strings), spans (array of struct<first,
    last> of word positions from 0, last exclusive), contaminated: a row for each input row.

    Null and empty texts have no words; null and repeated doc_ids give a row each; rows with the same id and text
    share their result; items without words have no windows, and a null item_id counts for hits, not for items. Empty
    tables give no rows or no hits. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))
    windows = benchmark_windows(benchmark, length).withColumn("g1", _hashed(F.col("gram")))
    windows = settle(windows, "windows")
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most ``length`` numbers
    marks, table = [], []
    for n in lengths:
        some = with_grams(windows.where(F.col("length") == n), n)
        table.append(some.select("length", F.element_at(f"g{n}", 1).alias("hash"), "gram", "items"))
        if n < length:
            marks.append(some.select(F.element_at(f"g{n}", 1).alias("mark")))
    if length in lengths:
        some = with_fingerprints(windows.where(F.col("length") == length), k, length - k + 1)
        # written first: else a filter on the exploded array repeats all steps that led to it
        marks.append(settle(some.select("fp"), "window-fingerprints").select(F.explode("fp").alias("mark")))
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    if not lengths:
        none = rows.select("row", "doc_id", count.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
        return none.withColumn("contaminated", F.lit(False))
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    table, marks = settle(union(table), "window-hashes"), settle(union(marks).distinct(), "marks")

    # one scan gives the number of words of every document and the fingerprints shared with the benchmark
    hashed = rows.select("row", "doc_id", _hashed(words_of(F.col("text"))).alias("g1"))
    sides = [n for n in lengths if n < length]
    if length in lengths:
        hashed = with_fingerprints(hashed, k, length - k + 1)
    for n in sides:
        hashed = with_grams(hashed, n)
    every = F.concat(F.array(F.lit(0).cast("long")), *([F.col("fp")] if length in lengths else []), *[F.col(f"g{n}") for n in sides])
    scanned = hashed.select("row", "doc_id", F.size("g1").cast("long").alias("n_words"), F.posexplode(every).alias("place", "mark"))
    scanned = scanned.join(small(marks.withColumn("shared", F.lit(True))), "mark", "left").where((F.col("place") == 0) | F.col("shared"))
    scanned = settle(scanned.select("row", "doc_id", "n_words", "place", (F.col("place") > 0).alias("shared")), "scanned")
    suspects = settle(scanned.where("shared").select("row").distinct(), "suspects")

    # all windows of those documents
    near = rows.join(small(suspects), "row", "left_semi").select("row", words_of(F.col("text")).alias("words"))
    near = settle(near, "suspect-words")
    grams = near.withColumn("g1", _hashed(F.col("words")))
    for n in lengths:
        grams = with_grams(grams, n)
    placed = lambda n: F.transform(f"g{n}", lambda h, i: F.struct(h.alias("hash"), i.alias("at"), F.lit(n).alias("length")))
    places = F.flatten(F.array(*[placed(n) for n in lengths]))
    places = grams.select("row", F.explode(places).alias("p")).select("row", "p.hash", "p.at", "p.length")
    met = places.join(small(table), ["hash", "length"]).select("row", "at", "length", "gram", "items")
    hits = met.join(near, "row").where(F.slice("words", F.col("at") + 1, F.col("length")) == F.col("gram")).select("row", "at", "length", "items")
    per_row = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("last")))).alias("runs"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_row = settle(per_row.select("row", "items", _merged("runs").alias("spans")), "hits")

    out = scanned.where("place = 0").select("row", "doc_id", "n_words").join(small(per_row), "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<first:int,last:int>>"))
    out = out.select("row", "doc_id", "n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["last"] - x["first"]))
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "spans", (F.size("spans") > 0).alias("contaminated"))


def _merged(runs: str) -> Column:
    """Sorted runs joined where they touch or overlap."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def add(done: Column, run: Column) -> Column:
        tail = F.element_at(done, -1)
        joined = F.struct(tail["first"].alias("first"), F.greatest(tail["last"], run["last"]).alias("last"))
        apart = F.concat(done, F.array(F.struct(run["first"].alias("first"), run["last"].alias("last"))))
        return F.when(F.size(done) == 0, apart).when(run["first"] > tail["last"], apart).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))

    return F.aggregate(runs, empty, add)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of :func:`decontaminate`'s rows."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
