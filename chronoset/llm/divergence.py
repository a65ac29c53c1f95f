"""Source divergence audit: term counts by Arrow compute kernels, divergences of sources from merged columnar shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoset.llm.common import lean, settle, small
from chronoset.llm.words import portions

#: What stands between terms: all of ASCII but letters. A term is a run of anything else.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
KEYS = ["lang", "source", "term"]
#: Rows of partial counts that a task holds before it hands them on.
HELD_ROWS = 300_000
UNIT, PRIOR = 1_000_000_000, 5


def count_portion(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.Table:
    """(lang, source, term, n, n_docs) of some documents; a row without a term stands for each (lang, source) there."""
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    group = pc.add(pc.multiply(lang.indices.cast(pa.int64()), max(len(source.dictionary), 1)), source.indices.cast(pa.int64()))
    words = pc.split_pattern_regex(pc.ascii_lower(text), pattern=SEPARATORS)
    term, doc = pc.list_flatten(words), pc.list_parent_indices(words)
    there = pc.greater(pc.binary_length(term), 0)  # texts that begin or end with a separator give empty pieces
    term, doc = term.filter(there).dictionary_encode(), doc.filter(there)
    in_doc = pa.table({"doc": doc, "code": term.indices}).group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    by_group = pa.table({"group": group.take(in_doc["doc"]), "code": in_doc["code"], "n": in_doc["count_all"]})
    counted = by_group.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    seen = pc.unique(group)
    groups = pa.concat_arrays([counted["group"].combine_chunks(), seen]) if counted.num_rows else seen
    lang_code = pc.divide(groups, max(len(source.dictionary), 1))
    source_code = pc.subtract(groups, pc.multiply(lang_code, max(len(source.dictionary), 1)))
    names = term.dictionary.take(counted["code"].combine_chunks()) if counted.num_rows else pa.array([], pa.string())
    zeros = pa.array(np.zeros(len(seen), np.int64))
    number = lambda c: pa.concat_arrays([counted[c].combine_chunks().cast(pa.int64()), zeros]) if counted.num_rows else zeros
    return pa.table({"lang": lang.dictionary.take(lang_code), "source": source.dictionary.take(source_code),
                     "term": pa.concat_arrays([names, pa.nulls(len(seen), pa.string())]), "n": number("n_sum"), "n_docs": number("n_count")})


def merge_counts(tables: list[pa.Table]) -> pa.Table:
    merged = pa.concat_tables(tables).group_by(KEYS, use_threads=False).aggregate([("n", "sum"), ("n_docs", "sum")])
    return merged.select([*KEYS, "n_sum", "n_docs_sum"]).rename_columns([*KEYS, "n", "n_docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term and documents that hold it, by language and source.

    Each occurring (lang, source) also has a row whose term is null. Tasks count with Arrow's kernels and hand on
    partial counts, bounded portion by bounded portion, which Spark sums before and after the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for start, end in portions(pc.utf8_length(batch.column("text")).to_pylist(), sizes=True, most_chars=1_000_000):
                held.append(count_portion(*[batch.column(c).slice(start, end - start) for c in ("lang", "source", "text")]))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    held = [merge_counts(held)]
                    if held[0].num_rows > HELD_ROWS // 2:
                        yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from merge_counts(held).to_batches(max_chunksize=50_000)

    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = read.mapInArrow(lean(count), "lang string, source string, term string, n long, n_docs long")
    return partial.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def share(count: Column, total: Column, kept_terms: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept_terms)), exact for counts of any size."""
    whole = lambda c: c.cast("decimal(24,0)")
    above = (whole(count + F.lit(PRIOR)) * F.lit(UNIT).cast("decimal(10,0)")).alias("above")
    below = whole(total + F.lit(PRIOR) * kept_terms)
    return F.lit(1) + F.call_function("div", above, below)


def audit(docs: DataFrame, *, least_docs: int = 30, top_terms: int = 50, shard_terms: int = 8192, source_block: int = 128) -> DataFrame:
    """Divergences of the sources of each language: (lang, source, part, item, value, rank).

    A language keeps the terms that at least ``least_docs`` of its documents hold. ``share`` gives each kept term a
    probability, in units of a billionth, in each (lang, source) and in each lang. Part ``pair`` ranks the other
    sources of the language by the summed absolute differences of probabilities over all kept terms; part ``term``
    ranks, up to ``top_terms``, the terms that the source has more often than its language.

    Counts of kept terms are cut into shards of about ``shard_terms`` terms and blocks of about ``source_block``
    sources. A shard of two blocks is one bounded matrix in one task; sums over shards give the value of a pair, and
    terms that neither block has add the same difference each, which needs no row of its own.

    Nulls in text, lang or source count as empty strings; repeated rows are documents of their own; empty and very
    long texts are counted whole; a language without kept terms has pairs of value 0 and no terms; an empty table gives
    no rows; other columns are ignored.
    """
    counts = settle(term_counts(docs), "term-counts")
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    kept = settle(kept.where(F.col("n_docs") >= least_docs).drop("n_docs"), "kept-terms")
    used = settle(counts.join(kept, ["lang", "term"]).drop("n_docs"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").distinct()
    sources = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"))
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").join(sources, "lang")
    groups = groups.fillna(0, ["n_terms", "lang_total", "total"])
    unseen = F.when(F.col("n_terms") > 0, share(F.lit(0), F.col("total"), F.col("n_terms"))).otherwise(0).cast("long")
    blocks = F.ceil(F.col("n_sources") / source_block)
    groups = groups.withColumn("unseen", unseen).withColumn("n_blocks", blocks).withColumn("n_shards", F.greatest(F.ceil(F.col("n_terms") / shard_terms), F.lit(1)))
    groups = settle(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks"))), "audit-groups")

    placed = used.join(small(groups), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("n_terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    placed = placed.withColumn("p", p.cast("long")).withColumn("q", q.cast("long"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = placed.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_terms)

    met = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1), lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))))
    columns = ["lang", "shard", "m.i", "m.j", "source", "block", "term", "p"]
    cells = placed.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("n_shards"))).withColumn("m", met).select(*columns)
    every = groups.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_shards") - 1))).withColumn("m", met)
    every = every.withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("unseen")).select(*columns)

    def differences(rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows[rows["term"].isna()]
        names, unseen, block = heads["source"].to_numpy(), heads["p"].to_numpy(np.int64), heads["block"].to_numpy()
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        cells = rows[rows["term"].notna()]
        code, terms = pd.factorize(cells["term"])
        shares = np.repeat(unseen[:, None], len(terms), axis=1)
        place = pd.Series(np.arange(len(names)), index=names)
        shares[place[cells["source"]].to_numpy(np.int64), code] = cells["p"].to_numpy(np.int64)
        right = np.nonzero(block == j)[0]
        found = []
        for a in np.nonzero(block == i)[0]:
            others = right[right > a] if i == j else right
            found.append((np.full(len(others), a), others, np.abs(shares[others] - shares[a]).sum(axis=1) - len(terms) * np.abs(unseen[others] - unseen[a])))
        a, b, more = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        out = {"lang": rows["lang"].iloc[0], "source": np.concatenate([names[a], names[b]]), "item": np.concatenate([names[b], names[a]])}
        return pd.DataFrame(out | {"more": np.concatenate([more, more]).astype(np.int64), "gap": np.tile(np.abs(unseen[a] - unseen[b]), 2)})

    found = cells.unionByName(every).groupBy("lang", "shard", "i", "j").applyInPandas(differences, "lang string, source string, item string, more long, gap long")
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("more").alias("more"), F.first("gap").alias("gap"))
    pairs = pairs.join(small(settle(langs, "audit-langs")), "lang", "left")
    value = F.col("more") + F.coalesce("n_terms", F.lit(0)) * F.col("gap")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms).withColumn("rank", F.col("rank").cast("int"))
