"""The batch run: load, filter in fixed order, mine detectors, run chains."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoset.config import Config, refuse_unsupported
from chronoset.operators import compare, detectors, filters, metrics, reports, sampling, subsample, transforms, tree
from chronoset.operators import windows as W
from chronoset.sources import readers
from chronoset.sources.scratch import settle
from chronoset.sources.studies import names_of


def preprocess(obs: DataFrame, samples: DataFrame, subjects: DataFrame, config: Config, edges: DataFrame | None = None, normalizers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """The filter chain; its order is fixed, whatever the order of settings. Returns (obs, samples, subjects, start, end).

    ``edges`` (node, parent, dist) is the tree of variables, on which observations are added up if that is asked for;
    ``normalizers`` (variable) are the variables of internal normalization.
    """
    obs, samples, subjects, start, end = first_steps(obs, samples, subjects, config, normalizers)
    obs, subjects = later_steps(obs, subjects, config, edges)
    return obs, samples, subjects, start, end


def first_steps(obs: DataFrame, samples: DataFrame, subjects: DataFrame, config: Config, normalizers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float, float]:
    """The filter chain up to relative abundances or internal normalization."""
    refuse_unsupported(config)
    p = config.preprocessing
    if p.min_overall_abundance:
        obs = filters.select_variables(obs, filters.high_overall_abundance(obs, p.min_overall_abundance))
    if p.min_sample_reads:
        deep = filters.deep_samples(obs, p.min_sample_reads).select("subject_id", "time")
        obs, samples = obs.join(deep, ["subject_id", "time"], "left_semi"), samples.join(deep, ["subject_id", "time"], "left_semi")
    start, end = samples.agg(F.min("time"), F.max("time")).first()
    if start is None:
        raise ValueError("no samples are left")
    if p.trim_start is not None and p.trim_stop is not None:
        start, end = p.trim_start, p.trim_stop
        obs, samples = filters.trim(obs, start, end), filters.trim(samples, start, end)
    if p.density_filter_n_samples:
        subjects = filters.select_subjects(subjects, filters.dense_subjects(subjects, samples, start, end, p.density_filter_n_intervals, p.density_filter_n_samples, p.density_filter_n_consecutive))
        obs, samples = filters.select_subjects(obs, subjects), filters.select_subjects(samples, subjects)
    if p.subsample_subjects is not None:
        there = subjects.count()
        if p.subsample_subjects > there:
            raise ValueError(f"{p.subsample_subjects} subjects are asked for, there are {there}")
        subjects = subsample.draw_subjects(subjects, p.subsample_subjects / max(there, 1), config.sampling.seed)
        obs, samples = filters.select_subjects(obs, subjects), filters.select_subjects(samples, subjects)
    if p.take_relative_abundance:
        obs = transforms.relative_abundance(obs)
    if p.do_internal_normalization:
        if normalizers is None:
            raise ValueError("internal normalization needs variables")
        floor = 1e-6 if p.internal_normalization_min_factor is None else p.internal_normalization_min_factor
        obs = transforms.internal_normalization(obs, tuple(names_of(normalizers, "variable")), floor)
    return obs, samples, subjects, float(start), float(end)


def temporal_filter(obs: DataFrame, config: Config) -> DataFrame:
    p = config.preprocessing
    if p.temporal_abundance_threshold is None:
        return obs
    kept = filters.persistent_variables(obs, p.temporal_abundance_threshold, p.temporal_abundance_consecutive_samples, p.temporal_abundance_n_subjects)
    return filters.select_variables(obs, kept)


def later_steps(obs: DataFrame, subjects: DataFrame, config: Config, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(obs, subjects) after aggregation, logarithms, the temporal filter, surplus nodes and shuffled labels."""
    p, paths = config.preprocessing, None
    if edges is not None:
        paths = settle(tree.closure(edges), "tree")
    if p.aggregate_on_phylogeny:
        if paths is None:
            raise ValueError("aggregation needs a tree")
        if config.data.data_type != "metaphlan":  # whose tables hold the sums of clades already
            obs = tree.aggregate(obs, edges, paths)
    if p.log_transform:
        obs = transforms.log_transform(obs)
    obs = temporal_filter(obs, config)
    if p.discard_surplus_internal_nodes and paths is not None:
        present = obs.select(F.col("variable").alias("node")).distinct()
        obs = obs.join(tree.surplus_nodes(edges, paths, present).select(F.col("node").alias("variable")), "variable", "left_anti")
    if p.randomize_labels:
        subjects = transforms.shuffled_labels(subjects, config.sampling.seed)
    if obs.isEmpty() or subjects.isEmpty():
        raise ValueError("all variables or all subjects were dropped")
    return obs, subjects


def normalizers(spark: SparkSession, config: Config) -> DataFrame | None:
    """(variable) of internal normalization: those of a file, or those that a placement table puts in a taxon."""
    d, p = config.data, config.preprocessing
    if not p.do_internal_normalization:
        return None
    if p.normalization_variables_file:
        return readers.variable_list(spark, p.normalization_variables_file)
    names = readers.fasta(spark, d.sequence_key) if d.sequence_key else None
    found = readers.variables_of_taxon(readers.placement_table(spark, d.placement_table, names), p.normalize_by_taxon).select("variable")
    if found.isEmpty():
        raise ValueError(f"no variables in taxon {p.normalize_by_taxon}")
    return found


def mine(obs: DataFrame, samples: DataFrame, subjects: DataFrame, start: float, end: float, config: Config) -> tuple[DataFrame, DataFrame]:
    """(values, detectors): detector values of subjects, and the numbered detector population."""
    m = config.model
    good = W.valid_windows(subjects, samples, W.windows_of(start, end, m.n_intervals, m.t_min, m.t_max)).collect()
    if not good:
        raise ValueError("no window holds samples of all subjects")
    wide = detectors.values(obs, [(r["t0"], r["t1"]) for r in good])
    long = settle(detectors.long_values(wide, [(r["t0"], r["t1"]) for r in good if r["slope_ok"]]), "detector-values")
    return long, detectors.ordered(detectors.population(long, detectors.clustered_thresholds(long, m.max_thresholds)))


def placed_tree(spark: SparkSession, path: str, obs: DataFrame) -> DataFrame:
    """(node, parent, dist): the tree of a jplace file with each placed and observed sequence attached to the node of
    its best placement, pruned to these."""
    document = readers.jplace(spark, path)
    edges = readers.tree_edges(document).where(F.col("parent") != "").select("node", "parent", "dist")
    best = tree.best_placements(readers.placements(document), tree.closure(edges))
    seen = obs.select(F.col("variable").alias("sequence")).distinct()
    hung = best.join(seen, "sequence", "left_semi").select(F.col("sequence").alias("node"), F.col("node").alias("parent"), F.col("pendant").alias("dist"))
    whole = edges.unionByName(hung)
    return tree.prune(whole, tree.closure(whole), hung.select("node"))


def weights(variables: DataFrame, edges: DataFrame | None) -> DataFrame:
    """(variable, weight): the length of a node's subtree, its own branch included; 1 without a tree or outside it."""
    if edges is None:
        return variables.select("variable", F.lit(1.0).alias("weight"))
    lengths = tree.subtree_lengths(edges, tree.closure(edges)).select(F.col("node").alias("variable"), F.col("length").alias("weight"))
    return variables.join(lengths, "variable", "left").select("variable", F.coalesce("weight", F.lit(1.0)).alias("weight"))


@dataclass(frozen=True)
class Run:
    """What a run has made: the study it kept, detector values, numbered detectors with weights, and chain states."""

    subjects: DataFrame
    samples: DataFrame
    observations: DataFrame
    edges: DataFrame | None
    start: float
    end: float
    values: DataFrame
    detectors: DataFrame
    states: DataFrame


def loaded(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(subjects, samples, observations, edges) of the files that the settings name."""
    d = config.data
    metaphlan = d.data_type == "metaphlan"
    abundance = readers.clade_table(spark, d.abundance_data) if metaphlan else readers.abundances(spark, d.abundance_data)
    if d.sequence_key and not metaphlan:
        abundance = readers.renamed(abundance, readers.fasta(spark, d.sequence_key))
    subjects, samples, obs = readers.combine(abundance, readers.sample_metadata(spark, d.sample_metadata), readers.subjects(spark, d.subject_data), d.outcome_variable, d.outcome_positive_value)
    edges = None
    if metaphlan:
        edges = readers.clade_edges(abundance)
    elif d.jplace_file and config.preprocessing.aggregate_on_phylogeny:
        edges = placed_tree(spark, d.jplace_file, obs)
    return subjects, samples, obs, edges


def execute(spark: SparkSession, config: Config) -> Run:
    """Load, filter, mine and sample as the settings say; settings that a run cannot act on raise ValueError first."""
    refuse_unsupported(config)
    subjects, samples, obs, edges = loaded(spark, config)
    edges = None if edges is None else settle(edges, "variable-tree")
    obs, samples, subjects, start, end = preprocess(obs, samples, subjects, config, edges, normalizers(spark, config))
    obs, subjects = settle(obs, "observations"), settle(subjects, "subjects")
    long, found = mine(obs, samples, subjects, start, end, config)
    found = settle(found.join(weights(found.select("variable").distinct(), edges), "variable"), "detectors")
    s = config.sampling
    states = sampling.run_chains(found, sampling.outcome_bits(subjects), chains=s.chains, iterations=s.total_samples, seed=s.seed, hyper=config.model.hyper())
    return Run(subjects, samples, obs, edges, start, end, long, found, settle(states, "chain-states"))


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Chain states for the files that the settings name."""
    return execute(spark, config).states


def summaries(made: Run, config: Config) -> dict[str, str]:
    """The texts that the settings ask for: quick, full and bayes."""
    p, m = config.postprocessing, config.model
    out = {}
    if not (p.quick_summary or p.full_summary):
        return out
    stored = reports.Stored.of(made.states, p.burnin_fraction, made.detectors, made.values, made.subjects)
    out["quick"] = reports.quick(stored, m.hyper())
    if p.full_summary:
        out["full"] = out["quick"] + "\n" + reports.cluster_table(stored)
        if p.bayes_factor_samples:
            out["bayes"] = reports.bayes(stored, m.hyper(), made.end - made.start, p.bayes_factor_samples, config.sampling.seed)
    return out


def benchmark(spark: SparkSession, config: Config, methods: tuple[str, ...] = ("random_forest", "l1_logistic"), **settings) -> dict[str, DataFrame]:
    """Metrics of the comparison methods at three places of the filter chain, and of the rule model at its end.

    The chain is run up to relative abundances, to which noise is added if the section ``benchmarking`` has a
    noise_parameter. The methods of ``comparison_methods`` (n_intervals, n_consecutive, n_folds) are cross-validated on
    these (step3), on what the temporal filter leaves of them (step4), and on the data that all later steps make
    (step5), which the rule model is cross-validated on too (step6), in n_folds of ``crossvalidation``, or one subject
    at a time if the section is ``leave_one_out``.
    """
    b, c = config.other.get("benchmarking", {}), config.other.get("comparison_methods", {})
    section = "crossvalidation" if "crossvalidation" in config.other else "leave_one_out"
    if section not in config.other or not c:
        raise ValueError("a benchmark needs comparison_methods, and crossvalidation or leave_one_out")
    cv, own = config.other[section], replace(config, other={})
    subjects, samples, obs, edges = loaded(spark, own)
    edges = None if edges is None else settle(edges, "variable-tree")
    obs, samples, subjects, start, end = first_steps(obs, samples, subjects, own, normalizers(spark, own))
    if "noise_parameter" in b:
        obs = transforms.dirichlet_noise(obs, float(b["noise_parameter"]), float(b["zero_threshold"]), config.sampling.seed)
    obs, subjects = settle(obs, "benchmark-observations"), settle(subjects, "benchmark-subjects")
    logged = transforms.log_transform(obs) if own.preprocessing.log_transform else obs
    last, people = later_steps(obs, subjects, own, edges)
    last, people = settle(last, "benchmark-last"), settle(people, "benchmark-people")
    n, width, folds = int(c["n_intervals"]), int(c.get("n_consecutive", 1)), None if c.get("cv_type") == "leave_one_out" else int(c.get("n_folds", 5))

    def compared(data: DataFrame, who: DataFrame) -> DataFrame:
        means = transforms.window_means(data, start, end, n, width)
        features = transforms.feature_vectors(means, n - width + 1, names_of(data, "variable"))
        return compare.comparison(features, who, methods=methods, folds=folds, **settings)

    out = {"step3": compared(logged, subjects), "step4": compared(temporal_filter(logged, own), subjects), "step5": compared(last, people)}
    long, found = mine(last, samples, people, start, end, own)
    of = settle(metrics.stratified_folds(people, int(cv["n_folds"])) if section == "crossvalidation" else metrics.leave_one_out(people), "benchmark-folds")
    n_folds = int(cv["n_folds"]) if section == "crossvalidation" else people.count()
    p = sampling.crossvalidate(long, of, weights(found.select("variable").distinct(), edges), n_folds=n_folds, most_thresholds=own.model.max_thresholds,
                               iterations=int(cv.get("total_samples", own.sampling.total_samples)), seed=own.sampling.seed, burn_in=float(cv.get("burnin_fraction", own.postprocessing.burnin_fraction)))
    scores = settle(p.select(F.lit("rules").alias("method"), "fold", "y", F.col("probability").alias("score")), "benchmark-scores")
    report = metrics.report(scores)
    return out | {"step6": report if section == "crossvalidation" else report.where(F.col("fold").isNull())}
