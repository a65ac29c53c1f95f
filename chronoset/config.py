"""Settings of a run, read from an INI file; unknown keys are errors."""

from __future__ import annotations

from configparser import ConfigParser
from dataclasses import dataclass, field, fields, replace

from chronoset.functions.model import Hyper


@dataclass
class General:
    verbose: bool = False


@dataclass
class Description:
    tag: str = ""


@dataclass
class Data:
    load_example: str = ""
    data_type: str = "16s"
    abundance_data: str = ""
    sample_metadata: str = ""
    subject_data: str = ""
    sequence_key: str = ""
    jplace_file: str = ""
    outcome_variable: str = ""
    outcome_positive_value: str = ""
    taxonomy_source: str = ""
    pplacer_taxa_table: str = ""
    pplacer_seq_info: str = ""
    placement_table: str = ""
    additional_subject_covariates: str = ""
    additional_covariate_default_states: str = ""
    additional_subject_continuous_covariates: str = ""


@dataclass
class Preprocessing:
    min_overall_abundance: float = 0.0
    min_sample_reads: float = 0.0
    trim_start: float | None = None
    trim_stop: float | None = None
    density_filter_n_samples: int = 0
    density_filter_n_intervals: int = 1
    density_filter_n_consecutive: int = 1
    subsample_subjects: int | None = None
    take_relative_abundance: bool = False
    do_internal_normalization: bool = False
    internal_normalization_min_factor: float | None = None
    normalization_variables_file: str = ""
    normalize_by_taxon: str = ""
    aggregate_on_phylogeny: bool = False
    log_transform: bool = False
    temporal_abundance_threshold: float | None = None
    temporal_abundance_consecutive_samples: int = 2
    temporal_abundance_n_subjects: int = 1
    discard_surplus_internal_nodes: bool = False
    randomize_labels: bool = False
    pickle_dataset: bool = False


@dataclass
class Model:
    n_intervals: int = 10
    t_min: float = 0.0
    t_max: float = float("inf")
    max_thresholds: int = 20
    max_rules: int = 10
    max_primitives: int = 10
    hyperparameter_alpha_m: float = Hyper.alpha_m
    hyperparameter_beta_m: float = Hyper.beta_m
    hyperparameter_alpha_primitives: float = Hyper.alpha_primitives
    hyperparameter_beta_primitives: float = Hyper.beta_primitives
    hyperparameter_a_empty: float = Hyper.a_empty
    hyperparameter_b_empty: float = Hyper.b_empty
    window_concentration_typical: float = Hyper.concentration_typical
    window_concentration_update_ratio: float = Hyper.concentration_ratio
    window_fraction_proposal_std: float = Hyper.fraction_std
    delta_l_scale_mean: float = Hyper.mean_scale
    delta_l_scale_sigma: float = Hyper.std_scale
    lambda_l_offset: float = Hyper.offset
    pickle_model: bool = False

    def hyper(self) -> Hyper:
        """The hyperparameters of the model that these settings ask for."""
        return Hyper(alpha_m=self.hyperparameter_alpha_m, beta_m=self.hyperparameter_beta_m, alpha_primitives=self.hyperparameter_alpha_primitives, beta_primitives=self.hyperparameter_beta_primitives,
                     a_empty=self.hyperparameter_a_empty, b_empty=self.hyperparameter_b_empty, concentration_typical=self.window_concentration_typical, concentration_ratio=self.window_concentration_update_ratio,
                     fraction_std=self.window_fraction_proposal_std, mean_scale=self.delta_l_scale_mean, std_scale=self.delta_l_scale_sigma, offset=self.lambda_l_offset, max_rules=self.max_rules, max_primitives=self.max_primitives)


@dataclass
class Sampling:
    total_samples: int = 300
    chains: int = 4
    seed: int = 1


@dataclass
class Postprocessing:
    burnin_fraction: float = 0.05
    bayes_factor_samples: int = 10000
    quick_summary: bool = False
    full_summary: bool = False
    gui_output: bool = False


@dataclass
class Config:
    """Typed settings by section. ``other`` holds sections of runs that are started by calls of the library, not by
    ``run``: replicates, crossvalidation, leave_one_out, comparison_methods, simulated_data and benchmarking."""

    general: General = field(default_factory=General)
    description: Description = field(default_factory=Description)
    data: Data = field(default_factory=Data)
    preprocessing: Preprocessing = field(default_factory=Preprocessing)
    model: Model = field(default_factory=Model)
    sampling: Sampling = field(default_factory=Sampling)
    postprocessing: Postprocessing = field(default_factory=Postprocessing)
    other: dict[str, dict[str, str]] = field(default_factory=dict)


OTHER = ("replicates", "crossvalidation", "leave_one_out", "comparison_methods", "simulated_data", "benchmarking")


def _typed(kind: str, text: str):
    if "bool" in kind:
        return text.strip().lower() in ("1", "true", "yes", "on")
    if "int" in kind:
        return int(float(text))
    return float(text) if "float" in kind else text


def read_config(text: str) -> Config:
    """Typed settings; a section or key that is not known raises KeyError. Comments may follow a ';' after a blank."""
    parser = ConfigParser(inline_comment_prefixes=(";",))
    parser.read_string(text)
    out = Config()
    for name in parser.sections():
        if name in OTHER:
            out.other[name] = dict(parser[name])
            continue
        section = getattr(out, name, None)
        if section is None or name == "other":
            raise KeyError(f"unknown section {name}")
        kinds = {f.name: str(f.type) for f in fields(section)}
        for key, value in parser[name].items():
            if key not in kinds:
                raise KeyError(f"unknown key {key} in section {name}")
            setattr(section, key, _typed(kinds[key], value))
    return out


def read_examples(text: str, folder: str) -> dict[str, tuple[str, Data]]:
    """(tag, data settings) of each named example bundle; ``$DIR`` stands for the bundle's own folder in ``folder``."""
    parser = ConfigParser(inline_comment_prefixes=(";",))
    parser.read_string(text)
    kinds = {f.name: str(f.type) for f in fields(Data)}
    out = {}
    for name in parser.sections():
        values = {k: v.replace("$DIR", f"{folder.rstrip('/')}/{name}") for k, v in parser[name].items()}
        tag = values.pop("tag", name)
        if unknown := sorted(set(values) - set(kinds)):
            raise KeyError(f"unknown key {unknown[0]} in example {name}")
        out[name] = (tag, Data(**{k: _typed(kinds[k], v) for k, v in values.items()}))
    return out


def with_example(config: Config, examples: dict[str, tuple[str, Data]]) -> Config:
    """The settings with what the example that they name says; keys they set themselves stay.

    An example that is not known raises KeyError.
    """
    name = config.data.load_example
    if not name:
        return config
    if name not in examples:
        raise KeyError(f"unknown example {name}")
    tag, held = examples[name]
    blank = Data()
    own = {f.name: v for f in fields(Data) if (v := getattr(config.data, f.name)) != getattr(blank, f.name)}
    return replace(config, data=replace(held, **own), description=replace(config.description, tag=config.description.tag or tag))


def refuse_unsupported(config: Config) -> None:
    """Settings that would change a run's result but are not acted on raise ValueError, before anything is read."""
    d, p = config.data, config.preprocessing
    asked = [k for k in ("additional_subject_covariates", "additional_covariate_default_states", "additional_subject_continuous_covariates") if getattr(d, k)]
    asked += [s for s in config.other if s in OTHER]
    if asked:
        raise ValueError(f"a run does not act on {', '.join(asked)}")
    if p.take_relative_abundance and p.do_internal_normalization:
        raise ValueError("relative abundance and internal normalization exclude each other")
    if p.do_internal_normalization and bool(p.normalization_variables_file) == bool(p.normalize_by_taxon):
        raise ValueError("internal normalization needs either a file of variables or a taxon")
    if p.normalize_by_taxon and not d.placement_table:
        raise ValueError("normalization by taxon needs a placement table")
    if d.data_type not in ("16s", "metaphlan"):
        raise ValueError(f"unknown data type {d.data_type}")
    if d.load_example and not d.abundance_data:
        raise ValueError(f"example {d.load_example} is not expanded: give its settings to with_example")
