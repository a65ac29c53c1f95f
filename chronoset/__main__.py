"""python -m chronoset run CONFIG OUT [EXAMPLES FOLDER] | rhat OUT FILE... | subsample STUDY OUT SUBJECTS POINTS SEED
    | benchmark CONFIG OUT

run writes the chain states to OUT/states and the summaries that the settings ask for to OUT/summaries; EXAMPLES names the
settings of example bundles, FOLDER the folder that holds them. subsample reads the Parquet tables subjects and samples of
STUDY and writes a grid of nested subsamples; SUBJECTS and POINTS are numbers, separated by commas.
benchmark writes the metrics of each step as CSV.
"""

from __future__ import annotations

import sys
from pathlib import Path

from chronoset.config import read_config, read_examples, with_example
from chronoset.operators import subsample
from chronoset.operators.metrics import split_rhat
from chronoset.plans import workflow
from chronoset.session import session
from chronoset.sources import sinks
from chronoset.sources.readers import traces


def main(args: list[str]) -> int:
    if len(args) in (3, 5) and args[0] == "run":
        config = read_config(Path(args[1]).read_text())
        if len(args) == 5:
            config = with_example(config, read_examples(Path(args[3]).read_text(), args[4]))
        made = workflow.execute(session(), config)
        made.states.write.mode("overwrite").parquet(f"{args[2]}/states")
        sinks.write_texts(made.states.sparkSession, workflow.summaries(made, config), f"{args[2]}/summaries")
        return 0
    if len(args) == 3 and args[0] == "benchmark":
        for step, table in workflow.benchmark(session(), read_config(Path(args[1]).read_text())).items():
            table.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args[2]}/{step}")  # a row a method and fold
        return 0
    if len(args) == 6 and args[0] == "subsample":
        study = sinks.read_study(session(), args[1], ["subjects", "samples"])
        sizes = [[int(n) for n in a.split(",")] for a in args[3:5]]
        subsample.grid(study["subjects"], study["samples"], *sizes, seed=int(args[5])).write.mode("overwrite").parquet(args[2])
        return 0
    if len(args) >= 3 and args[0] == "rhat":
        split_rhat(traces(session(), args[2:])).write.mode("overwrite").option("header", True).csv(args[1])
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
