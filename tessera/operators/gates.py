"""Gates of a job's archive: whether its direct runs, its periodic catalog and its continuations were carried out in full.

runs: job_id, kind (direct or periodic), status, has_endpoint, requested, consumed. catalog: job_id, runtime_complete,
family_complete, selected, continuation_complete, settled. families: job_id, family, cells_complete, audited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Continuations of a job at most, and the states in which a periodic run counts as settled.
CONTINUATIONS = 8
SETTLED = ["completed", "evaluation-cap"]


def archive_gates(runs: DataFrame, catalog: DataFrame, families: DataFrame, most: int = CONTINUATIONS) -> DataFrame:
    """(job_id, catalog_valid, selection_valid, experiment_valid, production_valid) of each job of catalog.

    A job without runs of a kind passes what is asked of each of them; one without families needs no selection.
    """
    c = F.col
    direct, done = c("kind") == "direct", c("status") == "completed"
    every = lambda name, ok: F.coalesce(F.bool_and(ok), F.lit(True)).alias(name)
    of_runs = runs.groupBy("job_id").agg(
        every("direct_spent", ~direct | (done & F.coalesce(c("requested") == c("consumed"), F.lit(False)))),
        every("direct_ended", ~direct | (done & c("has_endpoint"))),
        every("periodic_settled", direct | c("status").isin(SETTLED)),
        F.count_if(~direct).alias("periodic_runs"),
    )
    of_families = families.groupBy("job_id").agg(F.count(F.lit(1)).alias("families"), every("families_covered", c("cells_complete") | c("audited")))
    j = catalog.join(of_runs, "job_id", "left").join(of_families, "job_id", "left")
    j = j.fillna(0, ["periodic_runs", "families"]).fillna(True, ["direct_spent", "direct_ended", "periodic_settled", "families_covered"])
    in_full = c("runtime_complete") & ((c("families") > 0) | c("family_complete")) & c("families_covered")
    chosen = c("runtime_complete") & c("settled") & (c("selected") <= most) & (c("periodic_runs") == c("selected")) & (c("continuation_complete") | (c("selected") == most))
    j = j.withColumns({"catalog_valid": in_full, "selection_valid": chosen})
    experiment = c("selection_valid") & c("direct_spent") & c("periodic_settled")
    production = c("direct_ended") & c("catalog_valid") & ((c("families") == 0) | c("selection_valid")) & c("periodic_settled")
    return j.select("job_id", "catalog_valid", "selection_valid", experiment.alias("experiment_valid"), production.alias("production_valid"))
