"""Work counters, reject rates and stage times of a run."""
from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio

#: The stages that a report lists.
STAGES = ("parse_ingest", "seed_generation", "seed_sort", "candidate_grouping", "greedy_assignment", "filter_prefilter", "filter_gapped", "write_outputs", "total")


def reject_rates(counts: DataFrame) -> DataFrame:
    """Counters with the share that each filter rejects of what reaches it."""
    n, h, u, g = (F.col(c) for c in ("candidate_pairs_evaluated", "hamming_rejected", "ungapped_rejected", "gapped_rejected"))
    return counts.select("*", ratio(h, n).alias("hamming_rate"), ratio(u, n - h).alias("ungapped_rate"), ratio(g, n - h - u).alias("gapped_rate"))


class Profiler:
    """Times of named stages on the driver."""

    def __init__(self):
        self.times: dict[str, int] = {}

    @contextmanager
    def stage(self, name: str):
        t = time.perf_counter_ns()
        try:
            yield
        finally:
            self.times[name] = self.times.get(name, 0) + time.perf_counter_ns() - t

    def report(self, counts: DataFrame) -> dict:
        row = reject_rates(counts).first().asDict()
        rates = {k: row.pop(f"{k}_rate") for k in ("hamming", "ungapped", "gapped")}
        return {**row, "reject_rates": rates, "stage_timings_ns": dict(sorted(self.times.items())), "total_wall_clock_ns": self.times.get("total", sum(self.times.values()))}
