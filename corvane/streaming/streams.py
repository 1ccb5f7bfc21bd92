"""Streams of event lines and of trainer lines."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.curves import parse_metric_lines
from corvane.operators.history import log_level, route_event, step_title

STOPS = "trial string, seq long, rule string, best double"
STATE = "last double, best double, first_gap double, previous_gap double, train double, evals long, stopped boolean"


def routed_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """A stream (or table) of lines with route, level and step title."""
    return lines.select("*", route_event(line).alias("route"), log_level(line).alias("level"), step_title(line).alias("title"))


def early_stop_stream(lines: DataFrame) -> DataFrame:
    """Stops of a stream of trainer lines (trial, seq, line, cross_trial_best), one row per trial that stops.

    State per trial: last and best evaluation loss, first and previous gap, last training loss. Lines are taken in the
    order of seq inside a batch; after a stop further lines are ignored.
    """
    best_elsewhere = F.col("cross_trial_best").cast("double") if "cross_trial_best" in lines.columns else F.lit(None).cast("double")
    typed = lines.select(F.col("trial").cast("string").alias("trial"), F.col("seq").cast("long").alias("seq"), best_elsewhere.alias("cross_trial_best"), "line")
    parsed = parse_metric_lines(typed, "cross_trial_best")

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, best, first, previous, train, evals, stopped = state.get if state.exists else (None, None, None, None, None, 0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if stopped:
                break
            train = r.loss if pd.notna(r.loss) else train
            if pd.isna(r.eval_loss) or r.eval_loss == last:
                continue
            last, evals = float(r.eval_loss), evals + 1
            best = last if best is None else min(best, last)
            gap = None if train is None else last - train
            rule = None
            if gap is not None and first is not None and previous is not None and evals >= 2 and gap > previous and gap > first:
                rule = "divergence"
            elif pd.notna(r.cross_trial_best) and best > r.cross_trial_best:
                rule = "cross_trial"
            first, previous = gap if first is None else first, gap
            if rule:
                stopped = True
                out.append((key[0], int(r.seq), rule, best))
        state.update((last, best, first, previous, None if train is None else float(train), evals, stopped))
        yield pd.DataFrame(out, columns=["trial", "seq", "rule", "best"])

    return parsed.groupBy("trial").applyInPandasWithState(step, STOPS, STATE, "append", GroupStateTimeout.NoTimeout)

