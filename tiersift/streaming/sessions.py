"""Sessions as a stream of updates: each is applied only to the history that its sender saw."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def applied(updates: DataFrame) -> DataFrame:
    """(id, seq, applied, history, summary) of a stream of updates (id, seq, seen, history, summary; histories as JSON).

    A session's state is its history and summary, at first none. An update whose ``seen`` is not the state's history
    changes nothing. Updates of a batch are taken in the order of seq; a key's state has one owner.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        history, summary = state.get if state.exists else ("[]", "")
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            same = json.loads(r.seen or "[]") == json.loads(history)
            if same:
                history, summary = r.history or "[]", r.summary or ""
            rows.append((key[0], r.seq, same, history, summary))
        state.update((history, summary))
        yield pd.DataFrame(rows, columns=["id", "seq", "applied", "history", "summary"])

    return updates.groupBy("id").applyInPandasWithState(run, "id string, seq long, applied boolean, history string, summary string", "history string, summary string", "append", "NoTimeout")
