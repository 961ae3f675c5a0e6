"""The LRU replay over a stream of accesses, with each shard's cache as its state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quiverlake.operators.cache import SLOTS, touch

OUTPUT = "event_id bigint, shard int, cluster_id int, op string, hit boolean, evicted int, priority int"


def replay_stream(log: DataFrame, slots: int = SLOTS) -> DataFrame:
    """What operators.cache.replay gives, for a streaming log whose batches come in order of time.

    The state of a shard is its resident clusters, `slots` of them at most.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cache = OrderedDict.fromkeys(state.get[0]) if state.exists else OrderedDict()
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])  # one micro-batch of one shard
        out = [(e, key[0], k, op, *touch(cache, k, slots)) for e, k, op in zip(rows.event_id, rows.cluster_id, rows.op, strict=True)]
        state.update((list(cache),))
        yield pd.DataFrame(out, columns=["event_id", "shard", "cluster_id", "op", "hit", "evicted", "priority"]).astype({"evicted": "Int32"})

    return log.groupBy("shard").applyInPandasWithState(run, OUTPUT, "resident array<int>", "append", GroupStateTimeout.NoTimeout)
