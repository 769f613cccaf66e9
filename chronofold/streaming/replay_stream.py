"""Replay of a stream of operations: claims as keyed state per lineage, changed claims per batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import FIELDS, apply, plain
from ..session import ship
from ..sources import schemas

#: The state store that keyed state needs; set it before a stream is started.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_OPS = ", ".join(x for x in schemas.OPLOG.split(", ") if not x.startswith("extra"))
_NAMES = [x.split()[0] for x in _OPS.split(", ")]


class _Layer(dict):
    """Claims that a run of operations reads or changes, each fetched from below when first asked for."""

    def __init__(self, below: Callable[[str], dict | None]):
        super().__init__()
        self.below = below

    def get(self, name: str | None, default: dict | None = None) -> dict | None:
        if name is not None and not super().__contains__(name):
            found = self.below(name)
            if found is not None:
                self[name] = dict(found)
        return super().get(name, default)


class _Replay(StatefulProcessor):
    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "name string", schemas.CLAIMS)
        self.waiting = handle.getMapState("waiting", "at long", _OPS)
        self.done = handle.getValueState("done", "seq long, top long")

    def _stored(self, name: str) -> dict | None:
        return dict(zip(FIELDS, map(plain, self.claims.getValue((name,))), strict=True)) if self.claims.containsKey((name,)) else None

    def _over(self, below: Callable[[str], dict | None], ops: list[dict]) -> _Layer:
        out = _Layer(below)
        for op in ops:
            apply(out, op)
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, top = self.done.get() if self.done.exists() else (-1, -1)
        known = {k[0]: dict(zip(_NAMES, map(plain, v), strict=True)) for k, v in self.waiting.iterator()}
        ops = dict(known)
        for part in rows:
            for row in part[_NAMES].to_dict("records"):
                op = {n: plain(x) for n, x in row.items()}
                if op["seq"] <= seq:
                    raise ValueError(f"operation {op['seq']} of lineage {key[0]} comes more than {self.wait} places late: replay the log as a batch, or start anew with a longer wait")
                ops.setdefault(int(op["seq"]), op)
        top = max(top, *ops)
        before = self._over(self._stored, [known[k] for k in sorted(known)])
        base = self._over(self._stored, [ops[k] for k in sorted(ops) if k <= top - self.wait])
        after = self._over(lambda name: base.get(name), [ops[k] for k in sorted(ops) if k > top - self.wait])
        changed = [c for name, c in ({**base, **after}).items() if c != before.get(name)]
        for name, claim in base.items():
            self.claims.updateValue((name,), tuple(claim[f] for f in FIELDS))
        for k, op in ops.items():
            if k > top - self.wait and k not in known:
                self.waiting.updateValue((k,), tuple(op[n] for n in _NAMES))
            elif k <= top - self.wait and k in known:
                self.waiting.removeKey((k,))
        self.done.update((max(seq, top - self.wait), top))
        if changed:
            yield pd.DataFrame(changed, columns=FIELDS).astype({"hits": "int64", "birth_seq": "int64"})

    def close(self) -> None:
        pass


def replay_stream(log: DataFrame, wait: int = 1000) -> DataFrame:
    """The claims (schema CLAIMS) that a batch changes, as they are then.

    The state of a lineage is its claims, by id, after all operations but those of its last `wait` places in the
    log, which wait in seq order for what comes late. A batch reads and writes only the claims that its own and the
    waiting operations name, so its work doesn't grow with what came before. Results equal a batch replay of
    everything seen. A row that repeats a waiting seq counts once; one that comes later than the wait ends the
    stream with an error, since nothing may be lost. Rows without a lineage are left out. Needs the store of STORE.
    """
    ship(log.sparkSession)
    rows = log.where("lineage_id IS NOT NULL").select(*_NAMES)
    return rows.groupBy("lineage_id").transformWithStateInPandas(_Replay(wait), schemas.CLAIMS, "update", "none")


def append_stream(log: DataFrame, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands each micro-batch, ordered by seq, to sink (idempotent per batch id)."""
    return log.writeStream.foreachBatch(lambda df, batch: sink(df.orderBy(F.asc("seq")), batch))
