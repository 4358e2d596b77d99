"""Driver loop support for iterative graph jobs.

Each step's DataFrame is persisted (so the convergence test and the next
step reuse it) and every ``every`` steps it is written as a reliable
checkpoint into the session's shared checkpoint folder, which cuts the
lineage: a lost executor recomputes at most ``every`` steps.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ...session import checkpoint_dir


class Loop:
    def __init__(self, every: int = 5):
        self.every = max(1, every)
        self._held: list[DataFrame] = []

    def keep(self, df: DataFrame, step: int, release: bool = True) -> DataFrame:
        """Materialise ``df`` for reuse; checkpoint on every ``every``-th step.
        ``release=False`` keeps the previously held step alive as well."""
        if step % self.every == 0:
            checkpoint_dir(df.sparkSession)
            out = df.checkpoint(eager=True)
        else:
            out = df.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()          # materialise now: the plan stays one step deep
        if release:
            old, self._held = self._held, [out]
            for o in old:
                o.unpersist()
        else:
            self._held.append(out)
        return out

    def release_but(self, kept: DataFrame) -> None:
        """Give up all held steps but ``kept``."""
        for o in self._held:
            if o is not kept:
                o.unpersist()
        self._held = [kept]

    def hold(self, df: DataFrame) -> DataFrame:
        """Write a table of the loop once; computed once, as it is cached until written."""
        checkpoint_dir(df.sparkSession)
        cached = df.persist(StorageLevel.MEMORY_AND_DISK)
        out = cached.checkpoint(eager=True)
        cached.unpersist()
        return out

    def close(self) -> None:
        for o in self._held:
            o.unpersist()
        self._held = []
