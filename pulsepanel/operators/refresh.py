"""Period refresh: a stored model table that follows its changed months.

The model row of month m rests on the features of m, of m - lag and of
m + horizon, and its verdict on the rows of m and m + horizon.  So changed
months C touch the model rows of C, of C + lag and of C - horizon, and these
need the features of those months, one lag before and one horizon after.  A
refresh reads only these months, runs the same expressions as the full build
on them, and replaces only the touched months; cost follows the change, not
the history.

A store holds three snapshots (see :mod:`pulsepanel.sources.snapshots`):
``features`` and ``model`` by period, and ``counts``, one row per period that
the verdicts come from.  A manifest above them names the version of each, so
readers get three tables of one state; a refresh that dies leaves that state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.functions.periods import period_index
from pulsepanel.operators.labels import attach_trust, forward_status, label_rows, period_counts, verdicts
from pulsepanel.operators.panel import lag_diff
from pulsepanel.sources.checked import no_nulls, total
from pulsepanel.sources.sinks import materialize
from pulsepanel.sources.snapshots import Manifest, commit, current, publish, read_snapshot, replace_periods

TABLES = ("features", "model", "counts")


def shift(period: int, months: int) -> int:
    """YYYYMM some months later."""
    index = period // 100 * 12 + period % 100 - 1 + months
    return index // 12 * 100 + index % 12 + 1


@dataclass
class PanelStore:
    """A stored panel: where it lies and how its model table is made."""

    path: str
    lag_cols: list
    key: str = "msno"
    period: str = "safra"
    status: str = "is_ativo"
    horizon: int = 3
    lag: int = 1
    label: str = "churn_3m"

    # ---------------------------------------------------------------- reading
    def state(self, spark: SparkSession) -> Manifest | None:
        return current(spark, self.path)

    def read(self, spark: SparkSession, table: str = "model", periods=None) -> DataFrame:
        """A table of the published state; with ``periods`` only these are read."""
        state = self.state(spark)
        if state is None:
            raise ValueError(f"no panel is stored at {self.path}")
        return read_snapshot(spark, f"{self.path}/{table}", state.parts[table], periods)

    def verdicts(self, spark: SparkSession) -> DataFrame:
        return verdicts(self.read(spark, "counts"), self.period, self.horizon)

    def periods(self, spark: SparkSession) -> list[int]:
        """Months of the stored features, from the manifest."""
        state = self.state(spark)
        from pulsepanel.sources.snapshots import load

        return sorted(int(p) for p in load(spark, f"{self.path}/features", state.parts["features"]).parts)

    # ---------------------------------------------------------------- writing
    def _windowed(self, features: DataFrame) -> DataFrame:
        """Lags and future status of all rows: one exchange, one sort."""
        x = features.withColumn("_pidx", period_index(self.period))
        x = lag_diff(x, self.lag_cols, self.key, self.period, idx="_pidx", lag=self.lag)
        return forward_status(x, self.key, self.period, self.status, self.horizon, idx="_pidx")

    def _rows(self, windowed: DataFrame, counts: DataFrame) -> DataFrame:
        rows = label_rows(windowed, self.status, self.label).drop("_pidx")
        return attach_trust(rows, verdicts(counts, self.period, self.horizon), self.period)

    def _counts(self, windowed: DataFrame) -> DataFrame:
        return period_counts(windowed, self.period, self.status, "_pidx")

    def _keyed(self) -> dict:
        return no_nulls([self.key, self.period], "panel")

    def _all_labelled(self, counts: DataFrame) -> dict:
        """The model rows are those that the counts of the periods say."""
        rows = counts.agg(F.coalesce(F.sum("_obs"), F.lit(0))).first()[0]  # one row a period
        return total("rows", F.lit(1), rows, "model table")

    def _commit(self, spark: SparkSession, number: int, versions: dict) -> Manifest:
        state = Manifest(number, None, None, versions)
        commit(spark, self.path, state)
        return state

    def build(self, features: DataFrame) -> Manifest:
        """Stores the features of all months, the model table and the counts."""
        spark = features.sparkSession
        old = self.state(spark)
        versions = {"features": publish(features, f"{self.path}/features", self.period, self._keyed()).number}
        stored = read_snapshot(spark, f"{self.path}/features", versions["features"])
        windowed = materialize(self._windowed(stored), "windowed_panel")
        versions["counts"] = publish(self._counts(windowed), f"{self.path}/counts").number
        counts = read_snapshot(spark, f"{self.path}/counts", versions["counts"])
        versions["model"] = publish(self._rows(windowed, counts), f"{self.path}/model", self.period,
                                    self._all_labelled(counts)).number
        return self._commit(spark, old.number + 1 if old else 1, versions)

    def touched(self, changed) -> list[int]:
        """Months whose model rows a change of these months can alter."""
        return sorted({shift(p, by) for p in changed for by in (0, self.lag, -self.horizon)})

    def refresh(self, features: DataFrame, periods) -> Manifest:
        """Replaces the features of ``periods`` (new, corrected or, without a
        row, withdrawn months) and everything that rests on them.

        Two refreshes from one state: the second fails with ``ConflictError``
        and can be run again.  No period: nothing is done.
        """
        spark, state = features.sparkSession, self.state(features.sparkSession)
        if state is None:
            raise ValueError(f"no panel is stored at {self.path}")
        changed = sorted({int(p) for p in periods})
        if not changed:
            return state
        base = state.parts
        versions = {"features": replace_periods(features, f"{self.path}/features", changed,
                                                base["features"], self._keyed()).number}
        touched = self.touched(changed)
        needed = sorted({shift(p, by) for p in touched for by in (0, -self.lag, self.horizon)})
        part = read_snapshot(spark, f"{self.path}/features", versions["features"], needed)
        mine = F.col(self.period).isin(touched)
        windowed = materialize(self._windowed(part).where(mine), "windowed_periods")
        kept = read_snapshot(spark, f"{self.path}/counts", base["counts"]).where(~mine)
        counts = kept.unionByName(self._counts(windowed))  # one row a period
        versions["counts"] = publish(materialize(counts, "period_counts"), f"{self.path}/counts").number
        counts = read_snapshot(spark, f"{self.path}/counts", versions["counts"])
        versions["model"] = replace_periods(self._rows(windowed, counts), f"{self.path}/model", touched,
                                            base["model"], self._all_labelled(counts.where(mine))).number
        return self._commit(spark, state.number + 1, versions)
