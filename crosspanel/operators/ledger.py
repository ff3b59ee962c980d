"""A ledger of hypotheses tried: an append-only JSON-lines folder, read and counted by Spark."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.operators.contracts import fail
from crosspanel.operators.inference import t_threshold

SCHEMA = "goal string, factor string, horizon int, t double, p double, n long, method string, note string, ts string, id string, struck array<string>"
COLUMNS = ["goal", "factor", "horizon", "t", "p", "n", "method", "note", "ts", "id"]
KEY = ["goal", "factor", "horizon"]

#: The method of a row that strikes out the entries it names.
CLEARED = "(cleared)"

#: All goals together, as a family of hypotheses.
EVERY_GOAL = "*"


class ResearchLedger:
    """Entries of hypotheses; a path keeps them, None holds them in memory.

    Every entry has an id of its own. What is struck out is named by id and not by time, so the clocks of the drivers
    that write to one ledger do not matter.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.held: list[tuple] = []

    def record(self, *, goal: str, factor: str, horizon: int | None = None, t: float | None = None, p: float | None = None, n: int | None = None, method: str = "bhy", note: str = "") -> None:
        """Add one. It needs a goal and a factor: what has no name can't be counted."""
        if not goal or not factor:
            fail("ledger", "no_name", f"goal {goal!r} and factor {factor!r}: both need a name")
        self._append(goal=goal, factor=factor, horizon=horizon, t=t, p=p, n=n, method=method, note=note)

    def _append(self, struck: list[str] | None = None, **entry) -> None:
        row = (*(entry.get(c) for c in COLUMNS[:8]), dt.datetime.now(dt.timezone.utc).isoformat(), uuid.uuid4().hex, struck)
        if self.path is None:
            self.held.append(row)
        else:
            self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").json(self.path)

    def entries(self, goal: str | None = None) -> DataFrame:
        """What was recorded and not struck out; lines that can't be read are left out."""
        if self.path is None:
            df = self.spark.createDataFrame(self.held, SCHEMA)
        else:
            df = self.spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(self.path)
        df = df.withColumn("id", F.coalesce("id", F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in COLUMNS[:9])).cast("binary"))))
        cleared = F.col("method").eqNullSafe(CLEARED)
        struck = df.where(cleared)
        live = df.where(~cleared).join(struck.select(F.explode("struck").alias("id")), "id", "left_anti")
        # ledgers of before struck out by time, all entries of a goal or, without one, of all
        by_time = struck.where("struck IS NULL")
        by_goal = by_time.where("goal IS NOT NULL").groupBy("goal").agg(F.max("ts").alias("_own"))
        whole = by_time.where("goal IS NULL").agg(F.max("ts").alias("_all"))  # one row
        live = live.join(by_goal, "goal", "left").join(F.broadcast(whole)).where(F.col("ts") > F.coalesce(F.greatest("_own", "_all"), F.lit(""))).select(*COLUMNS)
        return live if goal is None else live.where(F.col("goal") == goal)

    def n_trials(self, goal: str | None = None, family: str | None = None) -> int:
        """Distinct hypotheses, of a goal or of all; repeats count once. The family `*` is all goals, whichever is named."""
        if family not in (None, EVERY_GOAL):
            fail("ledger", "bad_family", f"{family!r} is not {EVERY_GOAL!r}")
        return self.entries(None if family == EVERY_GOAL else goal).select(*KEY).distinct().count()

    def hypotheses(self, goal: str | None = None) -> DataFrame:
        """The first entry of each."""
        w = Window.partitionBy(*KEY).orderBy("ts")
        return self.entries(goal).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def threshold(self, goal: str | None = None, alpha: float = 0.05) -> float:
        """The |t| that the trials so far call for; NaN without any."""
        n = self.n_trials(goal)
        return t_threshold(n, alpha) if n else float("nan")

    def check_n_trials(self, claimed: int, goal: str | None = None) -> bool:
        """Whether at least as many trials are claimed as were recorded."""
        return claimed >= self.n_trials(goal)

    def clear(self, goal: str | None = None) -> None:
        """Strike out all entries so far, or those of a goal: one more row, so nothing is lost if it fails."""
        self._append(struck=[r.id for r in self.entries(goal).select("id").collect()], goal=goal, method=CLEARED)

    def fingerprint(self) -> str:
        """Twelve hex digits that stand for the set of hypotheses."""
        keys = sorted("|".join(map(str, r)) for r in self.entries().select(*KEY).distinct().collect())
        return hashlib.md5("\n".join(keys).encode()).hexdigest()[:12]
