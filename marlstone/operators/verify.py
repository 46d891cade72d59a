"""A stage that asks a verifier model about disputes: in batches, at a bounded rate, each question once, errors counted."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marlstone.functions import text as T
from marlstone.operators.contradiction import disputes, reconcile
from marlstone.sources.shared import settle

# load() -> call: a batch of questions (dicts of the asked columns) to one answer each: text, None to
# abstain, or an exception for that question. If the call itself raises, each question is asked alone.
Load = Callable[[], Callable[[list[dict]], list[str | None | Exception]]]


class Pace:
    """Lets at most ``per_second`` questions go, over the whole life of a task."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.per_second, self.clock, self.sleep = per_second, clock, sleep
        self.free_at = clock()

    def wait(self, questions: int) -> None:
        if self.per_second:
            now = self.clock()
            if self.free_at > now:
                self.sleep(self.free_at - now)
            self.free_at = max(now, self.free_at) + questions / self.per_second


def said(call: Callable[[list[dict]], list], asked: list[dict]) -> list[tuple[str | None, str | None]]:
    """(answer, error) of each question; a failing batch is asked one by one, so that one bad question spoils no other."""
    try:
        got = call(asked)
        if len(got) != len(asked):
            raise ValueError(f"{len(got)} answers to {len(asked)} questions")
    except Exception as e:
        if len(asked) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [x for one in asked for x in said(call, [one])]
    return [(None, f"{type(g).__name__}: {g}") if isinstance(g, Exception) else (g, None) for g in got]


def answers(asked: DataFrame, load: Load, batch: int = 32, per_second: float | None = None) -> DataFrame:
    """Adds answer and error to rows of questions; ``load`` runs once for each task.

    ``per_second`` bounds the questions of one task; a cluster asks that many times
    the number of tasks at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, pace = None, Pace(per_second)
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                call = call or load()
                pace.wait(part.num_rows)
                got = said(call, part.to_pylist())
                columns = [pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]
                yield pa.record_batch([*part.columns, *columns], names=[*part.schema.names, "answer", "error"])

    return asked.mapInArrow(run, StructType([*asked.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def _name(kind: Column, subject: Column) -> Column:
    return F.concat(kind, F.lit(":"), subject)


def reconcile_asked(
    df: DataFrame, key: str, load: Load, same: tuple[str, ...] = (), batch: int = 32, per_second: float | None = None, tasks: int | None = None,
    tags: str = "tags", prose: str = "prose",
) -> DataFrame:
    """``reconcile`` by a verifier model: adds prose_before, changes, and verify_errors (questions of the row that failed).

    Disputes are exploded and asked once for each ``key`` and question, or once for
    each combination of the columns ``same`` (a content hash, say) and question. An
    abstention, an answer that can't be read and an error leave the prose alone; the
    row's other disputes go on. ``tasks`` spreads the questions. Answers are written
    once, so that no later step asks again.
    """
    by = list(same) or [key]
    found = df.select(*dict.fromkeys([key, *by]), F.explode(disputes(F.coalesce(tags, F.lit("")), F.coalesce(prose, F.lit("")))).alias("d"))
    found = found.select(*dict.fromkeys([key, *by]), "d.kind", "d.subject", T.question(F.col("d.kind"), F.col("d.subject")).alias("question"))
    once = found.select(*by, "kind", "subject", "question").distinct()
    got = settle(answers(once.repartition(tasks) if tasks else once, load, batch, per_second), "answers")
    if same:
        got = found.select(key, *by, "kind", "subject").join(got, [*by, "kind", "subject"])
    heard = got.groupBy(key).agg(
        F.map_from_entries(F.collect_set(F.when(F.col("answer").isNotNull(), F.struct(_name(F.col("kind"), F.col("subject")), "answer")))).alias("__answers"),
        F.count("error").alias("__errors"),
    )
    value = lambda d: T.parse_answer(d["kind"], F.try_element_at(F.col("__answers"), _name(d["kind"], d["subject"])))
    out = reconcile(df.join(heard, key, "left"), value, tags, prose)
    return out.withColumn("verify_errors", F.coalesce("__errors", F.lit(0).cast("long"))).drop("__answers", "__errors")

