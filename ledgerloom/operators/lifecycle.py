"""Job and document lifecycles, folded from event logs without hot groups.

A run of events acts on a state machine as a function "state before -> state
after and what happened". Such functions compose, so this is an associative scan:
the whole log is cut into ranges of (job, time, event) of about equal size, each
range is folded for every possible start state in short pieces, and the ranges of
a job are composed in order by a tree of bounded fan-in. A job with a third of the
log, even of one instant, is spread over a third of the ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.binding import let
from ledgerloom.schemas import DOCUMENT_STATES, JOB_STATES

EVENTS_PER_PIECE = 512
#: Ranges of a key composed at once.
FAN_IN = 64


@dataclass(frozen=True)
class Machine:
    """Legal moves per event kind: index of the state before -> index after."""

    states: tuple[str, ...]
    moves: dict[str, dict[int, int]]


# States and legal moves.
JOB = Machine(JOB_STATES, {
    "start": {0: 1, 1: 1, 3: 1},
    "complete": {0: 2, 1: 2, 2: 2},
    "fail": {0: 3, 1: 3, 2: 3, 3: 3},
})
DOCUMENT = Machine(DOCUMENT_STATES, {
    "start": {0: 1, 1: 1},
    "complete": {1: 2},
    "fail": {0: 3, 1: 3, 3: 3},
})

EFFECT = (
    "struct<state:int,starts:bigint,illegal:bigint,first_started:timestamp,"
    "last_finished:timestamp,message:string,invoice_id:bigint>"
)


def _effect(state, starts, illegal, first, last, message, invoice) -> Column:
    return F.struct(
        state.alias("state"), starts.alias("starts"), illegal.alias("illegal"),
        first.alias("first_started"), last.alias("last_finished"),
        message.alias("message"), invoice.alias("invoice_id"),
    ).cast(EFFECT)


def _identity(state: int) -> Column:
    null = F.lit(None)
    return _effect(F.lit(state), F.lit(0), F.lit(0), null, null, null, null)


def _target(machine: Machine, state: Column, kind: Column) -> Column:
    moves = F.lit(None).cast("int")
    for event, table in machine.moves.items():
        for before, after in table.items():
            moves = F.when((kind == event) & (state == before), F.lit(after)).otherwise(moves)
    return moves


def _step(machine: Machine, acc: Column, event: Column) -> Column:
    kind = event["kind"]
    known = kind.isin(*machine.moves)

    def apply(to: Column) -> Column:
        legal = to.isNotNull()
        ends = legal & kind.isin("complete", "fail")
        return _effect(
            F.coalesce(to, acc["state"]),
            acc["starts"] + F.when(legal & (kind == "start"), 1).otherwise(0),
            acc["illegal"] + F.when(known & ~legal, 1).otherwise(0),
            F.coalesce(acc["first_started"], F.when(legal & (kind == "start"), event["ts"])),
            F.when(ends, event["ts"]).otherwise(acc["last_finished"]),
            F.when(legal & (kind == "fail"), event["message"])
            .otherwise(acc["message"]),
            F.coalesce(F.when(legal & (kind == "complete"), event["invoice_id"]), acc["invoice_id"]),
        )

    return let(_target(machine, acc["state"], kind), apply)


def _fold_piece(machine: Machine, events: Column) -> Column:
    starts = F.array(*[_identity(s) for s in range(len(machine.states))])
    return F.transform(
        starts, lambda start: F.aggregate(events, start, lambda acc, e: _step(machine, acc, e))
    )


def _then(first: Column, second: Column) -> Column:
    """Effects of a piece followed by another, for every start state."""

    def both(a: Column) -> Column:
        return let(F.get(second, a["state"]), lambda b: _effect(
            b["state"], a["starts"] + b["starts"], a["illegal"] + b["illegal"],
            F.coalesce(a["first_started"], b["first_started"]),
            F.coalesce(b["last_finished"], a["last_finished"]),
            F.coalesce(b["message"], a["message"]),
            F.coalesce(b["invoice_id"], a["invoice_id"]),
        ))

    return F.transform(first, both)


def _compose(machine: Machine, pieces: Column) -> Column:
    identity = F.array(*[_identity(s) for s in range(len(machine.states))])
    return F.aggregate(pieces, identity, lambda acc, p: _then(acc, p["effect"]))


def in_ranges(events: DataFrame, key: str, ranges: int) -> DataFrame:
    """Events with ``_range``: sampled ranges of (key, ts, event_id), numbered in that order."""
    return events.repartitionByRange(ranges, key, "ts", "event_id").withColumn("_range", F.spark_partition_id())


def fold_events(
    events: DataFrame, machine: Machine, key: str = "job_id", ranges: int | None = None, piece: int = EVENTS_PER_PIECE,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Effect of each key's whole history for every start state.

    ``events``: key, event_id, ts, kind, message, invoice_id; ordered by (ts, event_id). They are dealt into
    ``ranges`` ranges (by default as many as shuffle partitions), and one more shuffle brings each range to a task,
    where it is cut into pieces, folded and composed. Only effects travel on.
    """
    ranges = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["ts", "event_id"]
    line = Window.partitionBy("_range").orderBy(key, *order)
    placed = in_ranges(events, key, ranges).withColumn("_piece", F.floor((F.row_number().over(line) - 1) / piece))
    event = F.struct(*order, "kind", "message", "invoice_id")
    pieces = (
        placed.groupBy("_range", "_piece", key)
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
        .select("_range", "_piece", key, _fold_piece(machine, F.col("events")).alias("effect"))
    )
    # The window has brought each range to one task: both aggregates run where it stands.
    parts = _composed(pieces, machine, "_piece", key, "_range")
    while ranges > 1:
        up = parts.withColumn("_up", F.floor(F.col("_range") / fan_in))
        parts = _composed(up, machine, "_range", key, "_up").withColumnRenamed("_up", "_range")
        ranges = -(-ranges // fan_in)
    return parts.select(key, "effect")


def _composed(parts: DataFrame, machine: Machine, order: str, *keys: str) -> DataFrame:
    return (
        parts.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(order, "effect"))).alias("parts"))
        .select(*keys, _compose(machine, F.col("parts")).alias("effect"))
    )


def compose_effects(parts: DataFrame, machine: Machine, order: str, key: str = "job_id") -> DataFrame:
    """One effect per key from its partial effects, taken in the given order."""
    return _composed(parts, machine, order, key)


def current_state(effects: DataFrame, machine: Machine, key: str = "job_id", start: int = 0) -> DataFrame:
    """Rows as they stand after the folded history, from the given start state."""
    e = F.get("effect", F.lit(start))
    names = F.array(*[F.lit(s) for s in machine.states])
    return effects.select(key, e.alias("e")).select(
        key, F.get(names, F.col("e.state")).alias("status"),
        F.col("e.starts").alias("attempts"), F.col("e.illegal").alias("illegal_events"),
        F.col("e.first_started").alias("started_at"), F.col("e.last_finished").alias("finished_at"),
        F.col("e.message").alias("error_message"), F.col("e.invoice_id").alias("invoice_id"),
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    return current_state(fold_events(events, JOB), JOB)


def fold_documents(events: DataFrame) -> DataFrame:
    folded = current_state(fold_events(events, DOCUMENT), DOCUMENT)
    return folded.select(F.col("job_id").alias("document_id"), "status", "illegal_events")


# ------------------------------------------------------------ failure handling
# Error codes and whether they are worth a retry, retry limits.
TAXONOMY: tuple[tuple[str, bool], ...] = (
    ("internal_error", False),
    ("domain_error", False),
    ("entity_validation_error", False),
    ("business_validation_failed", False),
    ("application_error", False),
    ("not_found", False),
    ("document_not_found", False),
    ("job_not_found", False),
    ("invoice_not_found", False),
    ("invalid_file", False),
    ("file_too_large", False),
    ("empty_file", False),
    ("document_processing_failed", False),
    ("transient_processing_error", True),
    ("external_service_error", True),
    ("ocr_extraction_failed", True),
    ("llm_extraction_failed", True),
    ("llm_extraction_partial", False),
    ("storage_error", True),
    ("persistence_error", True),
    ("configuration_error", False),
)
MAX_RETRIES = 3
BACKOFF_SECONDS = 30


def taxonomy(spark) -> DataFrame:
    return spark.createDataFrame(list(TAXONOMY), "code string, default_retryable boolean")


def failure_disposition(failures: DataFrame, codes: DataFrame) -> DataFrame:
    """Retry (and after how many seconds) or final failure for each logged error.

    ``failures``: code, retries so far, timed_out, and ``retryable`` where the
    error overrides its class. The code table is a fixed list of some twenty
    rows, so Spark broadcasts it by its size.
    """
    retry = F.coalesce("retryable", "default_retryable", F.lit(False))
    again = retry & (F.col("retries") < MAX_RETRIES) & ~F.col("timed_out")
    return failures.join(codes, "code", "left").select(
        *[c for c in failures.columns if c not in ("retryable", "timed_out")],
        F.when(again, F.lit("RETRY")).otherwise(F.lit("FAILED")).alias("disposition"),
        F.when(F.col("timed_out"), F.lit("timeout"))
        .when(again, F.lit("")).when(retry, F.lit("retries_exhausted"))
        .otherwise(F.col("code")).alias("reason"),
        F.when(again, (BACKOFF_SECONDS * F.pow(F.lit(2), F.col("retries"))).cast("long"))
        .otherwise(F.lit(0).cast("long")).alias("retry_in_seconds"),
    )
