"""Handlers: Python callables over records or pages, with retries, run in Arrow batches.

A handler is called for its effect.  Tasks may run again, so effects are at least once.
What happened is a table: each record with attempts, outcome and error.
"""

from __future__ import annotations

import queue
import threading
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import BATCH, SEND_TO_DLQ, SKIP, HandlerOptions, HandlerPanic, one_handler


def call_with_retry(call: Callable[[], None], most: int, backoff: float, sleep=time.sleep) -> tuple[int, BaseException | None]:
    """Attempts made and the last error; before attempt n+1 it sleeps n * backoff."""
    for attempt in range(1, most + 1):
        try:
            call()
            return attempt, None
        except Exception as e:  # an ordinary failure, cancelled calls of the handler's own included
            error = e
        except BaseException as e:  # noqa: BLE001  whatever a handler raises is a failure of the handler
            if isinstance(e, (KeyboardInterrupt, GeneratorExit)):
                raise
            error = HandlerPanic(f"handler panicked: {e!r}")
        if attempt < most:
            sleep(attempt * backoff)
    return most, error


def hand_out(rows: list, most: int, one: Callable) -> tuple[list, BaseException | None]:
    """Results of ``one`` for each row, by ``most`` threads that take the next row in turn; None for rows not handed out.

    The first error stops the hand-out; rows that are being handled are waited for.
    """
    results: list = [None] * len(rows)
    turn, lock, errors = iter(range(len(rows))), threading.Lock(), []

    def work() -> None:
        while not errors:
            with lock:
                i = next(turn, None)
            if i is None:
                return
            try:
                results[i] = one(rows[i])
            except BaseException as e:  # noqa: BLE001  goes to the caller
                errors.append(e)

    if min(most, len(rows)) <= 1:
        work()
    else:
        threads = [threading.Thread(target=work, daemon=True) for _ in range(min(most, len(rows)))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    return results, errors[0] if errors else None


class _Stop(Exception):
    """A record that failed for good under fail-fast."""

    def __init__(self, attempts: int, error: BaseException):
        super().__init__(f"failed after {attempts} attempts: {error}")
        self.attempts = attempts


def whole_pages(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Frames of whole pages, with the rows where pages begin and the frame's length, from frames that are sorted by shard and ordinal."""
    rest = None
    for pdf in frames:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if pdf.empty:
            continue
        shard, page = pdf["shard_id"].to_numpy(), pdf["page_no"].to_numpy()
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (page[1:] != page[:-1])) + 1).tolist()]
        if len(cuts) > 1:
            yield pdf.iloc[: cuts[-1]], cuts
        rest = pdf.iloc[cuts[-1] :]
    if rest is not None:
        yield rest, [0, len(rest)]


def run_handler(pages: DataFrame, options: HandlerOptions, on_record=None, on_batch=None, sleep=time.sleep, raises: bool = True) -> DataFrame:
    """``pages`` with attempts, outcome and error of each record.

    A shard's pages are handled in order, by one task.  Under fail-fast the first failure
    raises, which fails the batch before any progress is committed; with ``raises`` false
    its records get the outcome ``failed``, and what follows in the shard ``unread``.  With
    ``shard_concurrency`` above 1, the records of a page are handled by so many threads and
    lose their order; the first failure then stops the hand-out.
    """
    kind, t = one_handler(on_record, on_batch), options.tuning
    if kind != options.kind:
        raise ValueError(f"a {options.kind} handler is expected")
    good = {SKIP: "skipped", SEND_TO_DLQ: "dlq"}.get(options.effective_policy)
    schema = T.StructType([*pages.schema.fields, T.StructField("attempts", T.IntegerType()), T.StructField("outcome", T.StringType()), T.StructField("error", T.StringType())])

    def settled(call: Callable[[], None]) -> tuple[int, str, str | None]:
        attempts, error = call_with_retry(call, t.retry_max_attempts, t.retry_backoff, sleep)
        if error is None:
            return attempts, "processed", None
        stop = _Stop(attempts, error)
        if good is None:
            raise stop from error
        return attempts, good, str(stop)

    def handled(rows: list) -> tuple[list, BaseException | None]:
        if kind == BATCH:
            got, error = hand_out([rows], 1, lambda page: settled(lambda: on_batch(page)))
            got = got * len(rows)
        else:
            got, error = hand_out(rows, t.shard_concurrency, lambda row: settled(lambda: on_record(row)))
        if error is not None:
            first = next((i for i, g in enumerate(got) if g is None), 0)  # of several at once the first in order
            failed = range(len(rows)) if kind == BATCH else (first,)
            attempts = getattr(error, "attempts", 1)
            got = [(attempts, "failed", str(error)) if i in failed else g or (0, "unread", None) for i, g in enumerate(got)]
        return got, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = object()  # no shard, not even that of null
        for pdf, cuts in whole_pages(frames):
            # rows and results are made for many pages at a time: a frame for each page costs more than its records
            rows, shards, done = list(pdf.itertuples(index=False)), pdf["shard_id"].to_numpy(), []
            for a, b in zip(cuts, cuts[1:]):
                if shards[a] == stopped:
                    done += [(0, "unread", None)] * (b - a)
                    continue
                got, error = handled(rows[a:b])
                done += got
                if error is not None:
                    if raises:
                        raise RuntimeError(str(error)) from error
                    stopped = shards[a]
            attempts, outcome, errors = zip(*done)
            yield pdf.assign(attempts=attempts, outcome=outcome, error=errors)

    return pages.repartition("shard_id").sortWithinPartitions("shard_id", "ordinal").mapInPandas(run, schema)


def within(seconds: float, call: Callable[[], None]) -> None:
    """Calls in a thread of its own; raises TimeoutError after ``seconds``, even if the call ends well later."""
    result: queue.SimpleQueue = queue.SimpleQueue()

    def work() -> None:
        try:
            call()
            result.put(None)
        except BaseException as e:  # noqa: BLE001  goes to the caller
            result.put(e)

    threading.Thread(target=work, daemon=True).start()
    try:
        error = result.get(timeout=seconds)
    except queue.Empty:
        raise TimeoutError(f"no answer within {seconds:g} s") from None
    if error is not None:
        raise error


def publish(rows: DataFrame, publisher: Callable[[dict], None], most: int = 3, backoff: float = 1.0, deadline: float = 10.0, sleep=time.sleep) -> DataFrame:
    """Gives each poison record to ``publisher`` with retries; returns idempotency_key, publish_attempts and publish_error.

    Each attempt has a thread and a deadline of its own: one that hangs delays neither the
    next attempt nor the next record.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                attempts, error = call_with_retry(lambda row=row: within(deadline, lambda: publisher(row)), most, backoff, sleep)
                out.append((row["idempotency_key"], attempts, None if error is None else str(error) or type(error).__name__))
            yield pd.DataFrame(out, columns=["idempotency_key", "publish_attempts", "publish_error"])

    return rows.mapInPandas(run, "idempotency_key string, publish_attempts int, publish_error string")


def retry_summary(outcome_rows: DataFrame) -> DataFrame:
    """shard_id, handled and retries: attempts beyond the first."""
    return outcome_rows.groupBy("shard_id").agg(F.count("*").alias("handled"), F.sum(F.col("attempts") - 1).alias("retries"))
