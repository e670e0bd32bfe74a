"""Work on several scopes side by side."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Event, Timer

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Outcome:
    scope: str
    value: object
    error: str | None
    seconds: float


def run_scopes(spark: SparkSession, scopes: Iterable[str], work: Callable[[str], object], *, workers: int = 4, timeout: float | None = None) -> list[Outcome]:
    """What ``work`` gives for each scope, in the order of ``scopes``, ``workers`` of them at once.

    A scope that fails or takes longer than ``timeout`` seconds gives an error, its Spark jobs
    are cancelled by their tag, and the others go on.
    """

    def one(scope: str) -> Outcome:
        began, late, tag = time.monotonic(), Event(), f"scope-{uuid.uuid4().hex}"

        def stop() -> None:
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)

        spark.sparkContext.addJobTag(tag)
        timer = Timer(timeout, stop) if timeout is not None else None
        if timer:
            timer.start()
        value, error = None, None
        try:
            value = work(scope)
        except Exception as e:  # one scope's failure is its own
            error = f"{type(e).__name__}: {e}".splitlines()[0]
        finally:
            if timer:
                timer.cancel()
            spark.sparkContext.removeJobTag(tag)
        if late.is_set():
            value, error = None, "timeout"
        return Outcome(scope, value, error, time.monotonic() - began)

    with ThreadPoolExecutor(max_workers=max(1, min(4, workers))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), s) for s in scopes]]
