"""The seam for a chat model: many prompts answered by bounded concurrent calls, and a ledger of what was answered.

``chat(messages)`` gives the answer's text to a list of ``{role, content}``. A partition keeps ``window`` calls in
flight, tries a call that raises again by its policy, and gives every prompt an outcome of its own: one
that fails for good does not fail others, nor the task. Answers come in the order of the prompts.

The ledger is a table of answers by request: the SHA-256 of the messages and of the model's name. A
prompt that is in it is not sent again, equal prompts are sent once, and prompts go out in
batches (by their key), each stored before the next, so what a lost job had answered up to then stays.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.embed import CallPolicy
from lodestone.sources.tables import materialised, temporary

WINDOW, BATCH_REQUESTS = 8, 100_000
#: ``chat(messages)``: the answer's text.
Chat = Callable[[list[dict[str, str]]], str]
LEDGER = "request string, answer string, attempts int"


def request_key(messages: Column, model: str) -> Column:
    """What a request is known by: the model's name and all messages, whole."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.to_json(messages)), 256)


def _answered(chat: Chat, messages: list[dict[str, str]], policy: CallPolicy) -> tuple[str | None, int, str | None]:
    """Answer, number of calls, and what went wrong."""
    wrong = None
    for attempt in range(1, policy.attempts + 1):
        if attempt > 1:
            time.sleep(policy.pause * 2 ** (attempt - 2))
        try:
            answer = chat(messages)
        except Exception as e:  # whatever a client raises
            wrong = f"{type(e).__name__}: {e}"[:500]
            continue
        if isinstance(answer, str) and answer.strip():
            return answer, attempt, None
        wrong = "no text"
    return None, policy.attempts, wrong


def called(requests: DataFrame, connect: Callable[[], Chat], policy: CallPolicy = CallPolicy(), window: int = WINDOW) -> DataFrame:
    """``request, answer, attempts, error`` of requests ``request, messages``, one call each and more where it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat: Chat | None = None
        with ThreadPoolExecutor(max_workers=window) as pool:
            flying: deque[tuple[str, Future]] = deque()

            def landed() -> pa.RecordBatch:
                key, future = flying.popleft()
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((key, *future.result()), TYPES, strict=True)], names=list(NAMES))

            for batch in batches:
                for key, messages in zip(batch["request"].to_pylist(), batch["messages"].to_pylist(), strict=True):
                    chat = chat or connect()
                    if len(flying) == window:
                        yield landed()
                    flying.append((key, pool.submit(_answered, chat, messages, policy)))
            while flying:
                yield landed()

    TYPES, NAMES = (pa.string(), pa.string(), pa.int32(), pa.string()), ("request", "answer", "attempts", "error")
    return requests.select("request", "messages").mapInArrow(run, "request string, answer string, attempts int, error string")


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LEDGER)
        raise


def chat_answers(
    rows: DataFrame, connect: Callable[[], Chat], ledger: str, model: str = "", policy: CallPolicy = CallPolicy(), window: int = WINDOW,
    batch_requests: int = BATCH_REQUESTS,
) -> DataFrame:
    """``rows`` (``messages``, and ``answer`` where one is fixed) with the answer of the model, and ``error`` where there is none.

    Failures are not entered into the ledger, so a later run tries them again.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("request", F.when(F.col("messages").isNotNull(), request_key(F.col("messages"), model)))
    failures = spark.createDataFrame([], "request string, error string")
    with temporary(spark):
        wanted = keyed.where("request is not null").groupBy("request").agg(F.first("messages").alias("messages"))
        open_ones = materialised(wanted.join(_ledger(spark, ledger), "request", "left_anti"), "requests")
        batches = -(-open_ones.count() // batch_requests)
        wrong = []
        for number in range(batches):
            some = open_ones.where(F.pmod(F.xxhash64("request"), F.lit(batches)) == number)
            found = materialised(called(some, connect, policy, window), "called")
            found.where("error is null").drop("error").write.mode("append").parquet(ledger)
            wrong.append(found.where("error is not null").select("request", "error"))
        for part in wrong:
            failures = failures.unionByName(part)
        # Outlives the intermediate tables.
        path = f"{ledger.rstrip('/')}-failures"
        failures.write.mode("overwrite").parquet(path)
    failed = spark.read.schema("request string, error string").parquet(path)
    known = _ledger(spark, ledger).select("request", F.col("answer").alias("given"))
    both = keyed.join(known, "request", "left").join(failed, "request", "left")
    return both.withColumn("answer", F.coalesce("answer", "given")).drop("request", "given")
