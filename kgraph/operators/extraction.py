"""The extraction runner: every call of a model is a row, with its status, wait and sizes.

Chunks are dealt to as many workers as may call at once; each has its share of the tokens a minute. A worker asks
again when the model's rate is exceeded, waiting twice as long each time; when the model says that a request is too
long, by how much, the room for the answer shrinks, and then the content. Any other error ends the chunk.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTEMPTS = "chunk_id {id}, attempt int, status string, waited double, characters long, completion long, error string, record string"
RATE = re.compile(r"429|Too Many Requests|rate_limit", re.I)
LIMIT = re.compile(r"limit:?\s*(\d+)", re.I)
REQUESTED = re.compile(r"requested:?\s*(\d+)", re.I)


class Bucket:
    """Tokens that may be spent: as many as a minute brings, refilled as time goes by."""

    def __init__(self, per_minute: float, now: Callable[[], float]):
        self.rate, self.now, self.level, self.at = per_minute / 60, now, per_minute, now()

    def wait(self, tokens: float) -> float:
        """Takes the tokens; how long to wait until there were enough."""
        t = self.now()
        self.level, self.at = min(self.rate * 60, self.level + (t - self.at) * self.rate), t
        self.level -= tokens
        return max(0.0, -self.level / self.rate)


def salvaged(raw: str) -> str:
    """The object between the first and the last brace, its lists there, as JSON."""
    text = raw[raw.find("{") : raw.rfind("}") + 1]
    if not text:
        raise ValueError(f"no JSON found: {raw[:100]}")
    data = json.loads(text)
    lists = {k: data.get(k, []) for k in ("entities", "relationships")}
    if not all(isinstance(v, list) for v in lists.values()):
        raise ValueError("entities or relationships is no list")
    return json.dumps(data | lists, ensure_ascii=False, sort_keys=True)


def calls(chunk_id, content: str, model: Callable[..., str], bucket: Bucket | None, sleep: Callable[[float], None], limit: int, margin: int, prompt: int, low: int, high: int, tries: int, delay: float, shrinks: int) -> Iterator[tuple]:
    """The attempts at one chunk, a tuple each."""
    content = content[: max(800, 4 * (limit - margin - low - prompt))]
    completion = max(low, min(high, limit - margin - prompt - max(1, len(content) // 4)))
    limited = shrunk = 0
    for attempt in range(1, tries + shrinks + 1):
        pause = bucket.wait(prompt + len(content) // 4 + completion) if bucket else 0.0
        if pause:
            sleep(pause)
        size = (len(content), completion)
        try:
            record = salvaged(model(chunk_id=chunk_id, content=content, completion=completion, attempt=attempt))
            yield chunk_id, attempt, "ok", pause, *size, None, record
            return
        except Exception as e:  # a model's errors have no common type
            said = str(e)[:300]
        numbers = LIMIT.search(said), REQUESTED.search(said)
        if RATE.search(said) and not all(numbers):
            limited += 1
            if limited == tries:
                yield chunk_id, attempt, "failed", pause, *size, f"rate limit after {tries} attempts", None
                return
            sleep(delay * 2 ** (limited - 1))
            yield chunk_id, attempt, "rate_limited", pause + delay * 2 ** (limited - 1), *size, said, None
        elif all(numbers) and shrunk < shrinks - 1:
            over = int(numbers[1][1]) - int(numbers[0][1]) + margin
            shrunk += 1
            if completion - over >= low:
                completion -= over
            elif len(content) > 4 * over + 500:
                content, completion = content[: len(content) - 4 * over], low
            else:
                yield chunk_id, attempt, "failed", pause, *size, said, None
                return
            yield chunk_id, attempt, "too_long", pause, *size, said, None
        else:
            yield chunk_id, attempt, "failed", pause, *size, said, None
            return


def attempts(chunks: DataFrame, model: Callable[..., str], workers: int = 8, per_minute: float | None = None, limit: int = 8000, margin: int = 400, prompt: int = 900, low: int = 800, high: int = 6000, tries: int = 5, delay: float = 10.0, shrinks: int = 4, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """chunk_id, attempt, status, waited, characters, completion, error, record for each call of
    ``model(chunk_id=, content=, completion=, attempt=)``, which returns text or raises. ``per_minute``: tokens of all
    workers together; null content is empty."""
    kind = dict(chunks.dtypes)["chunk_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = Bucket(per_minute / workers, time.monotonic) if per_minute else None
        for rows in frames:
            out = [a for i, c in zip(rows.chunk_id.tolist(), rows.content.tolist(), strict=True) for a in calls(i, c or "", model, bucket, sleep, limit, margin, prompt, low, high, tries, delay, shrinks)]
            yield pd.DataFrame(out, columns=["chunk_id", "attempt", "status", "waited", "characters", "completion", "error", "record"])

    return chunks.select("chunk_id", "content").repartition(workers, "chunk_id").mapInPandas(run, ATTEMPTS.format(id=kind))


def outcomes(tried: DataFrame) -> DataFrame:
    """chunk_id, error, record, attempts: what the last attempt at each chunk came to."""
    last = tried.groupBy("chunk_id").agg(F.max_by(F.struct("status", "error", "record"), "attempt").alias("r"), F.max("attempt").alias("attempts"))
    return last.select("chunk_id", F.when(F.col("r.status") != "ok", F.coalesce("r.error", F.lit("failed"))).alias("error"), "r.record", "attempts")
