"""Pinned assets: fetched with retries, stored once, and only if length and digest are those of the registry."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checkpointing import materialize
from .sinks import create_once

# fixed values: tries, the first wait and the longest in seconds, and answers that may pass
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 0.5, 8.0
PASSING = (408, 429)


class Refused(Exception):
    """A server's answer other than success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def may_pass(error: Exception) -> bool:
    """Whether another try makes sense: lost connections and overload, not refusals or errors of the code."""
    if isinstance(error, Refused):
        return error.status in PASSING or 500 <= error.status < 600
    return isinstance(error, (ConnectionError, TimeoutError))


def with_retries[T](call: Callable[[], T], attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, sleep: Callable[[float], None] = time.sleep) -> tuple[T | None, int, Exception | None]:
    """(result, tries, error): waits double from ``wait`` to ``LONGEST_WAIT``; an error that can't pass ends it at once."""
    for k in range(1, attempts + 1):
        try:
            return call(), k, None
        except Exception as e:
            if k == attempts or not may_pass(e):
                return None, k, e
            sleep(min(LONGEST_WAIT, wait * 2 ** (k - 1)))
    raise ValueError("at least one try is needed")


def fault(content: bytes, size: int, sha256: str) -> str | None:
    """What is wrong with an asset's content."""
    if len(content) != size:
        return f"length {len(content)} instead of {size}"
    return None if hashlib.sha256(content).hexdigest() == sha256.lower() else "another SHA-256"


def acquire(assets: DataFrame, fetch: Callable[[str], bytes], folder: str, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> DataFrame:
    """(name, sha256, status, tries, error) for the ``assets`` (name, url, bytes, sha256) of a registry.

    ``status`` is held if ``folder`` had the asset, acquired if it has it now, else failed, with the error; one
    asset's failure leaves the others alone, and content that differs from the registry is never stored. ``fetch``
    reads a url on an executor and raises ``Refused`` for an answer without success. Assets lie under
    folder/aa/sha256, whole or not at all, so a task that runs again finds what it stored and fetches nothing
    twice. Each asset is fetched once, however many rows name it; what is held is checked again. A row without a
    url, length or digest fails."""
    pins = assets.select("url", F.col("bytes").cast("long").alias("bytes"), F.lower("sha256").alias("sha256"))
    once = pins.where("url is not null and bytes is not null and sha256 is not null").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            out = []
            for url, size, sha in zip(b.url, b.bytes, b.sha256, strict=True):
                path = f"{root}/{sha[:2]}/{sha}"
                if where.get_file_info(path).type != fs.FileType.NotFound:
                    with where.open_input_stream(path) as held:
                        wrong, tries, status = fault(held.read(), size, sha), 0, "held"
                else:
                    content, tries, error = with_retries(lambda u=url: fetch(u), attempts, wait)
                    wrong, status = (f"{type(error).__name__}: {error}" if error else fault(content, size, sha)), "acquired"
                    if not wrong:
                        create_once(where, path, content)
                out.append((url, size, sha, "failed" if wrong else status, tries, wrong))
            yield pd.DataFrame(out, columns=["url", "bytes", "sha256", "status", "tries", "error"])

    # written down, as a second look at the rows would find all held
    spread = once.repartition(F.col("sha256"), F.col("url"))
    done = materialize(spread.mapInPandas(run, "url string, bytes long, sha256 string, status string, tries int, error string"), "assets")
    named = assets.select("name", "url", F.col("bytes").cast("long").alias("bytes"), F.lower("sha256").alias("sha256"))
    out = named.join(done, ["url", "bytes", "sha256"], "left")
    return out.select("name", "sha256", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("tries", F.lit(0)).alias("tries"), F.when(F.col("status").isNull(), "no url, length or digest").otherwise(F.col("error")).alias("error"))
