"""Remote files: what to fetch, and fetching it from the executors."""

from __future__ import annotations

import bz2
import os
import time
import urllib.request
import uuid

from pyspark.sql import DataFrame

from ..session import ship

_RESULT = "url string, path string, size long, error string"


def fetch(tasks: DataFrame, parallel: int = 16, open_url=None, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """Fetches tasks (url, path): one row each with the decoded size or the error. Files that are there with content are left.

    `path` must lie in a folder that all executors share. A file appears under its name only when it is
    whole, so a task that runs again does no harm. What fails is tried `tries` times, after `wait` seconds and
    twice as long each further time; an address that isn't there (4xx) is tried once.
    """
    import pandas as pd

    ship(tasks.sparkSession)
    load = open_url or (lambda url: urllib.request.urlopen(url, timeout=30).read())

    def loaded(url: str) -> bytes:
        for again in range(tries - 1):
            try:
                return bz2.decompress(load(url))
            except (OSError, EOFError, ValueError) as e:
                if 400 <= getattr(e, "code", 0) < 500:
                    raise
                time.sleep(wait * 2**again)
        return bz2.decompress(load(url))

    def one(url: str, path: str) -> tuple:
        try:
            if os.path.exists(path) and os.path.getsize(path):
                return url, path, os.path.getsize(path), None
            data = loaded(url)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, path)
            return url, path, len(data), None
        except Exception as e:  # a failed file is a result: its level stays empty
            return url, path, None, str(e)[:200]

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([one(u, p) for u, p in zip(batch["url"], batch["path"], strict=True)], columns=["url", "path", "size", "error"])

    return tasks.select("url", "path").repartition(parallel).mapInPandas(run, _RESULT)
