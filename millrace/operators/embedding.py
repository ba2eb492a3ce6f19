"""Building chunk vectors with a model that is called in batches."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import truncate
from millrace.streaming.publish import new_only

BATCH, RETRIES = 16, 3
#: characters of the shorter tries for a text that the model finds too long
SHORTER = (1024, 768, 512)


class TooLong(ValueError):
    """What a client raises for a text beyond its context."""


def toy_client(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: eight bytes of the text's SHA-256, scaled to length 1."""
    out = []
    for t in texts:
        v = [(b - 127.5) / 127.5 for b in hashlib.sha256(t.encode()).digest()[:8]]
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v])
    return out


def embed(chunks: DataFrame, client: Callable[[list[str]], list[list[float]]], done: DataFrame | None = None, max_chars: int = 1024, batch: int = BATCH, retries: int = RETRIES, wait: float = 0.5, key: str = "chunk_id") -> DataFrame:
    """key, embedding, status, tries for chunks(key, text) that are not in done.

    Each task calls the client with `batch` texts at a time, again after a pause that grows if it
    fails, then one by one with shorter and shorter texts if one is too long. A chunk that can't be
    embedded has no vector and says why; blank chunks are skipped. Writing the result appends to
    done, so a build that stopped goes on where it was.
    """
    todo = new_only(chunks, done, key) if done is not None else chunks
    todo = todo.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key, truncate(F.col("text"), max_chars).alias("text"))

    def call(texts: list[str]) -> tuple[list[list[float]] | None, str, int]:
        for attempt in range(1, retries + 1):
            try:
                return client(texts), "done", attempt
            except TooLong:
                return None, "too long", attempt
            except Exception as e:  # the row says what the model said
                problem = str(e)[:200] or type(e).__name__
                if attempt < retries:
                    time.sleep(wait * attempt)
        return None, problem, retries

    def one(text: str) -> tuple[list[float] | None, str, int]:
        tries = 0
        for t in [text, *(text[:n].rstrip() for n in SHORTER if n < len(text))]:
            found, status, n = call([t])
            tries += n
            if status != "too long":
                return (found[0] if found else None), status, tries
        return None, status, tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                found, status, tries = call(part["text"].tolist())
                if found is not None:
                    rows += [(k, v, status, tries) for k, v in zip(part[key], found, strict=True)]
                else:
                    rows += [(k, *one(t)) for k, t in zip(part[key], part["text"], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "embedding", "status", "tries"])

    return todo.mapInPandas(run, f"{key} string, embedding array<double>, status string, tries int")
