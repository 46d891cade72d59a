"""Model inference as a column-producing stage: plug-ins run in mapInPandas, loaded once per worker."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.assembly import hybrid_string

# A backend is a factory: load() -> function of image bytes -> caption string; kind "tags" or "prose".
_backends: dict[str, tuple[Callable[[], Callable[[bytes], str]], str]] = {}
_loaded: dict[str, Callable[[bytes], str]] = {}


def register_backend(name: str, load: Callable[[], Callable[[bytes], str]], kind: str = "prose") -> None:
    if kind not in ("tags", "prose"):
        raise ValueError("a backend gives tags or prose")
    _backends[name] = load, kind


def stub() -> Callable[[bytes], str]:
    """A deterministic stand-in for a model: two words picked by the content's digest."""
    words = ["standing", "park", "red dress", "smile", "window", "reading"]
    return lambda content: ", ".join(words[b % len(words)] for b in hashlib.sha256(content).digest()[:2])


register_backend("stub-tags", stub, "tags")
register_backend("stub-prose", stub, "prose")


def backend(name: str) -> list[str]:
    """The stages of a backend name: one, or the two of "hybrid:a+b"."""
    parts = name.removeprefix("hybrid:").split("+") if name.startswith("hybrid:") else [name]
    for p in parts:
        if p not in _backends:
            raise ValueError(f"no backend {p!r}; known: {sorted(_backends)}")
    return parts


OUT_OF_MEMORY = ("out of memory", "cublas_status_alloc_failed")  # fixed values


def _with_retry(f: Callable[[bytes], str], content: bytes, limit_s: float = 180.0, first_s: float = 5.0) -> str:
    """Retries out-of-memory errors only, waiting twice as long each time, until the limit."""
    waited, pause = 0.0, first_s
    while True:
        try:
            return f(content)
        except Exception as e:
            if not ("outofmemory" in type(e).__name__.lower() or any(m in str(e).lower() for m in OUT_OF_MEMORY)) or waited + pause > limit_s:
                raise
            time.sleep(pause)
            waited, pause = waited + pause, pause * 2


def infer(images: DataFrame, name: str) -> DataFrame:
    """Adds tags and prose to rows with content (binary); a failing row has error, the rest go on."""
    out = images.withColumn("tags", F.lit("")).withColumn("prose", F.lit("")).withColumn("error", F.lit(None).cast("string"))
    for part in backend(name):
        load, kind = _backends[part]

        def run(batches: Iterator[pd.DataFrame], part=part, load=load, kind=kind) -> Iterator[pd.DataFrame]:
            if part not in _loaded:
                _loaded[part] = load()
            for batch in batches:
                said, errors = list(batch[kind]), list(batch["error"])
                for i, content in enumerate(batch["content"]):
                    try:
                        said[i] = _with_retry(_loaded[part], content)
                    except Exception as e:  # a row's error is its own result
                        errors[i] = str(e)
                yield batch.assign(**{kind: said, "error": errors})

        out = out.mapInPandas(run, out.schema)
    return out


def routed(raw: Column, style: Column, name: Column) -> tuple[Column, Column]:
    """(tags, prose): raw text is tags for an anime style or a tagger, else prose."""
    is_tags = (style == "anime") | (name == "wd14")
    return F.when(is_tags, raw).otherwise(""), F.when(is_tags, "").otherwise(raw)


def hybrid(df: DataFrame) -> DataFrame:
    return df.withColumn("caption", hybrid_string(F.col("tags"), F.col("prose")))


def caption_or_tags(prose: Column, tags: Column) -> Column:
    """Prose if there is any, else the labels."""
    return F.coalesce(F.nullif(prose, F.lit("")), T.tag_string(tags))
