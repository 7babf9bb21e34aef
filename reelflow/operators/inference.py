"""Pluggable generators over request tables (UDF-1 … UDF-4).

A generator is a class registered by name. ``generate_text`` /
``generate_images`` run it with ``mapInPandas``: rows arrive in Arrow batches,
the generator is built once per task (lazy model load, UDF-3) and each row is
isolated — a failure becomes ``status='error'`` with the message, the batch
goes on (UDF-4). Unknown names fail on the driver before any job starts, like
the original factories. Real model clients are out of scope; tests and the
query catalogue use deterministic stubs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from reelflow.session import ship_package

TEXT_GENERATORS: dict[str, type] = {}
IMAGE_GENERATORS: dict[str, type] = {}

TEXT_OUT = "video_id {key}, backend STRING, model STRING, status STRING, error STRING, content STRING"
IMAGE_OUT = ("video_id {key}, section_index INT, backend STRING, status STRING, error STRING, image_path STRING, "
             "timestamp DOUBLE, prompt STRING, revised_prompt STRING, seed BIGINT")


def _out_schema(template: str, requests: DataFrame) -> str:
    """Output DDL with the video key typed like the input (numeric ids or video names)."""
    return template.format(key=requests.schema["video_id"].dataType.simpleString())


def register_text(name: str):
    def deco(cls):
        TEXT_GENERATORS[name] = cls
        return cls
    return deco


def register_image(name: str):
    def deco(cls):
        IMAGE_GENERATORS[name] = cls
        return cls
    return deco


def _lookup(registry: dict, name: str, kind: str) -> type:
    if name not in registry:
        raise ValueError(f"Unsupported {kind} generator: {name}. Supported: {', '.join(sorted(registry))}")
    return registry[name]


def generate_text(requests: DataFrame, generator: str, num_partitions: int | None = None, **options) -> DataFrame:
    """UDF-1: run a text generator over ``(video_id, backend, model, prompt)`` rows.

    ``num_partitions`` deals the requests evenly over that many tasks before the
    model is called, so that the number of callers does not depend on what
    earlier steps left; None keeps the partitions as they are.
    """
    cls = _lookup(TEXT_GENERATORS, generator, "text")
    ship_package(requests.sparkSession)
    requests = requests if num_partitions is None else requests.repartition(num_partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = cls(**options)                       # once per task, on first use
        for pdf in batches:
            status, error, content = [], [], []
            for row in pdf.itertuples(index=False):
                try:
                    content.append(gen.generate(row))
                    status.append("ok")
                    error.append(None)
                except Exception as e:     # noqa: BLE001 — per-row isolation
                    content.append(None)
                    status.append("error")
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"video_id": pdf["video_id"], "backend": pdf["backend"], "model": pdf["model"],
                                "status": status, "error": error, "content": content})

    return requests.select("video_id", "backend", "model", "prompt").mapInPandas(run, _out_schema(TEXT_OUT, requests))


def generate_images(requests: DataFrame, generator: str, num_partitions: int | None = None, **options) -> DataFrame:
    """UDF-2: run an image generator over image request rows; one DM-15 record per row.

    ``num_partitions`` as for :func:`generate_text`.
    """
    cls = _lookup(IMAGE_GENERATORS, generator, "image")
    ship_package(requests.sparkSession)
    requests = requests if num_partitions is None else requests.repartition(num_partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gen = cls(**options)
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                rec = {"video_id": row.video_id, "section_index": row.section_index, "backend": row.backend,
                       "status": "ok", "error": None, "image_path": None, "timestamp": row.start_time,
                       "prompt": row.full_prompt, "revised_prompt": None, "seed": None}
                try:
                    rec.update(gen.generate(row))
                except Exception as e:     # noqa: BLE001 — warn and go on
                    rec["status"], rec["error"] = "error", f"{type(e).__name__}: {e}"
                out.append(rec)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in IMAGE_OUT.split(", ")])

    cols = ["video_id", "section_index", "backend", "start_time", "full_prompt", "frame_file"]
    return requests.select(*cols).mapInPandas(run, _out_schema(IMAGE_OUT, requests))


def text_udf(generator: str, batch_size: int = 64, **options):
    """UDF-3 as a column function: ``predict_batch_udf`` loads the generator once per Python worker.

    ``df.withColumn("content", text_udf("stub")("video_id", "prompt"))``. Rows
    that fail come back as NULL (use :func:`generate_text` to keep the error).
    Returns ``None`` when ``pyspark.ml`` is not importable.
    """
    try:
        from pyspark.ml.functions import predict_batch_udf
    except ImportError:          # pragma: no cover — optional dependency of pyspark.ml
        return None
    import numpy as np
    from pyspark.sql.types import StringType

    cls = _lookup(TEXT_GENERATORS, generator, "text")
    if (spark := SparkSession.getActiveSession()) is not None:
        ship_package(spark)

    def make_predict_fn():
        gen = cls(**options)                       # once per worker process

        def predict(video_ids: np.ndarray, prompts: np.ndarray) -> np.ndarray:
            out = []
            for vid, prompt in zip(video_ids, prompts):
                try:
                    own = vid.item() if hasattr(vid, "item") else vid     # a numeric id stays a number, a name a string
                    out.append(gen.generate(_Row(video_id=own, prompt=str(prompt))))
                except Exception:  # noqa: BLE001 — per-row isolation
                    out.append(None)
            return np.array(out, dtype=object)

        return predict

    return predict_batch_udf(make_predict_fn, return_type=StringType(), batch_size=batch_size)


class _Row:
    def __init__(self, **kw):
        self.__dict__.update(kw)


# ---------------------------------------------------------------- deterministic stubs
@register_text("stub")
class StubTextGenerator:
    """Answers one section carrying the prompt's character count; fails for numeric ids ≡ 7 (mod 10)."""

    def __init__(self, fail_mod: int = 10, fail_rest: int = 7):
        self.fail_mod, self.fail_rest = fail_mod, fail_rest

    def generate(self, row) -> str:
        if isinstance(row.video_id, int) and row.video_id % self.fail_mod == self.fail_rest:
            raise RuntimeError("stub backend unavailable")
        return ('{"sections": [{"start_time": 0.0, "n_chars": ' + str(len(row.prompt)) +
                ', "image_prompt": "stub ' + str(row.video_id) + '"}]}')


@register_image("stub")
class StubImageGenerator:
    """Writes nothing; reports the path a frame would get and a seed; fails when (id + index) % 7 == 3."""

    def generate(self, row) -> dict:
        numeric = isinstance(row.video_id, int)
        if numeric and (row.video_id + row.section_index) % 7 == 3:
            raise RuntimeError("stub render failed")
        return {"image_path": f"generated_images/video_{row.video_id}/{row.frame_file}",
                "seed": (int(row.video_id) * 1000 if numeric else 0) + int(row.section_index),
                "revised_prompt": (row.full_prompt[:50] if row.backend == "openai" else None)}

