"""Work planning against an inventory of finished artefacts.

URL requests (URL-1…4, JOI-2/3, FLT-3) and model download batches (SRC-4,
SET-2, JOI-1, STR-9, TIM-5, FLT-1/2/9, AGG-5/6/9/10, SET-1).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions import clock, text, urls
from reelflow.operators.ordered import ordered_collect


# ------------------------------------------------------------------ URLs
def canonical_requests(requests: DataFrame) -> DataFrame:
    """``(request_id, url, shorts_id, canonical_url, video_key)``; one row per request."""
    return requests.select(
        "request_id", "url",
        urls.shorts_id("url").alias("shorts_id"),
        urls.canonical_url("url").alias("canonical_url"),
    ).withColumn("video_key", urls.watch_id("canonical_url"))


def pending(canon: DataFrame, inventory: DataFrame, force: bool = False) -> DataFrame:
    """JOI-2 / FLT-3: requests whose artefact is not in the inventory (all of them with ``force``).

    A shuffle (or, when AQE measures the inventory small, broadcast) anti join;
    AQE splits a hot canonical URL on the request side.
    """
    if force:
        return canon
    return canon.join(inventory.select(F.col("key").alias("canonical_url")), "canonical_url", "left_anti")


def done(canon: DataFrame, inventory: DataFrame, force: bool = False) -> DataFrame:
    """JOI-3: requests already satisfied by the inventory (none with ``force``)."""
    if force:
        return canon.filter(F.lit(False))
    return canon.join(inventory.select(F.col("key").alias("canonical_url")), "canonical_url", "left_semi")


# ------------------------------------------------------------------ models
def catalogue(spark: SparkSession) -> DataFrame:
    """SRC-4: the speech-model catalogue (5 fixed rows — safe to broadcast)."""
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(r).alias("repo"),
                     F.lit(float(s)).alias("size_gb"), F.lit(d).alias("description"))
            for i, (n, r, s, d) in enumerate(FV.SPEECH_MODELS)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def expand_requests(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """SET-2: a batch without a list asks for every catalogue model (in catalogue order).

    An explicit empty list asks for none. Returns ``(batch_id, pos, name)``.
    """
    names = F.array(*[F.lit(m[0]) for m in FV.SPEECH_MODELS])
    everything = (batches.filter("all_models")
                         .select("batch_id", F.posexplode(names).alias("pos", "name"))
                         .withColumn("pos", F.col("pos").cast("int")))
    return requests.select("batch_id", "pos", "name").unionByName(everything)


def model_plan(spark: SparkSession, batches: DataFrame, requests: DataFrame,
               present: DataFrame | None = None) -> DataFrame:
    """One row per requested model: catalogue facts, cache folder and the action to take.

    ``present`` lists cache folders already on disk (``key``); ``action`` is
    ``invalid`` (unknown name), ``skip_existing`` (present and not forced) or
    ``download``.
    """
    cat = catalogue(spark)
    rows = (expand_requests(batches, requests)
            .join(batches.select("batch_id", "force"), "batch_id")
            .join(F.broadcast(cat.drop("ord")), "name", "left"))
    rows = rows.withColumn("cache_dir", text.cache_dir_name("repo")) \
               .withColumn("size_text", clock.size_text("size_gb"))
    if present is None:
        present = spark.range(0).select(F.lit(None).cast("string").alias("key"))
    # only catalogue folders can match, so the present set is cut to at most the catalogue's 5 rows
    # first: a proven bound, which makes it safe to broadcast (the request side is never shuffled on
    # a popular model's folder)
    cat_dirs = cat.select(text.cache_dir_name("repo").alias("cache_dir"))
    have = (present.select(F.col("key").alias("cache_dir")).join(F.broadcast(cat_dirs), "cache_dir", "left_semi")
                   .distinct().withColumn("_present", F.lit(True)))
    rows = rows.join(F.broadcast(have), "cache_dir", "left")
    action = (F.when(F.col("repo").isNull(), "invalid")
               .when(F.coalesce("_present", F.lit(False)) & ~F.col("force"), "skip_existing")
               .otherwise("download"))
    return rows.select("batch_id", "pos", "name", "repo", "size_gb", "description", "cache_dir", "size_text",
                       "force", action.alias("action"))


def batch_results(batches: DataFrame, plan: DataFrame, skip_space_check: bool = False,
                  outcomes: DataFrame | None = None) -> DataFrame:
    """DM-4 per batch: all-or-nothing checks first, then what each download returned.

    Any unknown name fails the whole batch (FLT-2); so does too little disk
    space unless ``skip_space_check`` (FLT-9: free ≥ size + 1 GB; unknown free
    space passes). A batch that passes is split by ``outcomes`` (``batch_id,
    pos, ok``): a download that reports failure is in ``failed``, one that
    succeeded, was skipped as present or has no row is in ``successful``; both
    lists keep the order of the request. Sizes are summed as DECIMAL so the
    comparison does not depend on summation order; the name lists are collected
    in two levels.
    """
    if outcomes is None:
        plan = plan.withColumn("_ok", F.lit(True))
    else:
        told = outcomes.groupBy("batch_id", "pos").agg(F.bool_and("ok").alias("_told"))
        plan = (plan.join(told, ["batch_id", "pos"], "left")
                    .withColumn("_ok", (F.col("action") != "download") | F.coalesce("_told", F.lit(True))))
    per = ordered_collect(plan, ["batch_id"], "pos", F.struct("name", F.col("_ok").alias("ok")), "names", sums={
        "n_requested": F.lit(1).cast("bigint"),
        "n_invalid": F.when(F.col("action") == "invalid", 1).otherwise(0).cast("bigint"),
        "total_size_gb": F.col("size_gb").cast("decimal(12,3)"),
    })
    b = batches.join(per, "batch_id", "left")
    n_req = F.coalesce("n_requested", F.lit(0))
    total = F.coalesce("total_size_gb", F.lit(0).cast("decimal(12,3)"))
    space_ok = F.col("free_gb").isNull() | (F.col("free_gb") >= total.cast("double") + FV.DISK_BUFFER_GB)
    if skip_space_check:
        space_ok = F.lit(True)
    status = (F.when(F.coalesce("n_invalid", F.lit(0)) > 0, "invalid_names")
               .when(~space_ok, "insufficient_space").otherwise("ok"))
    asked = F.coalesce("names", F.array().cast("array<struct<name:string,ok:boolean>>"))
    names = F.transform(asked, lambda n: n["name"])
    done = F.transform(F.filter(asked, lambda n: n["ok"]), lambda n: n["name"])
    failed = F.transform(F.filter(asked, lambda n: ~n["ok"]), lambda n: n["name"])
    out = b.select(
        "batch_id", n_req.alias("n_requested"), F.coalesce("n_invalid", F.lit(0)).alias("n_invalid"),
        total.cast("double").alias("total_size_gb"), space_ok.alias("space_ok"), status.alias("status"),
        F.when(status == "ok", done).otherwise(F.array().cast("array<string>")).alias("successful"),
        F.when(status == "ok", failed).otherwise(names).alias("failed"),
    )
    return out.withColumn("any_success", F.size("successful") > 0) \
              .withColumn("success_rate",
                          F.when(F.col("n_requested") > 0,
                                 100.0 * F.size("successful") / F.col("n_requested")))
