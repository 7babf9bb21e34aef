"""Image requests, results, manifests and frame timing.

(SRC-8, STR-5…7, TIM-4, DEF-3/4/5, JSN-6…8, FLT-4, JOI-4, AGG-8/12, WIN-2…5, SET-3)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelflow import fixed_values as FV
from reelflow.functions import clock, defaults, jsonx, text
from reelflow.operators.blocked import join_on, running_sum
from reelflow.operators.ordered import ordered_collect, ordered_concat

OUTPUT_ROOT = "generated_images"


def section_keys(*frames: DataFrame) -> list[str]:
    """What names a list of sections: the video, and the text backend and model where all ``frames`` carry them."""
    return ["video_id", *[c for c in ("text_backend", "text_model") if all(c in f.columns for f in frames)]]


def explode_sections(docs: DataFrame, key: str = "video_id") -> DataFrame:
    """SRC-8: one row per section of a prompts document, with its list index."""
    return (docs.select(key, F.posexplode(F.coalesce("sections", F.array())).alias("section_index", "s"))
                .select(key, F.col("section_index").cast("int"),
                        *[F.col("s").getField(f).alias(f) for f in FV.SECTION_FIELDS]))


def backend_for(video_id: Column) -> Column:
    """Corpus assignment of videos to image backends."""
    return F.when(video_id % 3 == 0, "diffusers").when(video_id % 3 == 1, "openai").otherwise("stability")


def backend_settings(overrides: dict | None = None) -> dict[str, dict]:
    """DEF-4: per-backend generation settings; a call-time override replaces the instance default."""
    o = overrides or {}
    w, h = o.get("image_size", FV.DIFFUSERS_SIZE)
    return {
        "diffusers": {"num_inference_steps": o.get("num_inference_steps", FV.DIFFUSERS_STEPS),
                      "guidance_scale": o.get("guidance_scale", FV.DIFFUSERS_GUIDANCE), "image_size": (w, h)},
        "openai": {"quality": o.get("quality", FV.OPENAI_QUALITY), "size": o.get("size", FV.OPENAI_SIZE)},
        "stability": {"aspect_ratio": o.get("aspect_ratio", FV.STABILITY_ASPECT_RATIO),
                      "output_format": o.get("output_format", FV.STABILITY_FORMAT)},
    }


def extension(backend: Column, overrides: dict | None = None) -> Column:
    """File extension: the hosted diffusion API writes its output format, the others PNG."""
    fmt = backend_settings(overrides)["stability"]["output_format"]
    return F.when(backend == "stability", F.lit(fmt)).otherwise(F.lit("png"))


def full_prompt(backend: Column, prompt: Column, style: Column) -> Column:
    """STR-6 (+ STR-7 for the hosted DALL-E backend, which has a length limit)."""
    p = text.styled_prompt(prompt, style)
    return F.when(backend == "openai", text.cap_prompt(p)).otherwise(p)


def settings(backend: Column, negative: Column, overrides: dict | None = None) -> Column:
    """DEF-4: per-backend settings as a string map (keys differ per backend)."""
    st = backend_settings(overrides)
    d = st["diffusers"]
    w, h = d["image_size"]
    diff = defaults.lit_map({"num_inference_steps": str(d["num_inference_steps"]),
                             "guidance_scale": str(d["guidance_scale"]), "image_size": f"[{w}, {h}]"})
    diff = F.map_concat(diff, F.create_map(F.lit("negative_prompt"), negative))
    oai = defaults.lit_map({k: str(v) for k, v in st["openai"].items()})
    stab = F.map_concat(defaults.lit_map({k: str(v) for k, v in st["stability"].items()}),
                        F.create_map(F.lit("negative_prompt"), negative))
    return F.when(backend == "diffusers", diff).when(backend == "openai", oai).otherwise(stab)


def payload(backend: Column, model: Column, prompt: Column, negative: Column, overrides: dict | None = None) -> Column:
    """JSN-6: the request each image backend receives, serialised with nulls kept."""
    opts = {"ignoreNullFields": "false"}
    st = backend_settings(overrides)
    d, o, s = st["diffusers"], st["openai"], st["stability"]
    w, h = d["image_size"]
    diff = F.to_json(F.struct(prompt.alias("prompt"), negative.alias("negative_prompt"),
                              F.lit(d["num_inference_steps"]).alias("num_inference_steps"),
                              F.lit(float(d["guidance_scale"])).alias("guidance_scale"),
                              F.lit(w).alias("width"), F.lit(h).alias("height")), opts)
    oai = F.to_json(F.struct(model.alias("model"), prompt.alias("prompt"), F.lit(o["size"]).alias("size"),
                             F.lit(o["quality"]).alias("quality"), F.lit(1).alias("n")), opts)
    stab = F.to_json(F.struct(prompt.alias("prompt"), negative.alias("negative_prompt"),
                              F.lit(s["aspect_ratio"]).alias("aspect_ratio"),
                              F.lit(s["output_format"]).alias("output_format"), model.alias("model"),
                              F.lit("text-to-image").alias("mode")), opts)
    return F.when(backend == "diffusers", diff).when(backend == "openai", oai).otherwise(stab)


def image_requests(secs: DataFrame, backend: Column | None = None, model: str | None = None,
                   negative_prompt: str | None = None, overrides: dict | None = None) -> DataFrame:
    """One generation request per section.

    ``(video_id, section_index, start_time, backend, model, full_prompt, negative_prompt, frame_file, payload)``,
    and the sections' ``text_backend`` and ``text_model`` where they have them;
    ``model`` (DEF-5), ``negative_prompt`` (DEF-3) and ``overrides`` (DEF-4) are call-time choices that
    replace the backend defaults.
    """
    b = backend_for(F.col("video_id")) if backend is None else backend
    neg_override = None if negative_prompt is None else F.lit(negative_prompt)
    model_override = None if model is None else F.lit(model)
    d = secs.withColumn("backend", b).withColumns({
        "model": defaults.image_model("backend", model_override),
        "full_prompt": full_prompt(F.col("backend"), F.col("image_prompt"), F.col("visual_style")),
        "negative_prompt": defaults.negative_prompt("backend", neg_override),
        "frame_file": clock.frame_file(F.coalesce("start_time", F.lit(0.0)), extension(F.col("backend"), overrides)),
    })
    return d.select(*section_keys(secs), "section_index", "start_time", "backend", "model", "full_prompt",
                    "negative_prompt", "frame_file",
                    payload(F.col("backend"), F.col("model"), F.col("full_prompt"),
                            F.col("negative_prompt"), overrides).alias("payload"))


def image_records(secs: DataFrame, results: DataFrame, video_name: Column | None = None,
                  overrides: dict | None = None) -> DataFrame:
    """JOI-4 / FLT-4 / JSN-8: one record per successful image, one wide schema for every backend.

    The prompt and frame name follow the backend each result reports. Failed
    sections leave gaps in ``section_index``. A result belongs to the section of
    its own text backend and model, where both sides name them.
    """
    keys = section_keys(secs, results)
    ok = results.filter(F.col("status_code") == 200)
    sec = secs.select(*keys, "section_index", "start_time", "image_prompt", "visual_style")
    j = ok.join(sec, [*keys, "section_index"])
    name = text.video_label(j) if video_name is None else video_name
    revised = F.col("revised_prompt") if "revised_prompt" in j.columns else F.lit(None).cast("string")
    seed = F.col("seed") if "seed" in j.columns else F.lit(None)
    frame = clock.frame_file(F.coalesce("start_time", F.lit(0.0)), extension(F.col("backend"), overrides))
    return j.select(
        *keys, "section_index", "backend",
        F.concat_ws("/", F.lit(OUTPUT_ROOT), name, frame).alias("image_path"),
        F.coalesce("start_time", F.lit(0.0)).alias("timestamp"),
        full_prompt(F.col("backend"), F.col("image_prompt"), F.col("visual_style")).alias("prompt"),
        revised.alias("revised_prompt"),
        seed.cast("bigint").alias("seed"),
        frame.alias("frame_file"),
    )


def manifest(secs: DataFrame, results: DataFrame, generated_at: str | None = None,
             default_backend: str = "diffusers", videos: DataFrame | None = None, model: str | None = None,
             negative_prompt: str | None = None, overrides: dict | None = None) -> DataFrame:
    """AGG-8 / SNK-6: the nested manifest document (DM-16) per video, text backend and model, and image backend.

    Every list of sections gets a manifest, also when all images failed; with
    ``videos`` (the same key columns), so does every listed one (e.g. a prompts
    document with no sections). The image backends are those that the results
    report, the default where there are none. The ``images`` list is the
    document itself, sorted by section index. ``model``, ``negative_prompt`` and
    ``overrides`` are those of the call that made the images (``image_requests``).
    """
    rec = image_records(secs, results, overrides=overrides)
    keys = section_keys(secs, results)
    per = ordered_collect(rec, [*keys, "backend"], "section_index",
                          F.struct("image_path", "timestamp", "prompt", "section_index", "revised_prompt", "seed"),
                          "_imgs", sums={"num_images": F.lit(1).cast("bigint")})
    used = results.select(*keys, F.col("backend").alias("_b")).distinct()
    listed = secs.select(*keys) if videos is None else secs.select(*keys).unionByName(videos.select(*keys))
    vids = (join_on(listed.distinct(), used, keys, "left")
            .select(*keys, F.coalesce("_b", F.lit(default_backend)).alias("backend")))
    name = text.video_label(vids)
    neg = defaults.negative_prompt("backend", None if negative_prompt is None else F.lit(negative_prompt))
    d = join_on(vids, per, [*keys, "backend"], "left")
    images = F.coalesce("_imgs", F.array().cast(per.schema["_imgs"].dataType))
    return d.select(
        *keys, name.alias("video_name"),
        F.concat(name, F.lit("_prompts.json")).alias("prompts_file"),
        F.concat_ws("/", F.lit(OUTPUT_ROOT), name).alias("output_dir"),
        defaults.image_model("backend", None if model is None else F.lit(model)).alias("model"), "backend",
        F.when(F.col("backend") == "diffusers", F.lit("cpu")).alias("device"),
        F.coalesce("num_images", F.lit(0)).alias("num_images"),
        F.lit(generated_at).cast("string").alias("generated_at"),
        settings(F.col("backend"), neg, overrides).alias("settings"),
        images.alias("images"),
    )


def manifest_flat(secs: DataFrame, results: DataFrame) -> DataFrame:
    """The manifest in flat form: counts and the image list as ordered strings (two-level concat)."""
    rec = image_records(secs, results)
    n_sec = secs.groupBy("video_id").agg(F.count(F.lit(1)).alias("num_sections"))
    idx = ordered_concat(rec, ["video_id"], "section_index", F.col("section_index").cast("string"), ",",
                         "image_indices", count_as="num_images", more={"frame_files": ("frame_file", ",")})
    d = join_on(n_sec, idx, ["video_id"], "left")
    b = backend_for(F.col("video_id"))
    return d.select("video_id", b.alias("backend"), defaults.image_model(b).alias("model"), "num_sections",
                    F.coalesce("num_images", F.lit(0)).alias("num_images"),
                    F.coalesce("image_indices", F.lit("")).alias("image_indices"),
                    F.coalesce("frame_files", F.lit("")).alias("frame_files"),
                    F.to_json(settings(b, defaults.negative_prompt(b))).alias("settings"))


def payload_bytes(results: DataFrame) -> DataFrame:
    """JSN-7: decode the base64 image of each successful answer; invalid base64 → NULL bytes."""
    ok = results.filter(F.col("status_code") == 200)
    d = ok.withColumn("_bin", jsonx.decode_base64("image_b64"))
    return d.select("video_id", "section_index", "backend", F.col("_bin").isNotNull().alias("valid"),
                    F.length("_bin").cast("bigint").alias("n_bytes"), F.sha2("_bin", 256).alias("sha256"))


def cost(results: DataFrame, prices: DataFrame) -> DataFrame:
    """AGG-12: images × unit price per backend, in DECIMAL.

    Both sides have one row per backend after the aggregate; Spark picks the join.
    """
    n = results.filter(F.col("status_code") == 200).groupBy("backend").agg(F.count(F.lit(1)).alias("n_images"))
    j = n.join(prices, "backend", "left")
    return j.select("backend", "n_images", F.col("unit_price").cast("decimal(10,4)").alias("unit_price"),
                    (F.col("n_images").cast("decimal(18,0)") * F.col("unit_price")).cast("decimal(18,4)")
                    .alias("total_cost"))


def progress(secs: DataFrame, results: DataFrame) -> DataFrame:
    """WIN-2 / WIN-3: per attempted section, attempts and successes so far over the video total.

    One blocked running sum counts attempts and successes together (attempts in
    units of 2**31, so a video may have that many sections), and the video total
    rides on the same per-block table: rows are never gathered per video, and
    gaps in ``section_index`` count for nothing.
    """
    a = secs.select("video_id", "section_index").join(
        results.select("video_id", "section_index", "status_code"), ["video_id", "section_index"], "left")
    both = F.lit(1 << 31) + F.when(F.col("status_code") == 200, 1).otherwise(0)
    d = running_sum(a, ["video_id"], "section_index", both, "_both", key_totals={"total": F.lit(1).cast("bigint")})
    d = d.withColumns({"attempted": F.shiftright("_both", 31), "succeeded": F.col("_both") % F.lit(1 << 31)})
    return d.select("video_id", "section_index", "attempted", "succeeded", "total",
                    (100.0 * F.col("attempted") / F.col("total")).alias("progress_pct"))


def frame_collisions(secs: DataFrame, results: DataFrame) -> DataFrame:
    """WIN-5: sections whose frames share a file name (same millisecond); the later section wins.

    A position-blocked running count inside ``(video, file name)`` gives each
    image its rank, and the group size travels on the per-block table: the
    winner is the image whose rank equals the size. No join on the file name,
    so even one crowded name (every section missing its start) stays spread.
    """
    rec = image_records(secs, results).select("video_id", "section_index", "frame_file")
    d = running_sum(rec, ["video_id", "frame_file"], "section_index", F.lit(1).cast("bigint"), "_rank",
                    key_totals={"n_same_file": F.lit(1).cast("bigint")})
    return d.select("video_id", "section_index", "frame_file", "n_same_file",
                    (F.col("_rank") == F.col("n_same_file")).alias("is_winner"))


def preview(secs: DataFrame, n: int = 3) -> DataFrame:
    """SRT-2 / SRT-3 / STR-11: the first ``n`` sections per video and how many more there are.

    Spark keeps the first ``n`` of a video in every task before it shuffles them (a group limit below the window), so
    no other row moves, and the window of a hot video sees ``n`` rows a task. The counts are partial aggregates.
    """
    first = F.row_number().over(Window.partitionBy("video_id").orderBy("section_index"))
    best = secs.withColumn("_rank", first).filter(F.col("_rank") <= n)
    d = join_on(best, secs.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n")), ["video_id"])
    scene = F.col("scene_description") if "scene_description" in secs.columns else F.lit(None).cast("string")
    return d.select(
        "video_id", "section_index", (F.col("section_index") + 1).cast("int").alias("section_no"),
        clock.one_decimal(F.coalesce("start_time", F.lit(0.0))).alias("start_text"),
        clock.one_decimal(F.coalesce("end_time", F.lit(0.0))).alias("end_text"),
        F.coalesce(scene, F.lit("N/A")).alias("scene"),
        text.preview(F.col("image_prompt")).alias("prompt_preview"),
        F.coalesce("visual_style", F.lit("N/A")).alias("style"),
        F.greatest(F.col("_n") - n, F.lit(0)).alias("more_sections"),
    )


def merge_backend_records(*frames: DataFrame) -> DataFrame:
    """SET-3: merge image records from several backends; fields a backend lacks become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
