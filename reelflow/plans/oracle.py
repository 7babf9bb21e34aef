"""DuckDB twin of every SQL-expressible query in ``reelflow.plans.catalog``.

Each string runs on DuckDB with the driver tables registered as views; derived
views are inlined as CTEs. Column names and types match the Spark side.
"""

from __future__ import annotations

from reelflow import fixed_values as FV
from reelflow.plans import sqlparts as S
from reelflow.plans.catalog import PRESENT_MODELS
from reelflow.plans.sqlparts import with_views

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLE[name] = with_views(sql, *views)


# ------------------------------------------------------------------ M0 / M1
oracle("timeline_text", f"""
SELECT video_id,
       string_agg({S.timeline_line('start_s', 'end_s', 'text')}, chr(10) ORDER BY pos) AS transcript,
       count(*) AS num_segments
FROM segments GROUP BY video_id""", "segments")

oracle("srt_cues", f"""
SELECT video_id, pos, cue_index, start_clock, end_clock, text,
       concat(CAST(cue_index AS VARCHAR), chr(10), start_clock, ' --> ', end_clock, chr(10), text, chr(10), chr(10)) AS cue
FROM (SELECT video_id, pos, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) AS INT) AS cue_index,
             {S.srt_clock('start_s')} AS start_clock,
             {S.srt_clock('end_s')} AS end_clock, {S.strip('text')} AS text FROM segments) a""", "segments")

oracle("vtt_cues", f"""
SELECT video_id, pos, start_clock, end_clock, text,
       concat(start_clock, ' --> ', end_clock, chr(10), text, chr(10), chr(10)) AS cue
FROM (SELECT video_id, pos, {S.vtt_clock('start_s')} AS start_clock,
             {S.vtt_clock('end_s')} AS end_clock, {S.strip('text')} AS text FROM segments) a""", "segments")

oracle("srt_body", f"""
SELECT video_id, count(*) AS num_cues,
       string_agg(concat(CAST(pos + 1 AS VARCHAR), chr(10), {S.srt_clock('start_s')}, ' --> ', {S.srt_clock('end_s')},
                         chr(10), {S.strip('text')}, chr(10), chr(10)), '' ORDER BY pos) AS body
FROM segments GROUP BY video_id""", "segments")

oracle("vtt_body", f"""
SELECT video_id, count(*) AS num_cues,
       concat('WEBVTT', chr(10), chr(10),
              string_agg(concat({S.vtt_clock('start_s')}, ' --> ', {S.vtt_clock('end_s')}, chr(10), {S.strip('text')},
                                chr(10), chr(10)), '' ORDER BY pos)) AS body
FROM segments GROUP BY video_id""", "segments")

oracle("clips", f"""
SELECT video_id, pos, start_s AS start, end_s AS "end", {S.strip('text')} AS text FROM segments""", "segments")

oracle("word_timeline", f"""
SELECT video_id, pos, word_pos, word,
       start_s + (end_s - start_s) * (upto - length(word)) / total AS word_start,
       start_s + (end_s - start_s) * upto / total AS word_end
FROM (SELECT *, sum(length(word)) OVER (PARTITION BY video_id, pos ORDER BY word_pos
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
                sum(length(word)) OVER (PARTITION BY video_id, pos) AS total
      FROM (SELECT video_id, pos, start_s, end_s, CAST(w.i - 1 AS INT) AS word_pos, w.word
            FROM segments,
                 LATERAL (SELECT unnest(parts) AS word, generate_subscripts(parts, 1) AS i
                          FROM (SELECT list_filter(string_split_regex(text, '{S.SPACE}+'), lambda x: x <> '') AS parts))
                 AS w) a
      WHERE length(word) > 0) b""", "segments")


# ------------------------------------------------------------------ M2: URLs and planning

_WATCH_ID = r"^https://www\.youtube\.com/watch\?v=([^&#]+)"
_CANON = f"""
SELECT request_id, url, shorts_id, canonical_url, nullif(regexp_extract(canonical_url, '{_WATCH_ID}', 1), '') AS video_key
FROM (SELECT request_id, url, nullif(regexp_extract(url, 'youtu(?:be[.]com|[.]be)/shorts/([[:alnum:]_-]{{5,}})', 1), '') AS shorts_id,
             {S.canonical_url('url')} AS canonical_url FROM requests) a"""

oracle("canonical_urls", _CANON, "requests")
oracle("pending_requests", f"""
SELECT request_id, canonical_url, video_key FROM ({_CANON}) c
WHERE canonical_url NOT IN (SELECT key FROM inventory)""", "requests", "inventory")
oracle("done_requests", f"""
SELECT request_id, canonical_url, video_key FROM ({_CANON}) c
WHERE canonical_url IN (SELECT key FROM inventory)""", "requests", "inventory")

_PRESENT = ", ".join(f"'{n}'" for n in PRESENT_MODELS)
_PLAN = f"""
SELECT e.batch_id, e.pos, e.name, c.repo, c.size_gb, c.description,
       'models--' || replace(c.repo, '/', '--') AS cache_dir,
       printf('%.2f', c.size_gb) || 'GB' AS size_text, b.force,
       CASE WHEN c.repo IS NULL THEN 'invalid'
            WHEN c.name IN ({_PRESENT}) AND NOT b.force THEN 'skip_existing' ELSE 'download' END AS action
FROM (SELECT batch_id, pos, name FROM model_requests
      UNION ALL
      SELECT b.batch_id, CAST(c.ord AS INT) AS pos, c.name FROM model_batches b JOIN catalogue c ON b.all_models) e
JOIN model_batches b USING (batch_id)
LEFT JOIN catalogue c USING (name)"""
oracle("model_plan", _PLAN, "model_requests", "model_batches", "catalogue")

oracle("batch_validation", f"""
SELECT batch_id, n_requested, n_invalid, total_size_gb, space_ok, status,
       CASE WHEN status = 'ok' THEN done ELSE '' END AS successful,
       CASE WHEN status = 'ok' THEN failures ELSE names END AS failed,
       status = 'ok' AND n_done > 0 AS any_success,
       CASE WHEN n_requested > 0 THEN CAST(100.0 AS DOUBLE) * (CASE WHEN status = 'ok' THEN n_done ELSE 0 END)
                                      / n_requested END AS success_rate
FROM (SELECT *, CASE WHEN n_invalid > 0 THEN 'invalid_names' WHEN NOT space_ok THEN 'insufficient_space' ELSE 'ok' END AS status
      FROM (SELECT b.batch_id, coalesce(p.n_requested, 0) AS n_requested, coalesce(p.n_invalid, 0) AS n_invalid,
                   coalesce(p.n_done, 0) AS n_done,
                   CAST(coalesce(p.total, 0) AS DOUBLE) AS total_size_gb,
                   b.free_gb IS NULL OR b.free_gb >= CAST(coalesce(p.total, 0) AS DOUBLE) + {FV.DISK_BUFFER_GB} AS space_ok,
                   coalesce(p.names, '') AS names, coalesce(p.done, '') AS done, coalesce(p.failures, '') AS failures
            FROM model_batches b
            LEFT JOIN (SELECT batch_id, count(*) AS n_requested, CAST(count_if(action = 'invalid') AS BIGINT) AS n_invalid,
                              CAST(count_if(ok) AS BIGINT) AS n_done,
                              sum(CAST(size_gb AS DECIMAL(12,3))) AS total,
                              string_agg(name, ',' ORDER BY pos) AS names,
                              string_agg(name, ',' ORDER BY pos) FILTER (ok) AS done,
                              string_agg(name, ',' ORDER BY pos) FILTER (NOT ok) AS failures
                       FROM (SELECT *, action <> 'download' OR (batch_id + pos) % 9 = 0 OR (batch_id + pos) % 4 <> 0 AS ok
                             FROM ({_PLAN}) pl) q GROUP BY batch_id) p USING (batch_id)) x) y""",
       "model_requests", "model_batches", "catalogue")

_LLM = ", ".join(f"'{b}'" for b in FV.LLM_BACKENDS)
_IMG = ", ".join(f"'{b}'" for b in FV.IMAGE_BACKENDS)
oracle("quarantine", f"""
SELECT 'segments' AS source, concat_ws(':', CAST(video_id AS VARCHAR), CAST(pos AS VARCHAR)) AS record_key,
       'missing field: ' || concat_ws(',', CASE WHEN start_s IS NULL THEN 'start' END, CASE WHEN end_s IS NULL THEN 'end' END,
                                       CASE WHEN text IS NULL THEN 'text' END) AS reason
FROM flawed_segments WHERE start_s IS NULL OR end_s IS NULL OR text IS NULL
UNION ALL
SELECT 'llm_responses', CAST(video_id AS VARCHAR), 'unsupported backend: ' || coalesce(backend, 'NULL')
FROM flawed_responses WHERE NOT coalesce(backend IN ({_LLM}), false)
UNION ALL
SELECT 'image_results', concat_ws(':', CAST(video_id AS VARCHAR), CAST(section_index AS VARCHAR)),
       'unsupported backend: ' || coalesce(backend, 'NULL')
FROM flawed_results WHERE NOT coalesce(backend IN ({_IMG}), false)
UNION ALL
SELECT 'image_results', concat_ws(':', CAST(video_id AS VARCHAR), CAST(section_index AS VARCHAR)),
       'http status ' || CAST(status_code AS VARCHAR)
FROM flawed_results WHERE status_code <> 200""", "flawed_segments", "flawed_responses", "flawed_results")

oracle("missing_inputs", f"""
SELECT request_id, stage, reason FROM (
  SELECT request_id,
         CASE WHEN video_id IS NULL THEN 'download' WHEN NOT media THEN 'transcribe'
              WHEN NOT tr THEN 'prompts' WHEN NOT sec THEN 'images' END AS stage,
         CASE WHEN video_id IS NULL THEN 'url names no video' WHEN NOT media THEN 'media file not found'
              WHEN NOT tr THEN 'transcript not found' WHEN NOT sec THEN 'prompts not found' END AS reason
  FROM (SELECT request_id, video_id,
               canonical_url IN (SELECT key FROM inventory) AS media,
               video_id IN (SELECT video_id FROM segments WHERE video_id % 5 <> 0) AS tr,
               video_id IN (SELECT video_id FROM sections WHERE video_id % 5 <> 0 AND video_id % 7 <> 0) AS sec
        FROM (SELECT request_id, canonical_url,
                     TRY_CAST(nullif(regexp_extract(video_key, '^vid_(\\d+)$', 1), '') AS BIGINT) AS video_id
              FROM ({_CANON}) c) a) b) z
WHERE stage IS NOT NULL""", "requests", "inventory", "segments", "sections")


# ------------------------------------------------------------------ M3: requests and responses
_TIMELINE = f"""
SELECT video_id, string_agg({S.timeline_line('start_s', 'end_s', 'text')}, chr(10) ORDER BY pos) AS transcript
FROM segments GROUP BY video_id"""
_MAXTOK = S.case_map("backend", FV.LLM_DEFAULT_MAX_TOKENS, "INT")
_LLM_REQ = f"""
SELECT video_id, backend, model, language, temperature, max_tokens, prompt,
       CASE backend
         WHEN 'openai' THEN to_json({{'model': model, 'messages': [{{'role': 'system', 'content': {S.sql_str(FV.REQUEST_SYSTEM)}}}, {{'role': 'user', 'content': prompt}}],
                                     'temperature': temperature, 'max_tokens': max_tokens,
                                     'response_format': {{'type': 'json_object'}}}})
         WHEN 'anthropic' THEN to_json({{'model': model, 'max_tokens': max_tokens, 'temperature': temperature,
                                        'system': {S.sql_str(FV.REQUEST_SYSTEM)}, 'messages': [{{'role': 'user', 'content': prompt}}]}})
         ELSE to_json({{'model': model, 'prompt': prompt, 'temperature': temperature, 'stream': false}}) END::VARCHAR AS payload
FROM (SELECT video_id, backend, {S.case_map('backend', FV.LLM_DEFAULT_MODEL)} AS model, language,
             CAST({FV.LLM_DEFAULT_TEMPERATURE} AS DOUBLE) AS temperature, {_MAXTOK} AS max_tokens,
             {S.sql_str(FV.REQUEST_TEMPLATE_HEAD)} || language || {S.sql_str(FV.REQUEST_TEMPLATE_MID)} || transcript AS prompt
      FROM (SELECT video_id, {S.backend_for('video_id')} AS backend, '{FV.DEFAULT_LANGUAGE}' AS language, transcript
            FROM ({_TIMELINE}) t) a) b"""
S.VIEWS["llm_requests_q"] = (["segments"], _LLM_REQ)
oracle("llm_requests", "SELECT * FROM llm_requests_q", "llm_requests_q")

oracle("extract_json", f"""
SELECT video_id, backend, {S.extract_for_backend('backend', 'content')} AS extracted FROM llm_responses""",
       "llm_responses")

_E = FV.FALLBACK_EMPTY
_FALLBACK = f"""
SELECT video_id, arg_min(coalesce(start_s, 0.0), pos) AS start_time, arg_max(coalesce(end_s, 0.0), pos) AS end_time,
       string_agg(coalesce(text, ''), ' ' ORDER BY pos) AS full_text
FROM segments GROUP BY video_id"""
_FIELDS = ("start_time", "end_time", "transcript_text", "image_prompt", "sentiment", "scene_description", "visual_style")
_NO_FIELDS = ", ".join(f"CAST(NULL AS {'DOUBLE' if f.endswith('_time') else 'VARCHAR'}) AS {f}" for f in _FIELDS)
_PARSED = f"""
SELECT video_id, backend, model, status, CAST(i - 1 AS INT) AS section_index, {", ".join(f"s.{f}" for f in _FIELDS)},
       CASE WHEN kind <> 'OBJECT' THEN 'item is not an object' END AS reason
FROM (SELECT video_id, backend, model, status, unnest(sections) AS s, generate_subscripts(sections, 1) AS i,
             unnest(kinds) AS kind
      FROM classified WHERE status = 'parsed') p
UNION ALL
SELECT c.video_id, c.backend, c.model, c.status, 0 AS section_index,
       coalesce(f.start_time, {_E['start_time']}), coalesce(f.end_time, {_E['end_time']}),
       CASE WHEN f.full_text IS NULL THEN {S.sql_str(_E['transcript_text'])} ELSE substr(f.full_text, 1, {FV.FALLBACK_TEXT_CHARS}) END,
       CASE WHEN f.full_text IS NULL THEN {S.sql_str(_E['image_prompt'])}
            ELSE {S.sql_str(FV.FALLBACK_PROMPT_PREFIX)} || substr(f.full_text, 1, {FV.FALLBACK_PROMPT_CHARS}) END,
       {S.sql_str(FV.FALLBACK_SENTIMENT)},
       CASE WHEN f.full_text IS NULL THEN {S.sql_str(_E['scene_description'])} ELSE {S.sql_str(FV.FALLBACK_SCENE)} END,
       {S.sql_str(FV.FALLBACK_STYLE)}, NULL
FROM classified c LEFT JOIN ({_FALLBACK}) f USING (video_id) WHERE c.status = 'fallback'
UNION ALL
SELECT video_id, backend, model, status, CAST(NULL AS INT), {_NO_FIELDS},
       CASE WHEN status = 'parsed' THEN 'no sections' WHEN json_type(t, '$.sections') = 'NULL' THEN 'sections is null'
            ELSE 'sections is not a list' END
FROM classified WHERE status = 'error' OR status = 'parsed' AND len(sections) = 0"""
oracle("parsed_sections", _PARSED, "classified", "segments")
oracle("sparse_parsed_sections", _PARSED, "classified", "segments")

oracle("backend_comparison", f"""
SELECT backend, model, count(*) AS n_videos, CAST(count_if(status = 'parsed') AS BIGINT) AS n_parsed,
       CAST(count_if(status = 'fallback') AS BIGINT) AS n_fallback, CAST(count_if(status = 'error') AS BIGINT) AS n_error,
       CAST(sum(CASE status WHEN 'parsed' THEN len(sections) WHEN 'fallback' THEN 1 ELSE 0 END) AS BIGINT) AS n_sections
FROM classified GROUP BY backend, model""", "classified")

_RULE = """
SELECT video_id, CAST(sec - 1 AS INT) AS section_index, arg_min(start_s, pos) AS start_time,
       arg_max(end_s, pos) AS end_time, count(*) AS num_segments,
       string_agg(coalesce(text, ''), ' ' ORDER BY pos) AS transcript_text
FROM (SELECT *, sum(is_new) OVER (PARTITION BY video_id ORDER BY pos
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec
      FROM (SELECT *, CASE WHEN prev_end IS NULL OR start_s - prev_end > 1.0 THEN 1 ELSE 0 END AS is_new
            FROM (SELECT *, lag(end_s) OVER (PARTITION BY video_id ORDER BY pos) AS prev_end FROM segments) a) b) c
GROUP BY video_id, sec"""
for _name in ("rule_sections", "sparse_rule_sections", "stream_sections"):
    oracle(_name, _RULE, "segments")

oracle("sparse_srt_cues", f"""
SELECT video_id, pos, cue_index, start_clock, end_clock, text,
       concat(CAST(cue_index AS VARCHAR), chr(10), start_clock, ' --> ', end_clock, chr(10), text, chr(10), chr(10)) AS cue
FROM (SELECT video_id, pos, CAST(row_number() OVER (PARTITION BY video_id ORDER BY pos) AS INT) AS cue_index,
             {S.srt_clock('start_s')} AS start_clock,
             {S.srt_clock('end_s')} AS end_clock, {S.strip('text')} AS text FROM sparse_segments) a""", "sparse_segments")

oracle("budget_sections", """
SELECT * FROM (WITH RECURSIVE
     o AS (SELECT video_id, start_s, end_s, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY video_id ORDER BY pos) AS n FROM segments),
     cut AS (SELECT video_id, n, 0 AS section, length(text) AS chars FROM o WHERE n = 1
             UNION ALL
             SELECT o.video_id, o.n, CASE WHEN cut.chars + 1 + length(o.text) <= 2000 THEN section ELSE section + 1 END,
                    CASE WHEN cut.chars + 1 + length(o.text) <= 2000 THEN cut.chars + 1 ELSE 0 END + length(o.text)
             FROM cut JOIN o ON o.video_id IS NOT DISTINCT FROM cut.video_id AND o.n = cut.n + 1)
SELECT o.video_id, section AS section_index, arg_min(start_s, o.n) AS start_time, arg_max(end_s, o.n) AS end_time,
       count(*) AS num_segments, string_agg(text, ' ' ORDER BY o.n) AS transcript_text
FROM o JOIN cut ON o.video_id IS NOT DISTINCT FROM cut.video_id AND o.n = cut.n GROUP BY o.video_id, section)""", "segments")


# ------------------------------------------------------------------ M4: images and summary
_IMG_BACKEND = "CASE video_id % 3 WHEN 0 THEN 'diffusers' WHEN 1 THEN 'openai' ELSE 'stability' END"
_W, _H = FV.DIFFUSERS_SIZE
_IMG_REQ = f"""
SELECT video_id, section_index, start_time, backend, model, full_prompt, negative_prompt, frame_file,
       CASE backend
         WHEN 'diffusers' THEN to_json({{'prompt': full_prompt, 'negative_prompt': negative_prompt,
                                        'num_inference_steps': {FV.DIFFUSERS_STEPS},
                                        'guidance_scale': CAST({FV.DIFFUSERS_GUIDANCE} AS DOUBLE),
                                        'width': {_W}, 'height': {_H}}})
         WHEN 'openai' THEN to_json({{'model': model, 'prompt': full_prompt, 'size': '{FV.OPENAI_SIZE}',
                                     'quality': '{FV.OPENAI_QUALITY}', 'n': 1}})
         ELSE to_json({{'prompt': full_prompt, 'negative_prompt': negative_prompt,
                        'aspect_ratio': '{FV.STABILITY_ASPECT_RATIO}', 'output_format': '{FV.STABILITY_FORMAT}',
                        'model': model, 'mode': 'text-to-image'}}) END::VARCHAR AS payload
FROM (SELECT video_id, section_index, start_time, backend, {S.case_map('backend', FV.IMAGE_DEFAULT_MODEL)} AS model,
             CASE WHEN backend = 'openai' AND length(fp) > {FV.PROMPT_CHAR_LIMIT}
                  THEN substr(fp, 1, {FV.PROMPT_CHAR_LIMIT - 3}) || '...' ELSE fp END AS full_prompt,
             {S.case_map('backend', FV.NEGATIVE_PROMPT)} AS negative_prompt,
             printf('frame_%08d.%s', CAST(trunc(coalesce(start_time, 0.0) * 1000) AS BIGINT),
                    CASE WHEN backend = 'stability' THEN '{FV.STABILITY_FORMAT}' ELSE 'png' END) AS frame_file
      FROM (SELECT *, {_IMG_BACKEND} AS backend,
                   CASE WHEN coalesce(visual_style, '') <> ''
                        THEN coalesce(image_prompt, '') || ', ' || visual_style || ' style'
                        ELSE coalesce(image_prompt, '') END AS fp
            FROM sections) a) b"""
S.VIEWS["image_requests_q"] = (["sections"], _IMG_REQ)
oracle("image_requests", "SELECT * FROM image_requests_q", "image_requests_q")

_REC = f"""
SELECT q.video_id, q.section_index, q.frame_file
FROM ({_IMG_REQ}) q JOIN image_results r USING (video_id, section_index) WHERE r.status_code = 200"""


def _settings_json(backend: str) -> str:
    neg = S.case_map(backend, FV.NEGATIVE_PROMPT)
    diff = (f"to_json(MAP {{'num_inference_steps': '{FV.DIFFUSERS_STEPS}', 'guidance_scale': '{FV.DIFFUSERS_GUIDANCE}', "
            f"'image_size': '[{_W}, {_H}]', 'negative_prompt': {neg}}})")
    oai = f"to_json(MAP {{'quality': '{FV.OPENAI_QUALITY}', 'size': '{FV.OPENAI_SIZE}'}})"
    stab = (f"to_json(MAP {{'aspect_ratio': '{FV.STABILITY_ASPECT_RATIO}', 'output_format': '{FV.STABILITY_FORMAT}', "
            f"'negative_prompt': {neg}}})")
    return f"CASE {backend} WHEN 'diffusers' THEN {diff} WHEN 'openai' THEN {oai} ELSE {stab} END"


oracle("image_manifest", f"""
SELECT video_id, backend, {S.case_map('backend', FV.IMAGE_DEFAULT_MODEL)} AS model, num_sections,
       coalesce(num_images, 0) AS num_images, coalesce(image_indices, '') AS image_indices,
       coalesce(frame_files, '') AS frame_files, CAST({_settings_json('backend')} AS VARCHAR) AS settings
FROM (SELECT video_id, {_IMG_BACKEND} AS backend, count(*) AS num_sections FROM sections GROUP BY video_id) v
LEFT JOIN (SELECT video_id, count(*) AS num_images,
                  string_agg(CAST(section_index AS VARCHAR), ',' ORDER BY section_index) AS image_indices,
                  string_agg(frame_file, ',' ORDER BY section_index) AS frame_files
           FROM ({_REC}) rec GROUP BY video_id) i USING (video_id)""", "sections", "image_results")

oracle("image_payloads", """
SELECT video_id, section_index, backend, b IS NOT NULL AS valid, CAST(octet_length(b) AS BIGINT) AS n_bytes,
       sha256(b) AS sha256
FROM (SELECT *, try(from_base64(image_b64)) AS b FROM image_results WHERE status_code = 200) a""", "image_results")

oracle("image_cost", """
SELECT backend, n_images, CAST(unit_price AS DECIMAL(10,4)) AS unit_price,
       CAST(CAST(n_images AS DECIMAL(18,0)) * unit_price AS DECIMAL(18,4)) AS total_cost
FROM (SELECT backend, count(*) AS n_images FROM image_results WHERE status_code = 200 GROUP BY backend) n
LEFT JOIN prices USING (backend)""", "image_results", "prices")

oracle("image_progress", """
SELECT video_id, section_index, CAST(section_index + 1 AS BIGINT) AS attempted,
       CAST(sum(ok) OVER (PARTITION BY video_id ORDER BY section_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS succeeded,
       count(*) OVER (PARTITION BY video_id) AS total,
       CAST(100.0 AS DOUBLE) * (section_index + 1) / count(*) OVER (PARTITION BY video_id) AS progress_pct
FROM (SELECT s.video_id, s.section_index, CASE WHEN r.status_code = 200 THEN 1 ELSE 0 END AS ok
      FROM sections s LEFT JOIN image_results r USING (video_id, section_index)) a""", "sections", "image_results")

_CROWDED = _IMG_REQ.replace("FROM sections)", "FROM crowded_sections)")
_CROWDED_REC = f"""
SELECT q.video_id, q.section_index, q.start_time AS timestamp, q.frame_file
FROM ({_CROWDED}) q JOIN image_results r USING (video_id, section_index) WHERE r.status_code = 200"""
oracle("frame_collisions", f"""
SELECT video_id, section_index, frame_file, count(*) OVER (PARTITION BY video_id, frame_file) AS n_same_file,
       section_index = max(section_index) OVER (PARTITION BY video_id, frame_file) AS is_winner
FROM ({_CROWDED_REC}) rec""", "crowded_sections", "image_results")

oracle("section_preview", """
SELECT video_id, section_index, CAST(section_index + 1 AS INT) AS section_no,
       printf('%.1f', CAST(coalesce(start_time, 0) AS DOUBLE)) AS start_text,
       printf('%.1f', CAST(coalesce(end_time, 0) AS DOUBLE)) AS end_text,
       'N/A' AS scene, substr(coalesce(image_prompt, 'N/A'), 1, 100) || '...' AS prompt_preview,
       coalesce(visual_style, 'N/A') AS style, greatest(n - 3, 0) AS more_sections
FROM sections JOIN (SELECT video_id, count(*) AS n FROM sections GROUP BY video_id) c USING (video_id)
WHERE section_index < 3""", "sections")

oracle("video_summary", """
SELECT video_id, video_name, transcript_file, video_name || '.srt' AS srt_file,
       video_name || '_prompts.json' AS prompts_file, 'generated_images/' || video_name AS output_dir,
       coalesce(num_segments, 0) AS num_segments, coalesce(num_sections, 0) AS num_sections,
       coalesce(num_images, 0) AS num_images
FROM (SELECT video_id, transcript_file,
             replace(coalesce(nullif(regexp_extract(transcript_file, '^(.+)\\.[^.]+$', 1), ''), transcript_file),
                     '.aligned', '') AS video_name
      FROM (SELECT DISTINCT video_id, 'conv_' || CAST(video_id AS VARCHAR) || '.aligned.json' AS transcript_file
            FROM segments) t) t
LEFT JOIN (SELECT video_id, count(*) AS num_segments FROM segments GROUP BY video_id) a USING (video_id)
LEFT JOIN (SELECT video_id, count(*) AS num_sections FROM sections GROUP BY video_id) b USING (video_id)
LEFT JOIN (SELECT video_id, CAST(count_if(status_code = 200) AS BIGINT) AS num_images FROM image_results GROUP BY video_id) c
  USING (video_id)""", "segments", "sections", "image_results")


# ------------------------------------------------------------------ M5: time joins
oracle("section_segments", """
SELECT s.video_id, s.section_index, s.start_time, s.end_time, count(g.pos) AS num_segments,
       coalesce(string_agg(coalesce(g.text, ''), ' ' ORDER BY g.pos), '') AS transcript_text
FROM sections s LEFT JOIN segments g
  ON g.video_id = s.video_id AND g.start_s < s.end_time AND g.end_s > s.start_time
GROUP BY s.video_id, s.section_index, s.start_time, s.end_time""", "sections", "segments")

_FRAMES = f"""
SELECT q.video_id, q.section_index, r.timestamp_s AS timestamp, q.frame_file
FROM ({_IMG_REQ}) q JOIN image_results r USING (video_id, section_index) WHERE r.status_code = 200"""
oracle("frame_intervals", f"""
SELECT video_id, section_index, frame_file, timestamp,
       lead(timestamp) OVER (PARTITION BY video_id ORDER BY timestamp, section_index) AS until
FROM ({_FRAMES}) f""", "sections", "image_results")

oracle("frame_asof", f"""
SELECT s.video_id, s.pos, s.start_s, f.section_index AS frame_section_index, f.frame_file, f.timestamp AS frame_time
FROM segments s ASOF LEFT JOIN ({_FRAMES}) f ON s.video_id = f.video_id AND s.start_s >= f.timestamp""",
       "segments", "sections", "image_results")


oracle("crowded_frame_intervals", f"""
SELECT video_id, section_index, frame_file, timestamp,
       lead(timestamp) OVER (PARTITION BY video_id ORDER BY timestamp, section_index) AS until
FROM ({_CROWDED_REC}) f""", "crowded_sections", "image_results")

oracle("crowded_frame_asof", f"""
SELECT s.video_id, s.pos, s.start_s, f.section_index AS frame_section_index, f.frame_file, f.timestamp AS frame_time
FROM segments s ASOF LEFT JOIN (SELECT * FROM ({_CROWDED_REC}) a QUALIFY row_number() OVER (
     PARTITION BY video_id, timestamp ORDER BY section_index DESC) = 1) f ON s.video_id = f.video_id AND s.start_s >= f.timestamp""",
       "segments", "crowded_sections", "image_results")


# ------------------------------------------------------------------ M6: streaming (final state of the sink)
oracle("stream_ingest", f"""
SELECT conv_id AS video_id, CAST(turn AS INT) AS pos, role, {S.strip('text')} AS text FROM conversations""")

oracle("stream_dedup", f"""
SELECT DISTINCT canonical_url, video_key FROM ({_CANON}) c""", "requests")

oracle("stream_pending", f"""
SELECT request_id, canonical_url, video_key FROM ({_CANON}) c
WHERE canonical_url NOT IN (SELECT key FROM inventory)""", "requests", "inventory")

oracle("stream_sessions", """
SELECT user_id, epoch_us(min(ts)) AS session_start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS session_end_us,
       count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value
FROM (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM (SELECT user_id, ts, value,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                          OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS is_new
            FROM events) a) b
GROUP BY user_id, sid""")

oracle("stream_counts", """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_start_us, event_type, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value
FROM events
GROUP BY time_bucket(INTERVAL 1 HOUR, ts), event_type""")

oracle("stream_image_status", """
SELECT CAST(us // 3600000000 * 3600000000 AS BIGINT) AS window_start_us, backend, count(*) AS attempted,
       CAST(count_if(status_code = 200) AS BIGINT) AS succeeded, CAST(count_if(status_code <> 200) AS BIGINT) AS failed
FROM (SELECT *, video_id * 60000000 + CAST(round(timestamp_s * 1000) AS BIGINT) * 1000 AS us FROM image_results) a
GROUP BY 1, 2""", "image_results")


# ------------------------------------------------------------------ M6: pluggable inference (stub twins)
oracle("stub_inference", """
SELECT video_id, backend, model,
       CASE WHEN video_id % 10 = 7 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN video_id % 10 = 7 THEN 'RuntimeError: stub backend unavailable' END AS error,
       CASE WHEN video_id % 10 <> 7 THEN '{"sections": [{"start_time": 0.0, "n_chars": ' || CAST(length(prompt) AS VARCHAR)
            || ', "image_prompt": "stub ' || CAST(video_id AS VARCHAR) || '"}]}' END AS content
FROM llm_requests_q""", "llm_requests_q")

oracle("stub_images", """
SELECT video_id, section_index, backend, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN failed THEN 'RuntimeError: stub render failed' END AS error,
       CASE WHEN NOT failed THEN 'generated_images/video_' || CAST(video_id AS VARCHAR) || '/' || frame_file END AS image_path,
       start_time AS timestamp, full_prompt AS prompt,
       CASE WHEN NOT failed AND backend = 'openai' THEN substr(full_prompt, 1, 50) END AS revised_prompt,
       CASE WHEN NOT failed THEN CAST(video_id * 1000 + section_index AS BIGINT) END AS seed
FROM (SELECT *, (video_id + section_index) % 7 = 3 AS failed FROM image_requests_q) q""", "image_requests_q")


# ------------------------------------------------------------------ long transcripts (documents)
_DOC_TIMELINE = f"""
SELECT video_id, string_agg({S.timeline_line('start_s', 'end_s', 'text')}, chr(10) ORDER BY pos) AS transcript
FROM doc_segments GROUP BY video_id"""
oracle("document_requests", f"""
SELECT video_id, backend, model, language, temperature, max_tokens, prompt,
       CASE backend
         WHEN 'openai' THEN to_json({{'model': model, 'messages': [{{'role': 'system', 'content': {S.sql_str(FV.REQUEST_SYSTEM)}}}, {{'role': 'user', 'content': prompt}}],
                                     'temperature': temperature, 'max_tokens': max_tokens,
                                     'response_format': {{'type': 'json_object'}}}})
         WHEN 'anthropic' THEN to_json({{'model': model, 'max_tokens': max_tokens, 'temperature': temperature,
                                        'system': {S.sql_str(FV.REQUEST_SYSTEM)}, 'messages': [{{'role': 'user', 'content': prompt}}]}})
         ELSE to_json({{'model': model, 'prompt': prompt, 'temperature': temperature, 'stream': false}}) END::VARCHAR AS payload
FROM (SELECT video_id, backend, {S.case_map('backend', FV.LLM_DEFAULT_MODEL)} AS model, language,
             CAST({FV.LLM_DEFAULT_TEMPERATURE} AS DOUBLE) AS temperature, {_MAXTOK} AS max_tokens,
             {S.sql_str(FV.REQUEST_TEMPLATE_HEAD)} || language || {S.sql_str(FV.REQUEST_TEMPLATE_MID)} || transcript AS prompt
      FROM (SELECT t.video_id, {S.backend_for('t.video_id')} AS backend,
                   coalesce(nullif(d.lang, ''), '{FV.DEFAULT_LANGUAGE}') AS language, t.transcript
            FROM ({_DOC_TIMELINE}) t LEFT JOIN documents d ON d.doc_id = t.video_id) a) b""", "doc_segments")

oracle("document_srt", f"""
SELECT video_id, count(*) AS num_cues,
       string_agg(concat(CAST(pos + 1 AS VARCHAR), chr(10), {S.srt_clock('start_s')}, ' --> ', {S.srt_clock('end_s')},
                         chr(10), {S.strip('text')}, chr(10), chr(10)), '' ORDER BY pos) AS body
FROM doc_segments GROUP BY video_id""", "doc_segments")


# ------------------------------------------------------------------ answers to manifests, two text backends a video
_TEXT_MODELS = ", ".join(f"('{b}', '{FV.LLM_DEFAULT_MODEL[b]}', {k})" for b, k in (("openai", 1), ("anthropic", 0)))
_CHAIN = f"""
SELECT s.video_id, t.text_backend, t.text_model, s.section_index, {_IMG_BACKEND.replace('video_id', 's.video_id')} AS backend,
       s.start_time, 'Scene ' || CAST(s.section_index AS VARCHAR) || ' ' || s.transcript_text || ', cinematic style' AS full_prompt,
       (s.video_id + s.section_index + t.k) % 4 <> 0 AS ok
FROM scenes s, (VALUES {_TEXT_MODELS}) t(text_backend, text_model, k)"""


def _manifests(rows: str, keys: str, model: str = S.case_map('backend', FV.IMAGE_DEFAULT_MODEL),
               settings: str = _settings_json('backend'), extension: str = "'png'") -> str:
    """Manifest documents as strings over rows (keys, section_index, backend, start_time, full_prompt, ok)."""
    return f"""
SELECT {keys}, 'video_' || CAST(video_id AS VARCHAR) AS video_name, 'video_' || CAST(video_id AS VARCHAR) || '_prompts.json' AS prompts_file,
       'generated_images/video_' || CAST(video_id AS VARCHAR) AS output_dir, {model} AS model, backend,
       CAST(count_if(ok) AS BIGINT) AS num_images, CAST({settings} AS VARCHAR) AS settings,
       coalesce(string_agg(concat_ws('|', CAST(section_index AS VARCHAR),
           'generated_images/video_' || CAST(video_id AS VARCHAR) || '/' || printf('frame_%08d.', CAST(trunc(start_time * 1000) AS BIGINT)) || {extension},
           printf('%.3f', start_time), CASE WHEN backend = 'openai' AND length(full_prompt) > {FV.PROMPT_CHAR_LIMIT}
               THEN substr(full_prompt, 1, {FV.PROMPT_CHAR_LIMIT - 3}) || '...' ELSE full_prompt END),
           chr(10) ORDER BY section_index) FILTER (ok), '') AS images
FROM ({rows}) x GROUP BY {keys}, backend"""


oracle("section_chain", _manifests(_CHAIN, "video_id, text_backend, text_model"), "scenes")
_MADE = """
SELECT video_id, section_index, q.backend, q.start_time, q.full_prompt, r.status_code = 200 AS ok
FROM image_requests_q q JOIN image_results r USING (video_id, section_index)"""
_ONE_EACH = _manifests(_MADE, "video_id")
oracle("manifests_custom", "SELECT * EXCLUDE (video_id) FROM (" + _manifests(_MADE, "video_id", "'own-model'", """
CASE backend WHEN 'diffusers' THEN to_json(MAP {'num_inference_steps': '12', 'guidance_scale': '3.5', 'image_size': '[640, 480]', 'negative_prompt': 'no text'})
             WHEN 'openai' THEN to_json(MAP {'quality': 'hd', 'size': '1792x1024'})
             ELSE to_json(MAP {'aspect_ratio': '16:9', 'output_format': 'webp', 'negative_prompt': 'no text'}) END""",
    "CASE backend WHEN 'stability' THEN 'webp' ELSE 'png' END") + ") m", "image_requests_q", "image_results")
oracle("roundtrip_manifests", f"SELECT * EXCLUDE (video_id) FROM ({_ONE_EACH}) m", "image_requests_q", "image_results")

_CUSTOM = _IMG_REQ
for _a, _b in ((f"'num_inference_steps': {FV.DIFFUSERS_STEPS}", "'num_inference_steps': 12"),
               (f"CAST({FV.DIFFUSERS_GUIDANCE} AS DOUBLE)", "CAST(3.5 AS DOUBLE)"), (f"'width': {_W}, 'height': {_H}", "'width': 640, 'height': 480"),
               (f"'size': '{FV.OPENAI_SIZE}'", "'size': '1792x1024'"), (f"'quality': '{FV.OPENAI_QUALITY}'", "'quality': 'hd'"),
               (f"'aspect_ratio': '{FV.STABILITY_ASPECT_RATIO}'", "'aspect_ratio': '16:9'"),
               (f"'output_format': '{FV.STABILITY_FORMAT}'", "'output_format': 'webp'"),
               (f"THEN '{FV.STABILITY_FORMAT}' ELSE 'png' END", "THEN 'webp' ELSE 'png' END"),
               (f"{S.case_map('backend', FV.IMAGE_DEFAULT_MODEL)} AS model", "'own-model' AS model"),
               (f"{S.case_map('backend', FV.NEGATIVE_PROMPT)} AS negative_prompt", "'no text' AS negative_prompt")):
    assert _a in _CUSTOM, _a
    _CUSTOM = _CUSTOM.replace(_a, _b)
oracle("image_requests_custom", _CUSTOM, "sections")

oracle("merged_records", """
SELECT q.video_id, q.section_index, q.backend,
       'generated_images/video_' || CAST(q.video_id AS VARCHAR) || '/' || q.frame_file AS image_path,
       coalesce(q.start_time, 0.0) AS timestamp, q.full_prompt AS prompt, CAST(NULL AS VARCHAR) AS revised_prompt,
       CASE WHEN q.backend = 'stability' THEN r.seed END AS seed, q.frame_file
FROM image_requests_q q JOIN image_results r USING (video_id, section_index) WHERE r.status_code = 200""",
       "image_requests_q", "image_results")


# ------------------------------------------------------------------ documents written and read back
_LANGUAGE = f"CASE video_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE '{FV.DEFAULT_LANGUAGE}' END"
oracle("roundtrip_transcripts", f"""
SELECT 'video_' || CAST(video_id AS VARCHAR) AS video_id, pos, start_s, end_s,
       CASE WHEN video_id % 4 = 0 THEN 'again: ' || text ELSE text END AS text, {_LANGUAGE} AS language FROM segments""", "segments")

oracle("roundtrip_prompts", f"""
SELECT concat_ws('/', 'video_' || CAST(video_id AS VARCHAR), text_model, {_LANGUAGE}) AS document, section_index,
       start_time, end_time, transcript_text, 'Scene ' || CAST(section_index AS VARCHAR) || ' ' || transcript_text AS image_prompt,
       'neutral' AS sentiment, CAST(NULL AS VARCHAR) AS scene_description, 'cinematic' AS visual_style
FROM scenes s, (VALUES {_TEXT_MODELS}) t(text_backend, text_model, k)""", "scenes")

_SRT = f"""SELECT video_id, string_agg(concat(CAST(pos + 1 AS VARCHAR), chr(10), {S.srt_clock('start_s')}, ' --> ', {S.srt_clock('end_s')},
       chr(10), {S.strip('text')}, chr(10), chr(10)), '' ORDER BY pos) AS body FROM segments GROUP BY video_id"""
_VTT = f"""SELECT video_id, concat('WEBVTT', chr(10), chr(10), string_agg(concat({S.vtt_clock('start_s')}, ' --> ', {S.vtt_clock('end_s')}, chr(10),
       {S.strip('text')}, chr(10), chr(10)), '' ORDER BY pos)) AS body FROM segments GROUP BY video_id"""
oracle("roundtrip_captions", f"""
SELECT 'srt' AS kind, video_id, body AS value FROM ({_SRT}) a UNION ALL SELECT 'vtt', video_id, body FROM ({_VTT}) b""", "segments")

oracle("roundtrip_clips", f"""
SELECT video_id, start_s AS start, end_s AS "end", {S.strip('text')} AS text FROM segments""", "segments")

oracle("file_inventory", f"""
SELECT 'video_' || CAST(video_id AS VARCHAR) || '.srt' AS key, CAST(octet_length(encode(body)) AS BIGINT) AS length FROM ({_SRT}) a""", "segments")

oracle("url_list", f"SELECT url, shorts_id, canonical_url, video_key FROM ({_CANON}) c", "requests")
