"""DuckDB SQL for the derived views and shared expressions of the oracle twin.

Kept next to the Spark definitions so both sides can be read together. The
oracle is a test twin only; the engine itself never runs SQL text from here.
"""

from __future__ import annotations

from reelflow import fixed_values as FV
from reelflow.sources.views import REQUESTABLE

# The twin's own statements of the rules; nothing here comes from the engine's patterns.
SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in (
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)) + "]"

VIEWS: dict[str, tuple[list[str], str]] = {
    "segments": ([], """
SELECT video_id, pos, role, text,
       CAST(cum - dur - gap AS DOUBLE) / 1000 AS start_s,
       CAST(cum - gap AS DOUBLE) / 1000 AS end_s
FROM (SELECT *, sum(dur + gap) OVER (PARTITION BY video_id ORDER BY pos) AS cum
      FROM (SELECT conv_id AS video_id, CAST(turn AS INT) AS pos, role,
                   CASE WHEN turn % 2 = 0 THEN concat('  ', text, ' ') ELSE text END AS text,
                   60 * length(conversations.text) AS dur,
                   CASE WHEN turn % 3 = 2 THEN 1500 ELSE 200 END AS gap
            FROM conversations) a) b"""),
    "sparse_segments": (["segments"], """
SELECT video_id, CAST(pos * 3 + 100 AS INT) AS pos, role, text, start_s, end_s FROM segments"""),
    "requests": ([], """
SELECT page_id AS request_id, url FROM pages
UNION ALL
SELECT page_id + 1000000000 AS request_id,
       CASE page_id % 8
         WHEN 0 THEN concat('https://youtu.be/', vid, '?si=q7&t=95')
         WHEN 1 THEN concat('https://www.youtube.com/watch?list=PLx9&v=', vid, '&index=3')
         WHEN 2 THEN concat('http://www.youtube.com/shorts/', vid, '/?cbrd=1')
         WHEN 3 THEN concat('https://music.youtube.com/watch?v=', vid)
         WHEN 4 THEN concat('https://youtube.com/shorts/', vid)
         WHEN 5 THEN 'https://www.youtube.com/shorts/abcd'
         WHEN 6 THEN concat('https://m.youtube.com/x?a=1&v=', vid, '%')
         ELSE concat('https://www.youtube.com/embed?v=', vid, '%zz&b=2') END AS url
FROM (SELECT page_id, concat('vid_', lpad(CAST(page_id // 3 AS VARCHAR), 5, '0')) AS vid FROM pages) a"""),
    "inventory": ([], """
SELECT DISTINCT concat('https://www.youtube.com/watch?v=vid_', lpad(CAST(page_id // 3 AS VARCHAR), 5, '0')) AS key
FROM pages WHERE (page_id // 3) % 10 < 3"""),
    "crowded_sections": (["sections"], """
SELECT * REPLACE (floor(start_time / 60) * 60 AS start_time) FROM sections"""),
    "flawed_segments": (["segments"], """
SELECT video_id, pos, CASE WHEN (video_id + pos) % 11 <> 0 THEN start_s END AS start_s,
       CASE WHEN (video_id + pos) % 13 <> 0 THEN end_s END AS end_s, CASE WHEN (video_id + pos) % 17 <> 0 THEN text END AS text
FROM segments"""),
    "flawed_responses": (["llm_responses"], """
SELECT video_id, CASE video_id % 6 WHEN 1 THEN 'gemini' WHEN 2 THEN NULL ELSE backend END AS backend FROM llm_responses"""),
    "flawed_results": (["image_results"], """
SELECT video_id, section_index, status_code, CASE WHEN (video_id + section_index) % 9 = 4 THEN 'midjourney' ELSE backend END AS backend
FROM image_results"""),
    "sections": (["segments"], """
SELECT video_id, section_index, start_time, end_time,
       CASE WHEN (video_id + section_index) % 11 = 0 THEN repeat('x', 4100)
            ELSE concat('Scene ', CAST(section_index AS VARCHAR), ' of video ', CAST(video_id AS VARCHAR)) END AS image_prompt,
       CASE video_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' ELSE 'negative' END AS sentiment,
       CASE (video_id + section_index) % 4 WHEN 0 THEN 'cinematic' WHEN 1 THEN 'realistic' WHEN 2 THEN '' END AS visual_style
FROM (SELECT video_id, CAST(floor(pos / 3) AS INT) AS section_index, min(start_s) AS start_time, max(end_s) AS end_time
      FROM segments GROUP BY video_id, CAST(floor(pos / 3) AS INT)) a"""),
    "image_results": (["sections"], """
SELECT video_id, section_index, start_time AS timestamp_s,
       CASE video_id % 3 WHEN 0 THEN 'diffusers' WHEN 1 THEN 'openai' ELSE 'stability' END AS backend,
       CASE WHEN (video_id * 7 + section_index) % 5 = 0 THEN 429 ELSE 200 END AS status_code,
       CASE WHEN video_id % 3 = 2 THEN video_id * 1000 + section_index END AS seed,
       CASE section_index % 3 WHEN 0 THEN 'aGVsbG8=' WHEN 1 THEN 'd29ybGQ=' ELSE '***' END AS image_b64
FROM sections"""),
    "llm_responses": ([], """
SELECT video_id, backend, content FROM (
SELECT video_id,
       CASE CAST(floor(video_id / 9) AS INT) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'ollama' END AS backend,
       CASE video_id % 13
         WHEN 0 THEN body
         WHEN 1 THEN arr
         WHEN 2 THEN concat('Here:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'Done.')
         WHEN 3 THEN concat('```', chr(10), body, chr(10), '```')
         WHEN 4 THEN concat('Sure! ', body, chr(10), 'Anything else?')
         WHEN 5 THEN concat(body, ' junk')
         WHEN 6 THEN 'not json'
         WHEN 7 THEN '{"title": "x"}'
         WHEN 8 THEN '{"sections": null}'
         WHEN 9 THEN concat('[', item, ', "oops", ', item, ']')
         WHEN 10 THEN '{"sections": "[1]"}'
         WHEN 11 THEN '[1, 2]'
         ELSE '{"sections": []}' END AS content
FROM (SELECT video_id, item, arr, concat('{"sections": ', arr, '}') AS body
      FROM (SELECT video_id, item, concat('[', item, ']') AS arr
            FROM (SELECT conv_id AS video_id,
                         to_json({'start_time': CAST(0 AS DOUBLE), 'end_time': CAST(1.5 AS DOUBLE), 'transcript_text': arg_min(text, turn),
                                  'image_prompt': 'p' || CAST(conv_id AS VARCHAR), 'sentiment': 'neutral',
                                  'visual_style': 'cinematic'})::VARCHAR AS item
                  FROM conversations GROUP BY conv_id) i) a) b) c
UNION ALL
SELECT DISTINCT conv_id + 1000000000,
       CASE CAST(floor(conv_id / 9) AS INT) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'ollama' END, 'not json'
FROM conversations"""),
    "scenes": (["segments"], """
SELECT video_id, CAST(floor(pos / 3) AS INT) AS section_index, min(start_s) AS start_time, max(end_s) AS end_time,
       arg_min(text, pos) AS transcript_text
FROM segments GROUP BY 1, 2"""),
    "doc_segments": ([], """
SELECT video_id, pos, text,
       CAST(cum - dur - gap AS DOUBLE) / 1000 AS start_s, CAST(cum - gap AS DOUBLE) / 1000 AS end_s
FROM (SELECT *, sum(dur + gap) OVER (PARTITION BY video_id ORDER BY pos) AS cum
      FROM (SELECT video_id, pos, text, 60 * length(text) AS dur, 200 AS gap
            FROM (SELECT doc_id AS video_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS pos,
                         unnest(parts) AS text
                  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) a) b) c) d"""),
    "catalogue": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{n}', '{r}', CAST({s} AS DOUBLE), '{d}')" for i, (n, r, s, d) in enumerate(FV.SPEECH_MODELS))
        + ") t(ord, name, repo, size_gb, description)"),
    "model_batches": ([], """
SELECT c_custkey AS batch_id, c_custkey % 10 = 0 AS all_models, c_custkey % 3 = 0 AS force,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE abs(c_acctbal) / 1000 END AS free_gb
FROM customer"""),
    "model_requests": ([], f"""
SELECT batch_id, pos, ([{", ".join(repr(x) for x in REQUESTABLE)}])[CAST((batch_id + 2 * pos) % {len(REQUESTABLE)} + 1 AS INT)] AS name
FROM (SELECT c_custkey AS batch_id, CAST(unnest(range(c_custkey % 4)) AS INT) AS pos
      FROM customer WHERE c_custkey % 10 <> 0) a"""),
    "prices": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{b}', CAST({p} AS DECIMAL(10,4)))" for b, p in FV.IMAGE_UNIT_PRICE) + ") t(backend, unit_price)"),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for ``names`` and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in VIEWS[n][0]:
            visit(dep)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{sql}"


def srt_clock(t: str) -> str:
    pm3600 = f"(CASE WHEN fmod({t}, 3600) < 0 THEN fmod(fmod({t}, 3600) + 3600, 3600) ELSE fmod({t}, 3600) END)"
    pm60 = f"(CASE WHEN fmod({t}, 60) < 0 THEN fmod(fmod({t}, 60) + 60, 60) ELSE fmod({t}, 60) END)"
    return (f"printf('%02d:%02d:%02d,%03d', CAST(floor({t} / 3600) AS BIGINT), CAST(floor({pm3600} / 60) AS BIGINT), "
            f"CAST(floor({pm60}) AS BIGINT), CAST(trunc(({t} - trunc({t})) * 1000) AS BIGINT))")


def vtt_clock(t: str) -> str:
    return f"replace({srt_clock(t)}, ',', '.')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def one_decimal(x: str) -> str:
    return f"printf('%.1f', CAST({x} AS DOUBLE))"


def timeline_line(start: str, end: str, text: str) -> str:
    return (f"concat('[', {one_decimal(f'coalesce({start}, 0)')}, 's - ', {one_decimal(f'coalesce({end}, 0)')}, "
            f"'s] ', coalesce({text}, ''))")


def canonical_url(u: str) -> str:
    """Address forms, taken apart with string functions."""
    address = f"split_part({u}, '#', 1)"
    query = f"substr({address}, nullif(instr({address}, '?'), 0) + 1)"
    rest = f"split_part(split_part({address}, '?', 1), '//', 2)"
    shorts = f"nullif(regexp_extract({u}, 'youtu(?:be[.]com|[.]be)/shorts/([[:alnum:]_-]{{5,}})', 1), '')"
    host_id = (f"CASE WHEN split_part({rest}, '/', 1) = 'youtu.be' THEN "
               f"nullif(ltrim(substr({rest}, length('youtu.be') + 1), '/'), '') END")
    raw = (f"list_filter(list_transform(list_filter(string_split({query}, '&'), lambda p: starts_with(p, 'v=') OR starts_with(p, '%76=')), "
           f"lambda p: substr(p, instr(p, '=') + 1)), lambda p: p <> '')[1]")
    v = f"url_decode(replace({raw}, '+', ' '))"
    w = "'https://www.youtube.com/watch?v='"
    return (f"CASE WHEN {shorts} IS NOT NULL THEN {w} || {shorts} "
            f"WHEN {host_id} IS NOT NULL THEN {w} || {host_id} "
            f"WHEN contains({u}, 'youtube.com/watch') THEN {u} "
            f"WHEN {v} IS NOT NULL THEN {w} || {v} ELSE {u} END")


def sql_str(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)``."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


def _fence_body(c: str, st: str) -> str:
    rel = f"instr(substr({c}, {st}), '```')"
    return (f"{strip(f'(CASE WHEN {rel} > 0 THEN substr({c}, {st}, {rel} - 1) '
                     f'ELSE substr({c}, {st}, greatest(length({c}) - ({st}), 0)) END)')}")


def extract_for_backend(backend: str, c: str) -> str:
    fenced = (f"CASE WHEN instr({c}, '```json') > 0 THEN {_fence_body(c, f'instr({c}, ' + "'```json'" + ') + 7')} "
              f"WHEN instr({c}, '```') > 0 THEN {_fence_body(c, f'instr({c}, ' + "'```'" + ') + 3')} ELSE {c} END")
    greedy = f"coalesce(nullif(regexp_extract({c}, '(?s)\\{{.*\\}}', 0), ''), {c})"
    return f"CASE WHEN {backend} = 'anthropic' THEN {fenced} WHEN {backend} = 'ollama' THEN {greedy} ELSE {c} END"


def case_map(col: str, mapping: dict, cast: str = "VARCHAR") -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v) if isinstance(v, str) else v}" for k, v in mapping.items())
    return f"CAST(CASE {col} {whens} END AS {cast})"


def backend_for(video_id: str) -> str:
    return (f"CASE CAST(floor({video_id} / 9) AS INT) % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' "
            f"ELSE 'ollama' END")


SECTION_JSON_STRUCT = ('{"start_time": "DOUBLE", "end_time": "DOUBLE", "transcript_text": "VARCHAR", '
                       '"image_prompt": "VARCHAR", "sentiment": "VARCHAR", "scene_description": "VARCHAR", '
                       '"visual_style": "VARCHAR"}')


def classified(responses: str = "llm_responses") -> str:
    """One row per answer with status and typed sections (DuckDB twin of ``responses.classify``)."""
    ext = extract_for_backend("backend", "content")
    model = case_map("backend", FV.LLM_DEFAULT_MODEL)
    return f"""
SELECT video_id, backend, {model} AS model, t, status,
       CASE WHEN status <> 'parsed' THEN NULL
            WHEN kind = 'OBJECT' THEN json_transform(t, '{{"sections": [{SECTION_JSON_STRUCT}]}}').sections
            ELSE json_transform(t, '[{SECTION_JSON_STRUCT}]') END AS sections,
       CASE WHEN status = 'parsed' THEN list_transform(CASE WHEN kind = 'OBJECT' THEN json_extract(t, '$.sections[*]') ELSE json_extract(t, '$[*]') END,
                                                       lambda x: json_type(x)) END AS kinds
FROM (SELECT *,
             CASE WHEN ok AND kind = 'OBJECT' AND list_contains(json_keys(t), 'sections') THEN
                       CASE WHEN json_type(t, '$.sections') = 'ARRAY' THEN 'parsed'
                            WHEN json_type(t, '$.sections') = 'NULL' AND backend = 'openai' THEN 'fallback'
                            ELSE 'error' END
                  WHEN ok AND kind = 'ARRAY' THEN 'parsed' ELSE 'fallback' END AS status
      FROM (SELECT *, coalesce(json_valid(t), false) AS ok, CASE WHEN coalesce(json_valid(t), false) THEN json_type(t) END AS kind
            FROM (SELECT video_id, backend, {ext} AS t FROM {responses}) a) b) c"""


VIEWS["classified"] = (["llm_responses"], classified())
