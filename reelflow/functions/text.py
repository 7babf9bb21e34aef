"""String helpers (STR-1 … STR-11). All ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from reelflow import fixed_values as FV

# Characters Python's ``str.strip()`` removes: Unicode White_Space plus the
# four information separators U+001C…U+001F. Written as an explicit class so
# the same pattern runs in Java regex and RE2 (the DuckDB twin).
WS_CLASS = (r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
STRIP_PATTERN = f"^{WS_CLASS}+|{WS_CLASS}+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(text) -> Column:
    """STR-1: trim all Unicode whitespace at both ends (``F.trim`` only strips spaces)."""
    return F.regexp_replace(_c(text), STRIP_PATTERN, "")


def srt_cue(index, start_clock, end_clock, text) -> Column:
    """STR-2: ``i\\nA --> B\\ntext\\n\\n``."""
    return F.concat(_c(index).cast("string"), F.lit("\n"), _c(start_clock), F.lit(" --> "),
                    _c(end_clock), F.lit("\n"), py_strip(text), F.lit("\n\n"))


def vtt_cue(start_clock, end_clock, text) -> Column:
    """STR-3: ``A --> B\\ntext\\n\\n``."""
    return F.concat(_c(start_clock), F.lit(" --> "), _c(end_clock), F.lit("\n"), py_strip(text),
                    F.lit("\n\n"))


def file_stem(file_name) -> Column:
    """``pathlib.Path(name).stem``: drop the text from the last dot, unless that dot is first or last."""
    n = _c(file_name)
    return F.coalesce(F.nullif(F.regexp_extract(n, r"^(.+)\.[^.]+$", 1), F.lit("")), n)


def video_name(file_name) -> Column:
    """STR-4: the file stem with every ``.aligned`` removed."""
    return F.replace(file_stem(file_name), F.lit(".aligned"), F.lit(""))


def video_label(df, key: str = "video_id") -> Column:
    """Output name of a video: its own name for named corpora, ``video_<id>`` for numeric ids."""
    if isinstance(df.schema[key].dataType, StringType):
        return F.col(key)
    return F.concat(F.lit("video_"), F.col(key).cast("string"))


def with_suffix(name, suffix: str) -> Column:
    """STR-5: output names such as ``<video>_prompts.json`` or ``<stem>.srt``."""
    return F.concat(_c(name), F.lit(suffix))


def styled_prompt(prompt, style) -> Column:
    """STR-6: ``"<prompt>, <style> style"``; the style is skipped when empty or missing."""
    p = F.coalesce(_c(prompt), F.lit(""))
    s = F.coalesce(_c(style), F.lit(""))
    return F.when(s != "", F.concat(p, F.lit(", "), s, F.lit(" style"))).otherwise(p)


def cap_prompt(prompt, limit: int = FV.PROMPT_CHAR_LIMIT) -> Column:
    """STR-7: over ``limit`` characters → the first ``limit-3`` plus ``...``."""
    p = _c(prompt)
    return F.when(F.length(p) > limit, F.concat(F.substring(p, 1, limit - 3), F.lit("..."))).otherwise(p)


def prefix(text, n: int) -> Column:
    """STR-8: the first ``n`` characters (code points)."""
    return F.substring(_c(text), 1, n)


def cache_dir_name(repo) -> Column:
    """STR-9: ``models--<org>--<name>`` from ``<org>/<name>``."""
    return F.concat(F.lit("models--"), F.replace(_c(repo), F.lit("/"), F.lit("--")))


def request_text(language, timeline) -> Column:
    """STR-10: instructions + language + timeline (our own template text)."""
    return F.concat(F.lit(FV.REQUEST_TEMPLATE_HEAD), _c(language), F.lit(FV.REQUEST_TEMPLATE_MID),
                    _c(timeline))


def preview(text, n: int = 100) -> Column:
    """STR-11: first ``n`` characters plus ``...``."""
    return F.concat(F.substring(F.coalesce(_c(text), F.lit("N/A")), 1, n), F.lit("..."))
