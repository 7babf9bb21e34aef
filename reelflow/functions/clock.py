"""Time and number formatting (TIM-1 … TIM-5). All ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelflow.functions.defaults import default


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def srt_clock(t) -> Column:
    """TIM-1: ``HH:MM:SS,mmm``; milliseconds truncated, hours unbounded."""
    t = _c(t).cast("double")
    return F.when(t.isNotNull(), F.format_string(
        "%02d:%02d:%02d,%03d",
        F.floor(t / 3600),
        F.floor(F.pmod(t, F.lit(3600.0)) / 60),
        F.floor(F.pmod(t, F.lit(60.0))),
        ((t - t.cast("bigint")) * 1000).cast("bigint"),
    ))


def vtt_clock(t) -> Column:
    """TIM-2: the SRT clock with a period before the milliseconds."""
    return F.translate(srt_clock(t), ",", ".")


def one_decimal(x) -> Column:
    """Python ``f"{x:.1f}"``: rounds the exact binary value, no grouping."""
    return F.call_function("format_number", _c(x).cast("double"), F.lit("0.0"))


def timeline_line(start, end, text) -> Column:
    """TIM-3: ``[12.3s - 15.0s] text`` with missing values defaulted."""
    return F.concat(
        F.lit("["), one_decimal(default(_c(start), 0.0)),
        F.lit("s - "), one_decimal(default(_c(end), 0.0)),
        F.lit("s] "), default(_c(text), ""),
    )


def frame_file(start, ext="png") -> Column:
    """TIM-4: ``frame_%08d.<ext>`` from truncated milliseconds; never cut.

    ``ext`` is a literal extension or a Column.
    """
    ext = F.lit(ext) if isinstance(ext, str) else ext
    ms = (_c(start).cast("double") * 1000).cast("bigint")
    return F.when(ms.isNotNull(), F.format_string("frame_%08d.%s", ms, ext))


def size_text(size_gb) -> Column:
    """TIM-5: ``0.07GB`` (two decimals)."""
    return F.concat(F.call_function("format_number", _c(size_gb).cast("double"), F.lit("0.00")), F.lit("GB"))
