"""Null and default handling (DEF-1 … DEF-5). All ``Column -> Column``."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelflow import fixed_values as FV


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_map(d: dict) -> Column:
    """A small constant map (lives in the plan, not broadcast)."""
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def default(col, value) -> Column:
    """DEF-1: ``dict.get(k, default)`` — missing (and, here, null) becomes ``value``."""
    return F.coalesce(_c(col), F.lit(value))


def language(forced=None, detected=None) -> Column:
    """DEF-2: forced → detected → ``en``; an empty string counts as missing.

    ``forced`` and ``detected`` are Columns (use ``F.lit`` for a forced constant).
    """
    parts = [F.nullif(c, F.lit("")) for c in (forced, detected) if c is not None]
    return F.coalesce(*parts, F.lit(FV.DEFAULT_LANGUAGE))


def negative_prompt(backend, override=None) -> Column:
    """DEF-3: explicit negative prompt, else the backend default (NULL for backends without one)."""
    dflt = F.try_element_at(lit_map(FV.NEGATIVE_PROMPT), _c(backend))
    return dflt if override is None else F.coalesce(_c(override), dflt)


def llm_model(backend, model=None) -> Column:
    """DEF-5: given model, else the text backend's default."""
    dflt = F.try_element_at(lit_map(FV.LLM_DEFAULT_MODEL), _c(backend))
    return dflt if model is None else F.coalesce(_c(model), dflt)


def image_model(backend, model=None) -> Column:
    """DEF-5: given model, else the image backend's default."""
    dflt = F.try_element_at(lit_map(FV.IMAGE_DEFAULT_MODEL), _c(backend))
    return dflt if model is None else F.coalesce(_c(model), dflt)
