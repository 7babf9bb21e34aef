"""reelflow — a PySpark engine for corpora of timed transcripts.

Every operator is either ``Column -> Column`` (``reelflow.functions``) or
``DataFrame -> DataFrame`` (``reelflow.operators``) keyed by ``video_id``, so a
whole corpus of videos is processed by one Spark plan.
"""

__all__ = ["session"]
