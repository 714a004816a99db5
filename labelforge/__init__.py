"""labelforge: labelled-text dataset building and classifier evaluation on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
column expressions, joins, windows and aggregates; Python runs inside tasks
only for the client calls (annotation, translation) and batch inference.
"""

from labelforge.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
