"""Dataset providers (S11): where a dataset's rows come from and which columns hold
its key, text and labels.  The dataset pipelines start from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge import spec
from labelforge.sources import views


@dataclass(frozen=True)
class DatasetProvider:
    """``load`` gives the rows; the text is the first of ``text_cols`` that they have."""

    name: str
    load: Callable[[SparkSession, str], DataFrame]
    tables: tuple[str, ...]
    key_cols: tuple[str, ...]
    label_cols: tuple[str, ...] = ()
    text_cols: tuple[str, ...] = ("text", "sentence")


def open_dataset(provider: DatasetProvider, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider's key columns, its text as ``text`` and its label columns.  Of columns
    that share a name the first counts; a missing column is an error that names
    it, raised before any job runs."""
    df = spec.drop_duplicate_columns(provider.load(spark, sf_dir))
    text = spec.resolve_column(df, provider.text_cols)
    if text is None:
        raise ValueError(f"{provider.name}: none of the text columns {list(provider.text_cols)}")
    spec.require_columns(df, [*provider.key_cols, *provider.label_cols])
    return df.select(*provider.key_cols, F.col(text).alias("text"), *provider.label_cols)


POSTS = DatasetProvider("posts", views.posts, ("documents",), ("doc_id",), ("sentiment",))
SCORED_TURNS = DatasetProvider("scored turns", views.scored_turns, ("conversations",), ("conv_id", "turn"),
                               tuple(spec.SCORE_COLUMNS))
MAILS = DatasetProvider("mails", views.raw_mail, ("documents",), ("doc_id",), text_cols=("message",))
