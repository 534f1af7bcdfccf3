"""Feature records: ragged form, checks, selection of configured features."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from inkprint.functions import arrays
from inkprint.schema import FEATURES

MAX_POST_SYMBOLS = 32


@dataclass(frozen=True)
class FeatureConfig:
    """Which features a record carries. The defaults are the published experiment settings."""

    context_features: list[str] = field(default_factory=lambda: ["author_id", "num_posts"])
    sequence_features: list[str] = field(default_factory=lambda: ["hour", "action_type", "lens", "syms"])
    label_feature: str = "author_id"
    num_symbols: int = 65536
    num_action_types: int = 2048
    padded_length: int = 32

    def __post_init__(self) -> None:
        for name in [*self.context_features, *self.sequence_features, self.label_feature]:
            if name not in FEATURES:
                raise ValueError(f"unknown feature {name!r}; known: {sorted(FEATURES)}")
        if not self.context_features or not self.sequence_features:
            raise ValueError("both feature lists need at least one feature")

    @classmethod
    def from_json(cls, path: str) -> FeatureConfig:
        with open(path) as source:
            return cls(**json.load(source))

    def to_json(self, path: str) -> None:
        with open(path, "w") as sink:
            json.dump(asdict(self), sink, indent=2)

    @property
    def columns(self) -> list[str]:
        return [*self.context_features, *self.sequence_features]


def truncate_symbols(histories: DataFrame, max_length: int = MAX_POST_SYMBOLS) -> DataFrame:
    return histories.withColumn("syms", arrays.truncate_rows(F.col("syms"), max_length))


def ragged_features(histories: DataFrame, max_length: int | None = None) -> DataFrame:
    """Nested symbols to flat values, row lengths and number of posts in the row. Whole posts, unless `max_length` is
    given."""
    rows = F.col("syms") if max_length is None else arrays.truncate_rows(F.col("syms"), max_length)
    cut = histories.withColumn("_rows", rows)
    return cut.withColumns({
        "syms": F.flatten("_rows"), "lens": arrays.row_lengths(F.col("_rows")),
        "num_posts": F.size("_rows").cast("bigint")}).drop("_rows")


def nested_symbols(records: DataFrame) -> DataFrame:
    """Flat values back to one row of symbols per post."""
    return records.withColumn("syms", arrays.unflatten(F.col("syms"), F.col("lens")))


def valid_history() -> Column:
    """A usable history: at least one post, and parallel lists of one length."""
    posts = F.size("syms")
    same = (F.size("hour") == posts) & (F.size("minute") == posts) & (F.size("day") == posts) & (
        F.size("action_type") == posts)
    return F.coalesce(F.col("author_id").isNotNull() & (posts > 0) & same & F.forall("syms", lambda r: r.isNotNull()),
                      F.lit(False))


def history_violations(histories: DataFrame) -> DataFrame:
    """Number of histories checked and of rows failing each rule. A long history is several rows but has one segment 0."""
    return histories.agg(
        _histories(histories).alias("n_rows"),
        F.count_if(F.coalesce(F.size("syms") < 1, F.lit(True))).alias("n_empty"),
        F.count_if(~valid_history()).alias("n_invalid"))


def _histories(rows: DataFrame) -> Column:
    return F.count_if(F.col("segment") == 0) if "segment" in rows.columns else F.count("*")


def record_violations(records: DataFrame) -> DataFrame:
    total = F.aggregate("lens", F.lit(0), lambda acc, x: acc + x)
    return records.agg(
        _histories(records).alias("n_rows"),
        F.count_if(total != F.size("syms")).alias("n_bad_length"),
        F.count_if(F.size("lens") != F.col("num_posts")).alias("n_bad_posts"))


def select_features(records: DataFrame, config: FeatureConfig) -> DataFrame:
    """Only the configured columns, and the segment that orders the rows of a long history: the scan below reads
    nothing else."""
    return records.select(*_segment(records), *config.columns)


def _segment(records: DataFrame) -> list[str]:
    return ["segment"] if "segment" in records.columns else []


def split_label(records: DataFrame, config: FeatureConfig) -> DataFrame:
    others = [c for c in config.columns if c != config.label_feature]
    return records.select(*_segment(records), F.struct(*others).alias("features"), F.col(config.label_feature).alias("label"))


def pad_posts(records: DataFrame, length: int = MAX_POST_SYMBOLS) -> DataFrame:
    """Dense rows of exactly `length` symbols, zeros on the right. A longer post is an error: truncate first."""
    return records.withColumn("syms", arrays.pad_rows(arrays.unflatten(F.col("syms"), F.col("lens")), length))
