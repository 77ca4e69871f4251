"""The relations a report starts from, built lazily over one dataset."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from basketlens.operators import features, lines, rfm
from basketlens.session import settle
from basketlens.sources.tables import load_retail

TARGET_MONTHS = 6


class Views:
    """Lazy derived relations. Segments here come from money quartiles, so every result has an SQL counterpart.

    The customer-level tables that segments and value classes start from are settled: thresholds and labels read them
    several times, and computing them means reading every order line.
    """

    def __init__(self, spark: SparkSession, folder: str, fits: dict[tuple, object] | None = None):
        self.spark = spark
        self.fits = {} if fits is None else fits
        self.folder = folder
        self.retail = load_retail(spark, folder)

    @cached_property
    def sizes(self) -> DataFrame:
        return lines.invoice_sizes(self.retail)

    @cached_property
    def facts(self) -> DataFrame:
        return lines.invoice_facts(self.retail)

    @cached_property
    def category_facts(self) -> DataFrame:
        return lines.category_facts(self.retail)

    @cached_property
    def scores(self) -> DataFrame:
        return rfm.rfm(self.facts, self.retail.invoices)

    @cached_property
    def score_table(self) -> DataFrame:
        """``scores`` settled, for operators that read them more than once."""
        return settle(self.scores)

    @cached_property
    def clustered(self) -> DataFrame:
        return settle(rfm.quartile_groups(self.score_table))

    @cached_property
    def segmented(self) -> DataFrame:
        return rfm.segment_rules(self.clustered)

    @cached_property
    def segments(self) -> DataFrame:
        return self.segmented.select("customer_id", "segment")

    @cached_property
    def targets(self) -> DataFrame:
        """Every customer with invoices and the recent spending, without the other features; one pass over the lines."""
        return features.scores_with_target(self.facts, self.retail.invoices, TARGET_MONTHS).drop("frequency")

    @cached_property
    def target_table(self) -> DataFrame:
        """``targets`` settled, for operators that read them more than once."""
        return settle(self.targets)

    @cached_property
    def classes(self) -> DataFrame:
        return settle(features.ltv_class(self.target_table))

    @cached_property
    def features(self) -> DataFrame:
        """All features and the target. The segments come from the scores among them, so the lines are read once."""
        profiles = settle(features.customer_profiles(self.retail, TARGET_MONTHS))
        scores = profiles.select("customer_id", *rfm.METRICS)
        segments = rfm.segment_rules(settle(rfm.quartile_groups(scores)))
        return features.with_segments(profiles, self.retail.customers, segments)

    @cached_property
    def labelled(self) -> DataFrame:
        """Features, target and value class of every customer, settled: the models read them many times."""
        return settle(features.ltv_class(settle(self.features)))
