"""The scored profile as one run: discovery, pages, evidence, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.operators import scored
from tonguemap.operators.discovery import Discovery, fetch_errors
from tonguemap.operators.stage import stage, together


class ScoredRun:
    """The tables of one run; those that several others read are staged.

    ``pages`` is the output of :func:`tonguemap.operators.pages.scored_pages`. What ``discovery`` found (it may be a
    function that runs it), start URLs and sitemap URLs, is evidence ahead of all pages, and its failures are counted
    with those of the pages. Without it a run knows of no URLs but those that its pages name.
    """

    def __init__(
        self, pages: DataFrame, discovery: Discovery | Callable[[], Discovery] | None = None, cfg: EngineConfig = DEFAULT
    ):
        self.cfg = cfg
        # discovery does not read pages, so both may run at the same time
        self.pages, discovery = together(lambda: stage(pages, "scored-pages"), lambda: discovery() if callable(discovery) else discovery)
        self.discovery = discovery
        known = discovery.urls if discovery else None
        self.discovered = stage(scored.discovered_urls(self.pages, known), "discovered")
        self.trusted = stage(scored.trusted_evidence(self.pages, self.discovered, cfg), "trusted")
        self.gate = scored.supplemental_gate(self.pages, self.trusted)
        self.points = scored.evidence_points(self.trusted, self.gate, cfg)
        self.scores = scored.language_scores(self.points)
        self.findings = scored.language_findings(self.scores, cfg)
        self.warnings = scored.warnings(self.gate)
        self.errors = fetch_errors(discovery, self.pages)
        self.counts = scored.discovery_counts(self.pages, self.discovered, self.errors, discovery.sitemaps if discovery else None)
        domains = self.pages.select("domain").distinct()
        if discovery is not None:
            domains = domains.unionByName(discovery.starts.select("domain")).distinct()
        self.report = scored.language_report(self.findings, self.warnings, domains)

    def documents(self) -> DataFrame:
        """Nested reports."""
        candidates = scored.finding_urls(self.pages, self.discovered, self.gate)
        samples = scored.finding_sample_urls(candidates, self.cfg)
        sources = scored.finding_sources(self.points, self.scores)
        return scored.report_documents(self.findings, sources, samples, self.warnings, self.counts)

    def visited(self, visits: DataFrame) -> ScoredRun:
        """The same run over the pages of a crawl only: ``visits`` (domain, url, rank), in that order."""
        first = self.pages.groupBy("domain", "url").agg(F.min("seq").alias("seq"))
        ranked = visits.select("domain", "url", "rank").join(first, ["domain", "url"]).select("domain", "seq", "rank")
        pages = self.pages.join(ranked, ["domain", "seq"]).withColumn("seq", F.col("rank").cast("long")).drop("rank")
        return ScoredRun(pages, self.discovery, self.cfg)
