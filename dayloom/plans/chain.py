"""The account of a day over the supplied tables, step by step, each step made when it is asked for.

Steps that several roll-ups read are stored as Parquet: a query that joins them
back together would else work the whole chain out once for each.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import blocks, rollup, rules, stretches
from ..sources import fixtures, traces
from ..sources.store import FILE_ROWS, stored


class Chain:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def traces(self) -> DataFrame:
        return fixtures.traces(self.spark, self.sf_dir)

    @cached_property
    def live_traces(self) -> DataFrame:
        return fixtures.live_traces(self.spark, self.sf_dir)

    @cached_property
    def rules(self) -> DataFrame:
        return fixtures.rules(self.spark)

    @cached_property
    def entries(self) -> DataFrame:
        return traces.entries(self.traces)

    @cached_property
    def targets(self) -> DataFrame:
        return rules.targets(self.entries)

    @cached_property
    def hits(self) -> DataFrame:
        return rules.all_hits(self.targets, rules.parse_rules(self.rules))

    @cached_property
    def named(self) -> DataFrame:
        return rules.named(self.entries, self.rules)

    @cached_property
    def hot(self) -> DataFrame | None:
        return blocks.hot_days(self.entries)

    @cached_property
    def b(self) -> DataFrame:
        return stored(blocks.attributed(stored(self.named, FILE_ROWS), self.hot), FILE_ROWS)

    @cached_property
    def h(self) -> DataFrame:
        return stretches.head_tail(blocks.spread(self.b) if self.hot is None else self.b, self.hot)

    @cached_property
    def p(self) -> DataFrame:
        return stored(stretches.pieces(self.h, fixtures.answers(self.spark), self.hot))

    @cached_property
    def s(self) -> DataFrame:
        return stretches.stretches(self.p)

    @cached_property
    def live(self) -> DataFrame:
        return stretches.live_sessions(self.b)

    @cached_property
    def agent(self) -> DataFrame:
        return stretches.agent_overlap(self.s, self.live)

    @cached_property
    def runs(self) -> DataFrame:
        return stored(stretches.runs(self.p, self.h))

    @cached_property
    def pauses(self) -> DataFrame:
        return fixtures.pauses(self.spark)

    @cached_property
    def claims(self) -> DataFrame:
        return rollup.claimed_pauses(self.pauses, self.runs, self.entries)

    @cached_property
    def rows(self) -> DataFrame:
        return rollup.project_rows(self.b, self.s, self.agent, self.claims)

    @cached_property
    def totals(self) -> DataFrame:
        return rollup.day_totals(self.h, self.s, self.agent, self.claims)

    @cached_property
    def subjects(self) -> DataFrame:
        return rollup.subject_rows(self.b, self.s)

    @cached_property
    def unmatched(self) -> DataFrame:
        return rollup.unmatched(self.b, self.s)
