"""The reports. Each is one function from a run to its tables, for all units at once."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphreports.functions import labels
from graphreports.functions.times import created_on
from graphreports.functions.uris import resource_uri, stable_id
from graphreports.operators.harvests import last_runs, match_rate, match_units_first_token, unmatched_units
from graphreports.operators.metrics import decisions_by_class, unit_metrics
from graphreports.operators.publications import latest_publication
from graphreports.operators.resources import non_zero
from graphreports.operators.rewrite import PART_PREDICATES, replace_reports
from graphreports.operators.sessions import UNIT, on_day, session_bounds
from graphreports.plans.prefix import Prefix, bounds_of, decisions_of, latest_publication_of, metrics_of, store_prefix
from graphreports.plans.quads import RESOURCES, reports_to_quads
from graphreports.runtime import new_folder, passing, stored as kept
from graphreports.sources import changes
from graphreports.sources.store import write_reports
from graphreports.vocabulary import METRIC_LABELS, RDF_TYPE, Names


@dataclass(frozen=True)
class Run:
    """Input of one nightly run: link tables, merged units and bodies, and the day reported on.

    ``created_at`` is wall-clock time in the local zone. ``window`` restricts metrics to sessions
    planned on one day; without it they are all-time, as published reports are. With ``prefix``, which
    :meth:`prepared` stores, reports start from it instead of the link tables it was made of."""

    tables: Mapping[str, DataFrame]
    units: DataFrame
    bodies: DataFrame
    day: date
    created_at: datetime
    window: date | None = None
    names: Names = Names()
    prefix: Prefix | None = None

    def facts(self) -> Mapping[str, DataFrame]:
        return ChainMap({"session": on_day(self.tables["session"], self.window)}, self.tables)

    def prepared(self, path: str, buckets: int) -> Run:
        """The same run with its shared prefix stored under ``path``."""
        return replace(self, prefix=store_prefix(self.facts(), self.bodies, path, buckets))

    def metrics(self) -> DataFrame:
        """At most seven rows per unit, set down: what is joined to them doesn't hold the shuffles they come from."""
        return kept(metrics_of(self.prefix) if self.prefix else unit_metrics(self.facts(), self.bodies))

    def decisions(self) -> DataFrame:
        """A row per unit and class of body, likewise."""
        return kept(decisions_of(self.prefix) if self.prefix else decisions_by_class(self.facts(), self.bodies))

    def bounds(self) -> DataFrame:
        return bounds_of(self.prefix) if self.prefix else session_bounds(self.facts()["session"], self.bodies)

    def newest(self) -> DataFrame:
        t = self.facts()
        if self.prefix:
            return latest_publication_of(self.prefix, t["publication"], t["publication_source"])
        return latest_publication(t["session"], self.bodies, t["publication"], t["publication_source"])

    def stamped(self, df: DataFrame, kind: str, label: Callable[[Column], Column], *keys: str) -> DataFrame:
        """Add identity, creation time, day, graph and label to rows that carry ``unit_id`` and
        ``unit_label``. The same keys give the same identity."""
        day = F.lit(self.day)
        uuid = stable_id(F.lit(kind), *[F.col(k) for k in (*UNIT, *keys)], day)
        return df.select(
            resource_uri(uuid, self.names.resource_base).alias("report_uri"),
            uuid.alias("uuid"),
            F.lit(self.created_at.isoformat(sep=" ")).cast("timestamp_ntz").alias("created_at"),
            day.alias("day"),
            label(day).alias("label"),
            labels.report_graph(F.col("unit_id"), self.names).alias("graph"),
            *[c for c in df.columns if c not in ("unit_id", "unit_label", "classification")],
        )

    def with_unit(self, df: DataFrame) -> DataFrame:
        """Attach the attributes of each row's unit."""
        return df.join(
            self.units.select(*UNIT, "unit_id", F.col("label").alias("unit_label"), "classification"), UNIT
        )


def governing_body_count_report(run: Run, metrics: DataFrame | None = None) -> DataFrame:
    """One report per harvester and unit that has a count. It sums up all bodies of the unit, so
    no body is named."""
    metrics = run.metrics() if metrics is None else metrics
    reported = run.with_unit(metrics.select(*UNIT).distinct()).withColumn(
        "class_label", labels.unit_kind(F.col("classification"))
    ).withColumn("body_uri", F.lit(None).cast("string"))
    return run.stamped(
        reported, "body-count",
        lambda day: labels.body_report_label(F.col("class_label"), day, F.col("unit_label")),
    )


def publication_count_report(run: Run, metrics: DataFrame | None = None) -> DataFrame:
    """One row per non-zero count, belonging to a report of the table above."""
    metrics = run.metrics() if metrics is None else metrics
    day = F.lit(run.day)
    uuid = stable_id(F.lit("metric-count"), F.col("harvester"), F.col("unit_uri"), F.col("metric"), day)
    report = stable_id(F.lit("body-count"), F.col("harvester"), F.col("unit_uri"), day)
    wording = F.lit(None).cast("string")
    for metric, text in METRIC_LABELS.items():
        wording = F.when(F.col("metric") == metric, F.lit(text)).otherwise(wording)
    # Digests and wording are computed once per row, below what is put together from them: an
    # exploded array of one keeps the two steps apart.
    once = F.struct(uuid.alias("uuid"), report.alias("report"), wording.alias("wording"))
    rows = run.with_unit(metrics).select(*UNIT, "unit_id", "n", F.explode(F.array(once)).alias("k"))
    return rows.select(
        resource_uri(F.col("k.uuid"), run.names.resource_base).alias("count_uri"),
        resource_uri(F.col("k.report"), run.names.resource_base).alias("report_uri"),
        F.col("k.uuid").alias("uuid"),
        day.alias("day"),
        labels.report_graph(F.col("unit_id"), run.names).alias("graph"),
        *UNIT,
        labels.metric_class(F.col("k.wording")).alias("target_class"),
        labels.metric_count_label(F.col("k.wording")).alias("label"),
        F.col("n").alias("count"),
    )


def admin_unit_count_report(run: Run, metrics: DataFrame | None = None) -> DataFrame:
    """One report per harvester and unit, linking the unit's count report if there is one."""
    metrics = run.metrics() if metrics is None else metrics
    report = stable_id(F.lit("body-count"), F.col("harvester"), F.col("unit_uri"), F.lit(run.day))
    counted = metrics.select(*UNIT).distinct().withColumn("reported", F.lit(True))
    units = run.units.select(*UNIT, "unit_id", F.col("label").alias("unit_label"), "classification")
    linked = units.join(counted, UNIT, "left").withColumn(
        "governing_body_reports",
        F.when(F.col("reported"), F.array(resource_uri(report, run.names.resource_base))).otherwise(
            F.array().cast("array<string>")
        ),
    ).drop("reported")
    return run.stamped(
        linked, "unit-count", lambda day: labels.unit_report_label(F.col("unit_label"), day)
    )


def decision_report(run: Run) -> DataFrame:
    """Resolutions per unit and class of governing body."""
    counts = non_zero(run.decisions()).withColumnRenamed("n", "count")
    return run.stamped(
        run.with_unit(counts), "decision",
        lambda day: labels.decision_label(F.col("unit_label"), day), "class_label",
    )


def session_timestamp_report(run: Run) -> DataFrame:
    """First and last planned session of each unit."""
    return run.stamped(
        run.with_unit(run.bounds()), "session-timestamp",
        lambda day: labels.session_label(F.col("unit_label"), day),
    )


def maturity_report(run: Run) -> DataFrame:
    """Source of each unit's newest publication; none where the newest has no source, even if
    an older one has."""
    sourced = run.newest().filter(F.col("derived_from").isNotNull()).select(
        *UNIT, F.col("derived_from").alias("notule_uri")
    )
    return run.stamped(run.with_unit(sourced), "maturity", labels.maturity_label)


def last_harvest_report(run: Run) -> DataFrame:
    """One report with one record per match of a unit and a last run."""
    keys = ("scheduled_job", "title", "status")
    runs = last_runs(run.tables["harvest_run"])
    matched = match_units_first_token(
        run.units.select(*UNIT, "unit_id", "label", "classification"), runs
    ).withColumnsRenamed({"label": "unit_label", "last_modified": "last_execution_time"})
    matched = matched.withColumn("record_label", F.col("unit_label")).withColumn(
        "record_uuid",
        stable_id(F.lit("harvest-record"), *[F.col(k) for k in (*UNIT, *keys)], F.lit(run.day)),
    )
    return run.stamped(
        matched, "harvest", lambda day: labels.harvest_label(F.col("unit_label"), day), *keys
    ).withColumn("record_uri", resource_uri(F.col("record_uuid"), run.names.resource_base))


def last_harvest_record(run: Run, reports: DataFrame | None = None) -> DataFrame:
    """The records of the reports above, one each."""
    reports = last_harvest_report(run) if reports is None else reports
    return reports.select(
        "record_uri", F.col("record_uuid").alias("uuid"), "report_uri", "day", "graph", *UNIT,
        F.col("record_label").alias("label"), "last_execution_time", "status",
    )


def harvest_match(run: Run) -> tuple[DataFrame, DataFrame]:
    """Units without a last run, and the match rate per harvester."""
    runs = last_runs(run.tables["harvest_run"])
    return unmatched_units(run.units, runs), match_rate(run.units, runs)


def count_reports(run: Run) -> dict[str, DataFrame]:
    """The three tables of the count report. They share the metrics, which are counted once."""
    metrics = run.metrics()
    return {
        "governing_body_count_report": governing_body_count_report(run, metrics),
        "publication_count_report": publication_count_report(run, metrics),
        "admin_unit_count_report": admin_unit_count_report(run, metrics),
    }


def harvest_reports(run: Run) -> dict[str, DataFrame]:
    reports = last_harvest_report(run)
    unmatched, rate = (df.withColumn("day", F.lit(run.day)) for df in harvest_match(run))
    return {
        "last_harvest_report": reports,
        "last_harvest_record": last_harvest_record(run, reports),
        "unmatched_units": unmatched,
        "match_rate": rate,
    }


# Report functions by key; adding a report means adding a function here.
REPORTS: dict[str, Callable[[Run], dict[str, DataFrame]]] = {
    "COUNT_RESOURCES": count_reports,
    "CHECK_HARVESTING_EXECUTION_TIME": harvest_reports,
    "CHECK_MATURITY_LEVEL": lambda run: {"maturity_report": maturity_report(run)},
    "CHECK_SESSION_TIMESTAMPS": lambda run: {"session_timestamp_report": session_timestamp_report(run)},
    "DECISION_REPORT_DAILY": lambda run: {"decision_report": decision_report(run)},
}


def run_report(key: str, run: Run, path: str | None = None) -> dict[str, DataFrame]:
    """Tables of one report. With ``path`` they are also written, replacing the same units' rows
    of the same day."""
    try:
        build = REPORTS[key]
    except KeyError:
        raise ValueError(f"unknown report {key!r}, expected one of {sorted(REPORTS)}") from None
    tables = build(run)
    if path is not None:
        for name, df in tables.items():
            write_reports(df, f"{path}/{name}", [*UNIT, "day"] if "unit_uri" in df.columns else ["harvester", "day"], run.day)
    return tables


def run_reports(run: Run, path: str | None = None, buckets: int | None = None) -> dict[str, DataFrame]:
    """Tables of all reports of a run. They share one stored prefix, so sessions meet bodies and items once; with ``path`` they are
    also written as :func:`run_report` does. ``buckets`` is by default the session's shuffle width."""
    spark = run.units.sparkSession
    width = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = run.prepared(new_folder(spark, "prefix"), width)
    tables: dict[str, DataFrame] = {}
    for key in REPORTS:
        tables |= run_report(key, ready, path)
    return tables


def publish_reports(quads: DataFrame, tables: Mapping[str, DataFrame], run: Run) -> DataFrame:
    """``quads`` with the report tables written into their units' graphs, in place of the day's
    reports of the same classes there. Publishing twice changes nothing more."""
    out = quads
    for name, df in tables.items():
        if name not in RESOURCES:
            continue
        new = reports_to_quads(df, RESOURCES[name], run.names)
        if RESOURCES[name].parent is None:
            out = replace_reports(out, new, run.names.iri(RESOURCES[name].cls), run.day, run.names)
        else:  # the parts of a report went with it
            out = out.unionByName(new)
    return out


def publish_all(spark: SparkSession, path: str, tables: Mapping[str, DataFrame], run: Run) -> int:
    """Write all tables of a run into their units' graphs of the change store at ``path``, in place of the day's reports of the same classes
    there, as one change; its version. Publishing twice changes nothing more.

    Reads the creation times, classes and part links of the harvesters reported on, and of these the row groups in the range of the
    graphs written to. No other quads are read, and none are rewritten."""
    with passing(spark) as kept:
        new = kept(quads_of(tables, run.names))
        names = run.names
        classes = [names.iri(RESOURCES[name].cls) for name in tables if name in RESOURCES and RESOURCES[name].parent is None]
        harvesters = [r[0] for r in new.select("harvester").distinct().collect()]
        low, high = new.agg(F.min("g"), F.max("g")).first()

        def stored(*predicates: str) -> DataFrame:
            found = changes.load(spark, path, harvesters, predicates)
            return found.filter(F.col("g").between(low, high)) if harvesters else found

        typed = lambda quads: quads.filter((F.col("p") == RDF_TYPE) & F.col("o").isin(classes)).select("harvester", "g", "s", "o")
        created = stored(names.iri("monitoring:createdAt")).filter(created_on(F.col("o"), run.day)).select("harvester", "g", "s")
        replaced = typed(stored(RDF_TYPE)).join(typed(new).select("harvester", "g", "o").distinct(), ["harvester", "g", "o"], "left_semi")
        doomed = kept(replaced.join(created, ["harvester", "g", "s"], "left_semi").select("harvester", "g", "s").distinct())
        parts = stored(*map(names.iri, PART_PREDICATES)).join(doomed, ["harvester", "g", "s"], "left_semi")
        doomed = doomed.unionByName(parts.select("harvester", "g", F.col("o").alias("s")))
        return changes.apply(spark, path, added=new, gone=changes.gone_subjects(doomed, inbound=True))


def quads_of(tables: Mapping[str, DataFrame], names: Names = Names()) -> DataFrame:
    """All report tables that have a published form, as quads."""
    frames = [reports_to_quads(df, RESOURCES[name], names) for name, df in tables.items() if name in RESOURCES]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
