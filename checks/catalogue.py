"""Every registered query with the SQL it is checked against.

A query builds its inputs from the supplied tables through ``Projection`` and runs library
operators over all of them. The SQL states the same result the plain way: joins written out per
metric, no shared steps.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.projection import BASE, ITEM, PROJECTION, SESSION, STAMP, Projection, harvester, text, uri, with_projection
from graphreports.functions import labels, terms, times, uris
from graphreports.functions import text as texts
from graphreports.operators import harvests, metrics, publications, resources, rewrite, sessions, units
from graphreports.plans import quads as report_quads
from graphreports.plans import reports
from graphreports.plans.queries import query as parameterised
from graphreports.runtime import configure, file_system, new_folder, stored
from graphreports.sources import changes, graph, links, nquads, store
from graphreports.vocabulary import (
    DAY_OF_WEEK,
    JOB_GRAPH,
    METRIC_LABELS,
    MUNICIPALITY,
    PREFIXES,
    PROVINCE,
    RDF_TYPE,
    REPEAT_FREQUENCY,
    REPORT_GRAPH_BASE,
    REPORT_GRAPH_SUFFIX,
    RESOURCE_BASE,
    RUN_FAILED,
    RUN_SUCCESS,
    WELFARE_CENTRE,
    iri,
)

DAY = date(2024, 3, 31)
CREATED_AT = datetime(2024, 3, 31, 3, 30)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of a Projection under ``name``, with its SQL if it has one."""

    def decorate(build: Callable[[Projection], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Projection(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_projection(sql, STEPS)
        return build

    return decorate


# --- shared steps of the SQL -------------------------------------------------------------------

_SPACES = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_UNIT = "harvester, unit_uri"


def _same(left: str, left_column: str, right: str, right_column: str | None = None) -> str:
    """Join on one composed key: given two equalities, the engine would combine the few harvesters
    of far-apart tables first and multiply their rows."""
    key = lambda alias, column: f"concat({alias}.harvester, ' ', {alias}.{column})"
    return f"{key(left, left_column)} = {key(right, right_column or left_column)}"


_HELD = "{session} s join {merged_body} b on " + _same("s", "held_by", "b", "body_uri")
_ITEMS = _HELD + " join {session_item} si on " + _same("si", "session_uri", "s")
_TYPED = _ITEMS + " join {item} i on " + _same("i", "item_uri", "si")
_HANDLED = " join {handling_subject} hs on " + _same("hs", "item_uri", "si")
_RESOLVED = (
    _HANDLED
    + " join {handling_resolution} hr on " + _same("hr", "handling_uri", "hs")
    + " join {resolution} r on " + _same("r", "resolution_uri", "hr")
)
_VOTED = _HANDLED + " join {handling_vote} hv on " + _same("hv", "handling_uri", "hs")
_STARTED = " where s.planned_start is not null"


def _trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_SPACES}+|{_SPACES}+$', '', 'g')"


def _strip_once(expr: str) -> str:
    return (
        f"case when regexp_matches(lower({expr}), '^{_SPACES}') then regexp_replace(lower({expr}), '^{_SPACES}+', '')"
        f" else regexp_replace(lower({expr}), '{_SPACES}+$', '') end"
    )


def _uuid(*parts: str) -> str:
    pieces = ", ".join(f"coalesce(concat(length({x}), ':', {x}), '-')" for x in parts)
    digest = f"md5(concat({pieces}))"
    pieces = ", ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"concat_ws('-', {pieces})"


def _count(source: str, column: str, where: str = _STARTED) -> str:
    return f"select b.harvester, b.unit_uri, count(distinct {column}) as n from {source}{where} group by all"


_NO_TITLE = " and not exists (select 1 from {item_title} t where t.harvester = si.harvester and t.item_uri = si.item_uri)"
_NO_DESCRIPTION = " and not exists (select 1 from {item_description} t where t.harvester = si.harvester and t.item_uri = si.item_uri)"
_DUPLICATE_TITLES = (
    "select b.harvester, b.unit_uri, t.title, t.title_datatype, t.title_lang, count(distinct si.item_uri) as n from "
    + _TYPED
    + " join {item_title} t on " + _same("t", "item_uri", "si")
    + " join {item_doc} d on " + _same("d", "item_uri", "si")
    + _STARTED
    + " group by all having count(distinct d.doc_uri) > 1 and count(distinct si.item_uri) >= 2"
)
METRIC_SQL = {
    "sessions": _count(_HELD, "s.session_uri"),
    "items": _count(_ITEMS, "si.item_uri", ""),
    "items_without_title": _count(_TYPED, "si.item_uri", _STARTED + _NO_TITLE),
    "items_without_description": _count(_TYPED, "si.item_uri", _STARTED + _NO_DESCRIPTION),
    "resolutions": _count(_TYPED + _RESOLVED, "r.resolution_uri"),
    "votes": _count(_ITEMS + _VOTED, "hv.vote_uri"),
    "duplicate_items": f"select {_UNIT}, cast(sum(n) as bigint) as n from ({_DUPLICATE_TITLES}) group by all",
}
_METRICS = " union all ".join(
    f"select {_UNIT}, '{name}' as metric, '{METRIC_LABELS[name]}' as metric_label, n from ({sql})"
    for name, sql in METRIC_SQL.items()
)
_DAY = f"'{DAY}'"
_STAMPED = f"timestamp '{CREATED_AT}' as created_at, date '{DAY}' as day"
_GRAPH = f"concat('{REPORT_GRAPH_BASE}', u.unit_id, '{REPORT_GRAPH_SUFFIX}') as graph"
_WITH_UNIT = " join {unit} u on u.harvester = x.harvester and u.unit_uri = x.unit_uri"


def _identity(kind: str, *keys: str) -> str:
    uuid = _uuid(f"'{kind}'", "x.harvester", "x.unit_uri", *keys, _DAY)
    return f"concat('{RESOURCE_BASE}', {uuid}) as report_uri, {uuid} as uuid"


_BEST_PUBLICATION = (
    "select b.harvester, b.unit_uri, s.planned_start, s.session_uri, p.url, ps.derived_from, row_number() over ("
    " partition by b.harvester, b.unit_uri order by s.planned_start desc, s.session_uri, p.url, ps.derived_from nulls last) as rn from "
    + _HELD
    + " join {publication} m on m.kind = 'notulen' and " + _same("m", "session_uri", "s")
    + " join {publication} p on " + _same("p", "session_uri", "s")
    + " left join {publication_source} ps on " + _same("ps", "url", "p")
    + _STARTED
)

STEPS = {
    "admin_unit": """
        select unit_uri, string_agg(distinct unit_id, ',' order by unit_id) as unit_id,
               string_agg(distinct label, ',' order by label) as label, min(classification) as classification,
               count(distinct unit_id) > 1 or count(distinct label) > 1 as dirty
        from {unit_property} group by unit_uri
    """,
    "harvester_unit": f"""
        select distinct t.harvester, u.unit_uri, u.unit_id, u.label, u.classification
        from (select *, unnest(string_split(label, ',')) as part from {{admin_unit}}) u
        join {{harvest_title}} t on lower({_trim('part')}) = lower(t.title)
    """,
    "survivor": f"""
        select harvester, unit_uri as member_uri, first_value(unit_uri) over w as unit_uri, first_value(unit_id) over w as unit_id,
               first_value(label) over w as label, first_value(classification) over w as classification
        from (select *, case when classification = '{PROVINCE}' then concat('unit:', unit_uri)
                        else concat('label:', nfc_normalize(lower({_trim('label')}))) end as merge_key from {{harvester_unit}})
        window w as (partition by harvester, merge_key order by case when classification = '{WELFARE_CENTRE}' then 1 else 0 end, unit_uri
                     rows between unbounded preceding and unbounded following)
    """,
    "unit": "select distinct harvester, unit_uri, unit_id, label, classification from {survivor}",
    "merged_body": """
        select distinct v.harvester, v.unit_uri, b.body_uri, b.class_label
        from {unit_body} b join {survivor} v on v.member_uri = b.unit_uri
    """,
    "metric": _METRICS,
    "reported_metric": "select harvester, unit_uri, metric, metric_label, n from (select *, max(case when metric = 'sessions' then n end)"
    " over (partition by harvester, unit_uri) as planned from {metric}) where n > 0 and planned > 0",
    "decision": "select b.harvester, b.unit_uri, b.class_label, count(distinct r.resolution_uri) as n from "
    + _TYPED + _RESOLVED + _STARTED + " group by all",
    "last_run": f"""
        select harvester, scheduled_job, title, status, max(modified) as last_modified from {{harvest_run}}
        where status in ('{RUN_SUCCESS}', '{RUN_FAILED}') group by all
    """,
    "matched": f"""
        select u.*, r.scheduled_job, r.title, r.status, r.last_modified from {{unit}} u join {{last_run}} r
        on r.harvester = u.harvester and {_strip_once('r.title')} = {_strip_once("string_split(u.label, ',')[1]")}
    """,
    "latest": f"select * exclude (rn) from ({_BEST_PUBLICATION}) where rn = 1",
    "decision_row": f"""
        select {_identity('decision', 'x.class_label')}, {_STAMPED},
               concat('Report of decisions for ', u.label, ' on {DAY}') as label, {_GRAPH},
               x.harvester, x.unit_uri, x.class_label, x.n as count
        from {{decision}} x {_WITH_UNIT} where x.n > 0
    """,
    "metric_row": f"""
        select concat('{RESOURCE_BASE}', {_uuid("'metric-count'", "x.harvester", "x.unit_uri", "x.metric", _DAY)}) as count_uri,
               concat('{RESOURCE_BASE}', {_uuid("'body-count'", "x.harvester", "x.unit_uri", _DAY)}) as report_uri,
               {_uuid("'metric-count'", "x.harvester", "x.unit_uri", "x.metric", _DAY)} as uuid,
               date '{DAY}' as day, {_GRAPH}, x.harvester, x.unit_uri,
               concat('{iri('besluit:')}', x.metric_label) as target_class,
               concat('Count of ''', x.metric_label, '''') as label, x.n as count
        from {{reported_metric}} x {_WITH_UNIT}
    """,
    "harvest_row": f"""
        select {_identity('harvest', 'x.scheduled_job', 'x.title', 'x.status')}, {_STAMPED},
               concat('Report of last harvesting execution times for ', x.label, ' on {DAY}') as label,
               concat('{REPORT_GRAPH_BASE}', x.unit_id, '{REPORT_GRAPH_SUFFIX}') as graph, x.harvester, x.unit_uri,
               x.scheduled_job, x.title, x.status, x.last_modified as last_execution_time, x.label as record_label,
               {_uuid("'harvest-record'", 'x.harvester', 'x.unit_uri', 'x.scheduled_job', 'x.title', 'x.status', _DAY)} as record_uuid
        from {{matched}} x
    """,
}

_NULL_V = "cast(null as varchar)"
# Rows of the report tables that the published reports are checked by, too.
STEPS |= {
    "body_count_row": f"""select {_identity('body-count')}, {_STAMPED},
               concat('Count report for governing body of class ', x.kind, ' on {DAY} for admin unit ''', u.label, '''') as label,
               {_GRAPH}, x.harvester, x.unit_uri, x.kind as class_label, {_NULL_V} as body_uri
        from (select distinct m.harvester, m.unit_uri, case when v.classification = '{MUNICIPALITY}' then 'gemeente' else 'provincie' end as kind
              from {{reported_metric}} m join {{unit}} v on v.harvester = m.harvester and v.unit_uri = m.unit_uri) x {_WITH_UNIT}""",
    "unit_count_row": f"""select {_identity('unit-count')}, {_STAMPED}, concat('Count report for admin unit ''', x.label, ''' on {DAY}') as label,
               concat('{REPORT_GRAPH_BASE}', x.unit_id, '{REPORT_GRAPH_SUFFIX}') as graph, x.harvester, x.unit_uri,
               case when exists (select 1 from {{reported_metric}} m where m.harvester = x.harvester and m.unit_uri = x.unit_uri)
                    then concat('{RESOURCE_BASE}', {_uuid("'body-count'", 'x.harvester', 'x.unit_uri', _DAY)}) else '' end as governing_body_reports
        from {{unit}} x""",
    "maturity_row": f"""select {_identity('maturity')}, {_STAMPED}, 'Report of maturity level for day {DAY}' as label, {_GRAPH},
               x.harvester, x.unit_uri, x.derived_from as notule_uri
        from {{latest}} x {_WITH_UNIT} where x.derived_from is not null""",
    "session_row": f"""select {_identity('session-timestamp')}, {_STAMPED}, concat('Report of session timestamps for ', u.label, ' on {DAY}') as label,
               {_GRAPH}, x.harvester, x.unit_uri, x.first_session, x.last_session
        from (select b.harvester, b.unit_uri, min(s.planned_start) as first_session, max(s.planned_start) as last_session
              from {_HELD}{_STARTED} group by all) x {_WITH_UNIT}""",
}

QUAD_COLUMNS = "harvester, g, s, p, o, o_kind, o_datatype, o_lang"


def dimension(p: Projection) -> tuple[DataFrame, DataFrame]:
    return units.build_dimension(units.clean_units(p["unit_property"]), p["unit_body"], p["harvest_title"])


def bodies(p: Projection) -> DataFrame:
    return dimension(p)[1]


def nightly(p: Projection) -> reports.Run:
    unit, body = dimension(p)
    return reports.Run(p, unit, body, DAY, CREATED_AT)


def _quads_sql(*parts: str) -> str:
    return " union all ".join(f"select {QUAD_COLUMNS} from {{{part}}}" for part in parts)


# --- metrics -------------------------------------------------------------------------------------

for _name, _function in {
    "count_sessions": metrics.count_sessions,
    "count_items": metrics.count_items,
    "count_items_without_title": metrics.count_items_without_title,
    "count_items_without_description": metrics.count_items_without_description,
    "count_resolutions": metrics.count_resolutions,
    "count_votes": metrics.count_votes,
    "count_duplicate_items": metrics.count_duplicate_items,
}.items():
    register(_name, f"select {_UNIT}, n from ({METRIC_SQL[_name.removeprefix('count_')]})")(
        lambda p, f=_function: f(p, bodies(p))
    )


@register("duplicate_titles", _DUPLICATE_TITLES)
def _(p):
    t = p
    items = sessions.unit_items(sessions.unit_sessions(t["session"], bodies(p)), t["session_item"])
    return metrics.duplicate_titles(metrics.started_typed(items, t["item"]), t)


@register("unit_metrics", f"select {_UNIT}, metric, n from {{reported_metric}}")
def _(p):
    return metrics.unit_metrics(p, bodies(p))


@register(
    "count_sessions_with_zeros",
    f"select u.harvester, u.unit_uri, coalesce(c.n, 0) as n from {{unit}} u left join ({METRIC_SQL['sessions']}) c"
    " on c.harvester = u.harvester and c.unit_uri = u.unit_uri",
)
def _(p):
    unit, body = dimension(p)
    return metrics.with_zeros(metrics.count_sessions(p, body), unit)


@register(
    "session_bounds",
    "select b.harvester, b.unit_uri, min(s.planned_start) as first_session, max(s.planned_start) as last_session from "
    + _HELD + _STARTED + " group by all",
)
def _(p):
    return sessions.session_bounds(p["session"], bodies(p))


@register("held_by_unit", f"select b.harvester, b.unit_uri, b.class_label, count(*) as n from {_HELD} group by all")
def _(p):
    return (
        sessions.held_by_unit(p["session"], bodies(p))
        .groupBy("harvester", "unit_uri", "class_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "in_local_day",
    "select harvester, session_uri, held_by, planned_start from {session}"
    " where planned_start >= timestamp '1997-05-28' and planned_start < timestamp '1997-05-29'",
)
def _(p):
    return sessions.on_day(p["session"], date(1997, 5, 28))


CLASSES = ["besluit:Besluit", "besluit:Agendapunt", "besluit:Zitting", "besluit:Stemming"]


@register(
    "count_by_class",
    "select "
    + ", ".join(
        f"count(distinct case when o = '{iri(c)}' then s end) as res_count_{i}" for i, c in enumerate(CLASSES)
    )
    + f" from ({_quads_sql('q_session', 'q_item', 'q_handling')}) where p = '{RDF_TYPE}'",
)
def _(p):
    return metrics.count_by_class(p.quads("q_session", "q_item", "q_handling"), [iri(c) for c in CLASSES])


# --- publications and harvests ---------------------------------------------------------------------


@register("latest_publication", "select * from {latest}")
def _(p):
    return publications.latest_publication(p["session"], bodies(p), p["publication"], p["publication_source"])


@register(
    "publications",
    "select harvester, session_uri, kind, url from {publication} p where exists (select 1 from {publication} m"
    " where m.harvester = p.harvester and m.session_uri = p.session_uri and m.kind = 'notulen')",
)
def _(p):
    return publications.publications(p["publication"])


@register("finished_runs", f"select * from {{harvest_run}} where status in ('{RUN_SUCCESS}', '{RUN_FAILED}')")
def _(p):
    return harvests.finished_runs(p["harvest_run"])


@register("last_runs", "select * from {last_run}")
def _(p):
    return harvests.last_runs(p["harvest_run"])


@register("match_units_first_token", "select * from {matched}")
def _(p):
    return harvests.match_units_first_token(dimension(p)[0], harvests.last_runs(p["harvest_run"]))


_UNMATCHED = (
    "select harvester, unit_uri, label from {unit} u where not exists (select 1 from {matched} m"
    " where m.harvester = u.harvester and m.unit_uri = u.unit_uri)"
)


@register("unmatched_units", _UNMATCHED)
def _(p):
    return reports.harvest_match(nightly(p))[0]


@register(
    "match_rate",
    "select u.harvester, coalesce(m.n, 0) as matched, u.n as units, round(100 * coalesce(m.n, 0) / u.n, 1) as pct"
    " from (select harvester, count(*) as n from {unit} group by harvester) u"
    " left join (select harvester, count(*) as n from {matched} group by harvester) m on m.harvester = u.harvester",
)
def _(p):
    return reports.harvest_match(nightly(p))[1]


# --- units -----------------------------------------------------------------------------------------


@register("match_units_any_token", "select * from {harvester_unit}")
def _(p):
    return units.match_units_any_token(units.clean_units(p["unit_property"]), p["harvest_title"])


@register("survivors", "select * from {survivor}")
def _(p):
    return units.survivors(units.match_units_any_token(units.clean_units(p["unit_property"]), p["harvest_title"]))


@register(
    "merge_units",
    "select u.harvester, u.unit_uri, u.unit_id, u.label, u.classification, b.body_uri, b.class_label from {unit} u"
    " left join {merged_body} b on b.harvester = u.harvester and b.unit_uri = u.unit_uri",
)
def _(p):
    unit, body = dimension(p)
    return unit.join(body, ["harvester", "unit_uri"], "left")


@register("unit_totals", "select harvester, count(*) as units from {unit} group by rollup (harvester)")
def _(p):
    return units.unit_totals(dimension(p)[0])


@register("clean_units", "select unit_uri, unit_id, label, classification, dirty from {admin_unit}")
def _(p):
    return units.clean_units(p["unit_property"])


@register(
    "select_units",
    "select unit_uri, unit_id, label, classification from {unit_property}",
)
def _(p):
    return units.select_units(p.quads("q_unit"))


@register(
    "assemble",
    "select session_uri, string_agg(distinct held_by, ' ' order by held_by) as held_by, count(distinct held_by) as bodies,"
    " case when count(distinct held_by) = 1 then min(held_by) end as only_body,"
    " string_agg(distinct cast(planned_start as varchar), ' ' order by cast(planned_start as varchar)) as planned_start"
    " from {session} group by session_uri",
)
def _(p):
    rows = p["session"].withColumn("planned_start", F.col("planned_start").cast("string"))
    out = resources.assemble(rows, "session_uri", ["held_by", "planned_start"])
    joined = lambda c: F.when(F.size(c) > 0, F.concat_ws(" ", F.col(c)))
    return out.select(
        "session_uri",
        joined("held_by").alias("held_by"),
        F.size("held_by").cast("long").alias("bodies"),
        resources.scalar_or_list(F.col("held_by")).alias("only_body"),
        joined("planned_start").alias("planned_start"),
    )


@register(
    "assemble_parts",
    "select harvester, count(distinct item_uri) as items, count(distinct session_uri) as sessions, true as bounded,"
    " md5(string_agg(distinct item_uri, ' ' order by item_uri)) as digest from {session_item} group by harvester",
)
def _(p):
    """All items and sessions of each harvester, in parts of 500 values at most."""
    out = stored(resources.assemble_parts(p["session_item"], "harvester", ["item_uri", "session_uri"], 500))
    values = F.size("item_uri") + F.size("session_uri")
    sums = out.groupBy("harvester").agg(
        F.sum(F.size("item_uri")).alias("items"), F.sum(F.size("session_uri")).alias("sessions"), (F.max(values) <= 500).alias("bounded")
    )
    return sums.join(resources.ordered_digest(out.select("harvester", F.explode("item_uri").alias("item_uri")), "harvester", "item_uri"), "harvester", "left")


@register("single_row", "select count(*) as sessions, count(distinct session_uri) as distinct_sessions from {session}")
def _(p):
    totals = p["session"].agg(
        F.count(F.lit(1)).alias("sessions"), F.count_distinct("session_uri").alias("distinct_sessions")
    )
    return resources.single_row(totals)


@register(
    "limit_or_all",
    "(select *, true as limited from (select distinct harvester, item_uri from {item}) order by item_uri, harvester limit 25)"
    " union all select harvester, item_uri, false from {item}",
)
def _(p):
    """The feature is the limit: the first 25 of an order, and all rows without one."""
    first = resources.limit_or_all(p["item"].distinct().orderBy("item_uri", "harvester"), 25)
    return first.withColumn("limited", F.lit(True)).union(resources.limit_or_all(p["item"], 0).withColumn("limited", F.lit(False)))


@register(
    "unit_bodies",
    "select distinct unit_uri, body_uri, class_label, kind from {unit_body}",
)
def _(p):
    return links.unit_bodies(p.quads("q_body"))


@register("body_class", "select distinct 'organisations' as harvester, body_uri, class_label from {body_pair}")
def _(p):
    return links.body_class(p.quads("q_body"))


# --- quads -----------------------------------------------------------------------------------------


@register(
    "federate",
    "select 'endpoint-a' as harvester, p, count(*) as n from {q_session} group by all"
    " union all select 'endpoint-b', p, count(*) from {q_item} group by all",
)
def _(p):
    both = graph.federate({"endpoint-a": p["q_session"], "endpoint-b": p["q_item"]})
    return both.groupBy("harvester", "p").agg(F.count(F.lit(1)).alias("n"))


@register(
    "in_graph",
    f"select harvester, p, count(*) as n from ({_quads_sql('q_session', 'q_run')}) where g = '{JOB_GRAPH}' group by all",
)
def _(p):
    jobs = graph.in_graph(p.quads("q_session", "q_run"), JOB_GRAPH)
    return jobs.groupBy("harvester", "p").agg(F.count(F.lit(1)).alias("n"))


@register("instances_of", "select distinct harvester, session_uri as uri from {session}")
def _(p):
    return graph.instances_of(p.quads("harvested"), iri("besluit:Zitting"))


@register("property_of", "select distinct harvester, session_uri as subject, item_uri as object from {session_item}")
def _(p):
    return graph.property_of(p.quads("harvested"), iri("besluit:behandelt"))


@register(
    "star",
    "select distinct s.harvester, s.session_uri as uri, s.held_by, si.item_uri as item from"
    " (select distinct harvester, session_uri, held_by from {session}) s"
    " join {session_item} si on si.harvester = s.harvester and si.session_uri = s.session_uri",
)
def _(p):
    properties = {"held_by": iri("besluit:isGehoudenDoor"), "item": iri("besluit:behandelt")}
    return graph.star(p.quads("q_session"), iri("besluit:Zitting"), properties)


@register(
    "follow_path",
    "select distinct hs.harvester, hs.handling_uri as start, d.doc_uri as \"end\" from {handling_subject} hs"
    " join {item_doc} d on " + _same("d", "item_uri", "hs"),
)
def _(p):
    return graph.follow_path(p.quads("q_handling", "q_item"), [iri("dct:subject"), iri("prov:wasDerivedFrom")])


@register("harvest_titles", "select harvester, title from {harvest_title}")
def _(p):
    return links.harvest_titles(p.quads("q_harvest"))


@register(
    "runs_of_jobs",
    f"""select r.harvester, r.scheduled_job, t.title, r.status, epoch_us(max(r.modified)) as modified from {{harvest_run}} r
        join (select distinct harvester, scheduled_job, title from {{harvest_run}}) t
          on t.harvester = r.harvester and t.scheduled_job = r.scheduled_job
        where r.status in ('{RUN_SUCCESS}', '{RUN_FAILED}') group by all""",
)
def _(p):
    runs = links.runs_of_jobs(p.quads("q_run"))
    return runs.withColumn("modified", F.unix_micros("modified"))


@register(
    "with_any_value",
    f"select distinct harvester, g, s from {{q_run}} where p = '{iri('adms:status')}' and o in ('{RUN_SUCCESS}', '{RUN_FAILED}')",
)
def _(p):
    return graph.with_any_value(p.quads("q_run"), iri("adms:status"), [RUN_SUCCESS, RUN_FAILED])


_O = "o_datatype = '{}'".format


@register(
    "decode_terms",
    f"""
    select s, p, case when o_kind = 'bnode' then '_' when {_O(iri('xsd:string'))} then o end as value_text,
           case when {_O(iri('xsd:boolean'))} then o in ('1', 'true') end as value_boolean,
           case when o_datatype in ('{iri('xsd:integer')}', '{iri('xsd:int')}') then try_cast(o as bigint) end as value_long,
           case when {_O(iri('xsd:double'))} then cast(o as double) end as value_double,
           case when {_O(iri('xsd:dateTime'))} then epoch_us(cast(replace(replace(o, 'T', ' '), 'Z', '') as timestamp)) end as value_timestamp,
           case when {_O(iri('xsd:date'))} then cast(o as date) end as value_date,
           case when {_O(iri('xsd:time'))} then (cast(substr(o, 1, 2) as integer) * 3600 + cast(substr(o, 4, 2) as integer) * 60
                + cast(substr(o, 7, 2) as integer)) * 1000 + 250 end as value_time_ms,
           case when {_O(iri('xsd:time'))} then -330 end as value_time_offset,
           case when {_O(iri('xsd:decimal'))} then 'unsupported_datatype' when {_O(iri('xsd:int'))} then 'malformed' else 'ok' end as status
    from {{q_typed}}
    """,
)
def _(p):
    decoded = terms.decode_terms(p["q_typed"])
    return decoded.withColumn("value_timestamp", F.unix_micros("value_timestamp")).drop(
        "harvester", "g", "o", "o_kind", "o_datatype", "o_lang"
    )


@register("nquads_roundtrip", _quads_sql("q_session", "q_item", "q_document", "q_typed"))
def _(p):
    quads = p.quads("q_session", "q_item", "q_document", "q_typed")
    lines = quads.select("harvester", nquads.statement_text().alias("value"))
    return nquads.parse_nquads(lines, F.col("harvester"))


@register("quads_roundtrip", f"select {_UNIT}, metric, n from {{reported_metric}}")
def _(p):
    """The whole way from stored quads: dimension, link tables, metrics. The store is a table
    written to the shared folder, laid out by harvester and predicate."""
    path = new_folder(p.spark, "quads")
    store.write_quads(p.quads("harvested", "organisations"), path)
    stored = store.load_quads(p.spark, path)
    organisations = stored.filter(F.col("harvester") == "organisations")
    tables = links.link_tables(stored.filter(F.col("harvester") != "organisations"))
    body = units.build_dimension(
        units.clean_units(units.select_units(organisations)),
        links.unit_bodies(organisations),
        tables["harvest_title"],
    )[1]
    return metrics.unit_metrics(tables, body)


_LOCAL_MIDNIGHT = "epoch_us(timezone('Europe/Brussels', cast(cast(o_orderdate as date) as timestamp)))"


@register(
    "link_sessions",
    f"""select {harvester('o_orderkey')} as harvester, {SESSION} as session_uri, o_totalprice >= 25000 as has_start,
               case when o_totalprice < 25000 or o_orderstatus = 'P' then null when o_orderstatus = 'F' then {_LOCAL_MIDNIGHT}
                    else epoch_us(o_orderdate) - 7200000000 end as start
        from {{orders}}""",
)
def _(p):
    """Starts as dates, with an offset without a colon, and as text that is no time at all."""
    return links.session_table(p["q_starts"]).select(
        "harvester", "session_uri", "has_start", F.unix_micros("planned_start").alias("start")
    )


@register(
    "windowed_sessions",
    f"select {harvester('o_orderkey')} as harvester, {SESSION} as session_uri from {{orders}}"
    " where cast(o_orderdate as date) = date '1997-05-28' and o_totalprice >= 25000 and o_orderstatus <> 'P'",
)
def _(p):
    return sessions.on_day(links.session_table(p["q_starts"]), date(1997, 5, 28)).select("harvester", "session_uri")


@register(
    "read_quads_files",
    "select 'organisations' as harvester, g, case when starts_with(s, '_:') then replace(concat('_:dump-', substr(s, 3)), ' ', '_') else s end as s, p,"
    " case when o_kind = 'bnode' then replace(concat('_:dump-', substr(o, 3)), ' ', '_') else o end as o, o_kind, o_datatype, o_lang from {q_body}",
)
def _(p):
    path = new_folder(p.spark, "nquads")
    label = lambda c: F.when(F.col(c).startswith("_:"), F.replace(F.col(c), F.lit(" "), F.lit("_"))).otherwise(F.col(c))
    nquads.write_nquads(p["q_body"].withColumns({"s": label("s"), "o": label("o")}), path)
    return nquads.read_quads(p.spark, path, "organisations", scope="dump")


_BROKEN = "select concat('<http://example.org/', doc_id, '> ', lang) as line, case when doc_id % 3 = 0 then 'https://harvester-0.example.org/sparql' else 'b' end as harvester from {documents}"


@register(
    "read_quads_rejects",
    f"select harvester, 'quad' as status, s, p, o, cast(null as varchar) as line from {{q_body}}"
    f" union all select harvester, 'rejected', {', '.join(['cast(null as varchar)'] * 3)}, line from ({_BROKEN})",
)
def _(p):
    """Statements, and lines that are none, of one pass over a dump that has comments and blank lines, too."""
    label = lambda c: F.when(F.col(c).startswith("_:"), F.replace(F.col(c), F.lit(" "), F.lit("%"))).otherwise(F.col(c))
    good = p["q_body"].withColumns({"s": label("s"), "o": label("o")}).select("harvester", nquads.statement_text().alias("value"))
    bad = p.spark.sql(_BROKEN, documents=p["documents"]).select("harvester", F.col("line").alias("value"))
    other = p["documents"].select(F.lit("c").alias("harvester"), F.when(F.col("doc_id") % 2 == 0, "# note").otherwise(" ").alias("value"))
    lines = good.unionByName(bad).unionByName(other)
    quads, rejects = nquads.stage_quads(lines, F.col("harvester"), new_folder(p.spark, "staged"))
    spaced = lambda c: F.when(F.col(c).startswith("_:"), F.replace(F.col(c), F.lit("%"), F.lit(" "))).otherwise(F.col(c)).alias(c)
    none = F.lit(None).cast("string")
    return quads.select("harvester", F.lit(nquads.QUAD).alias("status"), spaced("s"), "p", spaced("o"), none.alias("line")).unionByName(
        rejects.select("harvester", F.lit(nquads.REJECTED).alias("status"), none.alias("s"), none.alias("p"), none.alias("o"), "line")
    )


_DUMP = "(length(s) * 31 + length(o) * 7 + ascii(right(o, 1))) % 200"
_SCOPED = "case when starts_with({0}, '_:') then replace(concat('_:', dump, '-', substr({0}, 3)), ' ', '_') else {0} end as {0}"


@register(
    "federate_files",
    f"select concat('harvester ', dump % 7) as harvester, g, {_SCOPED.format('s')}, p, {_SCOPED.format('o')}, o_kind, o_datatype, o_lang"
    f" from (select *, {_DUMP} as dump from ({_quads_sql('q_body', 'q_unit')}))",
)
def _(p):
    """Two hundred dumps of seven harvesters, read in one scan."""
    path = new_folder(p.spark, "dumps")
    label = lambda c: F.when(F.col(c).startswith("_:"), F.replace(F.col(c), F.lit(" "), F.lit("_"))).otherwise(F.col(c))
    quads = p.quads("q_body", "q_unit").withColumn("dump", F.expr(_DUMP)).withColumns({"s": label("s"), "o": label("o")})
    quads.select("dump", nquads.statement_text().alias("value")).repartition("dump").write.partitionBy("dump").text(path)
    place, fs = file_system(p.spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()]
    dumps = {f"{path}/{n}": f"harvester {int(n.split('=')[1]) % 7}" for n in names}
    numbers = {nquads.dump_scope(harvester, dump): dump.split("=")[1] for dump, harvester in dumps.items()}
    number = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    named = lambda c: F.when(
        F.col(c).startswith("_:"), F.concat(F.lit("_:"), number[F.substring(c, 3, 12)], F.substring(c, 15, 1000))
    ).otherwise(F.col(c)).alias(c)
    read = nquads.read_dumps(p.spark, dumps)
    return read.select("harvester", "g", named("s"), "p", named("o"), "o_kind", "o_datatype", "o_lang")


_FIRST = "https://harvester-0.example.org/sparql"


@register(
    "reharvest",
    f"select harvester, p, count(*) as n from (select distinct * from (select {QUAD_COLUMNS} from {{q_session}} union all"
    f" select {QUAD_COLUMNS} from {{q_item}} where harvester = '{_FIRST}')) group by all",
)
def _(p):
    """A second harvest of all harvesters but one, which has no predicates of items any more."""
    path = new_folder(p.spark, "quads")
    store.write_quads(p.quads("q_session", "q_item"), path)
    store.write_quads(p["q_session"].filter(F.col("harvester") != _FIRST), path)
    return store.load_quads(p.spark, path).groupBy("harvester", "p").agg(F.count(F.lit(1)).alias("n"))


# --- replacing and deleting --------------------------------------------------------------------------


@register(
    "replace_same_day",
    "select harvester, scheduled_job, title, status, last_modified from {last_run} l where not exists"
    " (select 1 from {harvest_run} n where n.harvester = l.harvester and n.scheduled_job = l.scheduled_job and n.modified >= timestamp '2024-01-20')"
    " union all select harvester, scheduled_job, title, status, modified from {harvest_run} where modified >= timestamp '2024-01-20'",
)
def _(p):
    new = p["harvest_run"].filter(F.col("modified") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return rewrite.replace_same_day(
        harvests.last_runs(p["harvest_run"]),
        new.withColumnRenamed("modified", "last_modified"),
        ["harvester", "scheduled_job"],
    )


_DOOMED = f"select distinct harvester, g, s from {{q_run}} where p = '{iri('adms:status')}' and o = '{RUN_FAILED}'"


@register(
    "delete_subjects",
    f"select {QUAD_COLUMNS} from {{q_run}} q where not exists (select 1 from ({_DOOMED}) d"
    " where d.harvester = q.harvester and d.g = q.g and d.s = q.s)",
)
def _(p):
    quads = p["q_run"]
    return rewrite.delete_subjects(quads, graph.with_any_value(quads, iri("adms:status"), [RUN_FAILED]))


_UNTYPED_ITEMS = "select harvester, g, s from {q_item} where p = '" + iri("dct:description") + "'"


@register(
    "delete_subjects_inbound",
    f"select {QUAD_COLUMNS} from ({_quads_sql('q_item', 'q_handling')}) q where not exists (select 1 from ({_UNTYPED_ITEMS}) d"
    " where d.harvester = q.harvester and d.g = q.g and (d.s = q.s or d.s = q.o))",
)
def _(p):
    doomed = graph.with_any_value(p["q_item"], iri("dct:description"), [])
    return rewrite.delete_subjects(p.quads("q_item", "q_handling"), doomed, inbound=True)


_FINISHED = iri("adms:status") + "/finished"


@register(
    "replace_properties",
    f"""select harvester, g, s, p,
               case when p = '{iri('adms:status')}' and o = '{RUN_SUCCESS}' then '{_FINISHED}' else o end as o,
               o_kind, o_datatype, o_lang from {{q_run}}""",
)
def _(p):
    quads = p["q_run"]
    status = quads.filter((F.col("p") == iri("adms:status")) & (F.col("o") == RUN_SUCCESS))
    return rewrite.replace_properties(quads, status.withColumn("o", F.lit(_FINISHED)), [iri("cogs:Job")])


@register(
    "created_on",
    f"select harvester, g, s from {{q_run}} where p = '{iri('dct:modified')}' and o like '2024-01-15%'",
)
def _(p):
    modified = p["q_run"].filter(F.col("p") == iri("dct:modified"))
    return modified.filter(times.created_on(F.col("o"), date(2024, 1, 15))).select("harvester", "g", "s")


# --- stored changes ------------------------------------------------------------------------------------


def _changes(p: Projection, *parts: str) -> str:
    """A change store with these quads."""
    path = new_folder(p.spark, "changes")
    changes.write_harvest(p.quads(*parts), path)
    return path


def _distinct_quads(*parts: str) -> str:
    return f"select distinct {QUAD_COLUMNS} from ({_quads_sql(*parts)})"


_DELETED_TWICE = (
    f"select {QUAD_COLUMNS} from ({_distinct_quads('q_item', 'q_handling', 'q_run')}) q where not exists (select 1 from ({_UNTYPED_ITEMS}) d"
    " where d.harvester = q.harvester and d.g = q.g and (d.s = q.s or d.s = q.o)) and not exists"
    f" (select 1 from ({_DOOMED}) d where d.harvester = q.harvester and d.g = q.g and d.s = q.s)"
)


def _delete_both(p: Projection) -> str:
    path = _changes(p, "q_item", "q_handling", "q_run")
    changes.delete_subjects(p.spark, path, graph.with_any_value(p["q_item"], iri("dct:description"), []), inbound=True)
    changes.delete_subjects(p.spark, path, graph.with_any_value(p["q_run"], iri("adms:status"), [RUN_FAILED]))
    return path


@register("delete_stored", _DELETED_TWICE)
def _(p):
    """Two deletions, one with the quads that point at the subjects."""
    return changes.load(p.spark, _delete_both(p))


@register("compact_stored", _DELETED_TWICE)
def _(p):
    """The same after its folders were written anew and older files removed."""
    path = _delete_both(p)
    changes.compact(p.spark, path, share=0.1)
    changes.vacuum(p.spark, path)
    return changes.load(p.spark, path)


@register(
    "replace_stored",
    f"""select harvester, g, s, p, case when p = '{iri('adms:status')}' and o = '{RUN_SUCCESS}' then '{_FINISHED}'
               when p = '{iri('adms:status')}' and o = '{RUN_FAILED}' then '{_FINISHED}/badly' else o end as o,
               o_kind, o_datatype, o_lang from ({_distinct_quads('q_run')})""",
)
def _(p):
    """Two replacements, the second of values that the first has left."""
    path = _changes(p, "q_run")
    for old, new in ((RUN_SUCCESS, _FINISHED), (RUN_FAILED, f"{_FINISHED}/badly")):
        status = changes.load(p.spark, path, predicates=[iri("adms:status")]).filter(F.col("o") == old)
        changes.replace_properties(p.spark, path, status.withColumn("o", F.lit(new)), [iri("cogs:Job")])
    return changes.load(p.spark, path)


@register("in_graph_stored", f"select * from ({_distinct_quads('q_run', 'q_unit', 'q_item')}) where g = '{JOB_GRAPH}'")
def _(p):
    return changes.in_graph(p.spark, _changes(p, "q_run", "q_unit", "q_item"), JOB_GRAPH)


@register(
    "add_stored",
    f"select harvester, p, count(*) as n from ({_distinct_quads('q_run', 'q_item')}) where harvester <> '{_FIRST}' or p <> '{iri('dct:title')}' group by all"
    f" union all select harvester, p, count(*) as n from ({_distinct_quads('q_item')}) where harvester = '{_FIRST}' and p = '{iri('dct:title')}' group by all",
)
def _(p):
    """Quads of items added to those of runs, twice; then one harvester is harvested anew without the titles of its runs."""
    path = _changes(p, "q_run")
    for _turn in range(2):
        changes.add(p.spark, path, p["q_item"])
    again = p.quads("q_run", "q_item").filter(F.col("harvester") == _FIRST)
    titles = (F.col("p") == iri("dct:title")) & (F.col("g") == JOB_GRAPH)
    changes.write_harvest(again.filter(~titles), path)
    return changes.load(p.spark, path).groupBy("harvester", "p").agg(F.count(F.lit(1)).alias("n"))


# --- reports -----------------------------------------------------------------------------------------


@register("governing_body_count_report", "select * from {body_count_row}")
def _(p):
    return reports.governing_body_count_report(nightly(p))


@register("publication_count_report", "select * from {metric_row}")
def _(p):
    return reports.publication_count_report(nightly(p))


@register("admin_unit_count_report", "select * from {unit_count_row}")
def _(p):
    report = reports.admin_unit_count_report(nightly(p))
    return report.withColumn("governing_body_reports", F.concat_ws(",", "governing_body_reports"))


@register("decision_report", "select * from {decision_row}")
def _(p):
    return reports.decision_report(nightly(p))


@register("maturity_report", "select * from {maturity_row}")
def _(p):
    return reports.maturity_report(nightly(p))


@register("session_timestamp_report", "select * from {session_row}")
def _(p):
    return reports.session_timestamp_report(nightly(p))


@register("last_harvest_report", f"select *, concat('{RESOURCE_BASE}', record_uuid) as record_uri from {{harvest_row}}")
def _(p):
    return reports.last_harvest_report(nightly(p))


@register(
    "last_harvest_record",
    f"select concat('{RESOURCE_BASE}', record_uuid) as record_uri, record_uuid as uuid, report_uri, day, graph, harvester, unit_uri,"
    " record_label as label, last_execution_time, status from {harvest_row}",
)
def _(p):
    return reports.last_harvest_record(nightly(p))


def _dm(name: str) -> str:
    return iri(f"monitoring:{name}")


def _property(p: str, o: str, datatype: str | None, source: str, s: str = "report_uri") -> str:
    kind = "literal" if datatype else "iri"
    dt = f"'{iri(datatype)}'" if datatype else _NULL_V
    return (
        f"select harvester, graph as g, {s} as s, '{p}' as p, {o} as o, '{kind}' as o_kind, {dt} as o_datatype,"
        f" {_NULL_V} as o_lang from {{{source}}}"
    )


@register(
    "reports_to_quads",
    " union all ".join(
        [
            _property(RDF_TYPE, f"'{_dm('DecisionReport')}'", None, "decision_row"),
            _property(_dm("createdAt"), "'2024-03-31T03:30:00+02:00'", "xsd:dateTime", "decision_row"),
            _property(_dm("day"), "'2024-03-31'", "xsd:date", "decision_row"),
            _property(iri("skos:prefLabel"), "label", "xsd:string", "decision_row"),
            _property(iri("mu:uuid"), "uuid", "xsd:string", "decision_row"),
            _property(_dm("targetAdministrativeUnit"), "unit_uri", None, "decision_row"),
            _property(_dm("classLabel"), "class_label", "xsd:string", "decision_row"),
            _property(_dm("count"), "cast(count as varchar)", "xsd:integer", "decision_row"),
            _property(RDF_TYPE, f"'{_dm('PublicationCountReport')}'", None, "metric_row", "count_uri"),
            _property(_dm("publicationCountReports"), "count_uri", None, "metric_row"),
            _property(iri("mu:uuid"), "uuid", "xsd:string", "metric_row", "count_uri"),
            _property(_dm("targetClass"), "target_class", None, "metric_row", "count_uri"),
            _property(iri("skos:prefLabel"), "label", "xsd:string", "metric_row", "count_uri"),
            _property(_dm("count"), "cast(count as varchar)", "xsd:integer", "metric_row", "count_uri"),
        ]
    ),
)
def _(p):
    run = nightly(p)
    return reports.quads_of(
        {
            "decision_report": reports.decision_report(run),
            "publication_count_report": reports.publication_count_report(run),
        }
    )


_DECISION_QUADS = [
    _property(RDF_TYPE, f"'{_dm('DecisionReport')}'", None, "decision_row"),
    _property(_dm("createdAt"), "'2024-03-31T03:30:00+02:00'", "xsd:dateTime", "decision_row"),
    _property(_dm("day"), "'2024-03-31'", "xsd:date", "decision_row"),
    _property(iri("skos:prefLabel"), "label", "xsd:string", "decision_row"),
    _property(iri("mu:uuid"), "uuid", "xsd:string", "decision_row"),
    _property(_dm("targetAdministrativeUnit"), "unit_uri", None, "decision_row"),
    _property(_dm("classLabel"), "class_label", "xsd:string", "decision_row"),
    _property(_dm("count"), "cast(count as varchar)", "xsd:integer", "decision_row"),
]


@register("publish_reports", " union all ".join([_quads_sql("q_unit"), *_DECISION_QUADS]))
def _(p):
    """Publishing a day's reports a second time replaces those of the first."""
    run = nightly(p)
    tables = {"decision_report": stored(reports.decision_report(run))}
    first = stored(reports.publish_reports(p["q_unit"], tables, run))
    return reports.publish_reports(first, tables, run)


def _local(column: str) -> str:
    """A local wall-clock time as an xsd:dateTime."""
    offset = f"date_diff('hour', timezone('UTC', timezone('Europe/Brussels', {column})), {column})"
    return f"concat(strftime({column}, '%Y-%m-%dT%H:%M:%S'), '+0', cast({offset} as varchar), ':00')"


def _report_sql(cls: str, source: str, *properties: tuple[str, str, str | None], s: str = "report_uri", stamped: bool = True) -> list[str]:
    common = [
        (_dm("createdAt"), "'2024-03-31T03:30:00+02:00'", "xsd:dateTime"),
        (_dm("day"), "'2024-03-31'", "xsd:date"),
    ]
    named = [(iri("skos:prefLabel"), "label", "xsd:string"), (iri("mu:uuid"), "uuid", "xsd:string")]
    every = [(RDF_TYPE, f"'{_dm(cls)}'", None), *(common if stamped else []), *named, *properties]
    return [_property(p, o, datatype, source, s) + f" where {o} is not null and {o} <> ''" for p, o, datatype in every]


_UNIT_LINK = (_dm("targetAdministrativeUnit"), "unit_uri", None)
_ALL_REPORTS = [
    *_report_sql("GoverningBodyCountReport", "body_count_row", _UNIT_LINK, (_dm("classLabel"), "class_label", "xsd:string")),
    *_report_sql("PublicationCountReport", "metric_row", (_dm("targetClass"), "target_class", None), (_dm("count"), "cast(count as varchar)", "xsd:integer"),
                 s="count_uri", stamped=False),
    _property(_dm("publicationCountReports"), "count_uri", None, "metric_row"),
    *_report_sql("AdminUnitCountReport", "unit_count_row", _UNIT_LINK, (_dm("governingBodyReports"), "governing_body_reports", None),
                 (_dm("istest"), "'true'", "xsd:boolean")),
    *_report_sql("DecisionReport", "decision_row", _UNIT_LINK, (_dm("classLabel"), "class_label", "xsd:string"),
                 (_dm("count"), "cast(count as varchar)", "xsd:integer")),
    *_report_sql("MaturityLevelReport", "maturity_row", (_dm("notuleUri"), "notule_uri", "xsd:string")),
    *_report_sql("SessionTimestampReport", "session_row", (_dm("firstSession"), _local("first_session"), "xsd:dateTime"),
                 (_dm("lastSession"), _local("last_session"), "xsd:dateTime")),
    *_report_sql("LastHarvestingExecutionReport", "harvest_row"),
    *[q.replace("{harvest_row}", "(select * exclude (label, uuid), record_label as label, record_uuid as uuid from {harvest_row})")
      for q in _report_sql("LastHarvestingExecutionRecord", "harvest_row", _UNIT_LINK, (_dm("lastExecutionTime"), _local("last_execution_time"), "xsd:dateTime"),
                           (_dm("status"), "status", None), s=f"concat('{RESOURCE_BASE}', record_uuid)", stamped=False)],
    _property(_dm("adminUnitLastExecutionRecords"), f"concat('{RESOURCE_BASE}', record_uuid)", None, "harvest_row"),
]


@register("publish_all_reports", " union all ".join([f"select distinct {QUAD_COLUMNS} from {{q_unit}}", *_ALL_REPORTS]))
def _(p):
    """All reports of a day in the change store, published twice: the second takes the place of the first."""
    run, path = nightly(p), new_folder(p.spark, "changes")
    changes.write_harvest(p["q_unit"], path)
    tables = {}
    for key in reports.REPORTS:
        tables |= reports.run_report(key, run)
    tables = {name: stored(df) for name, df in tables.items() if name in report_quads.RESOURCES}
    for _turn in range(2):
        reports.publish_all(p.spark, path, tables, run)
    return changes.load(p.spark, path)


_REPORT_ROWS = {
    "governing_body_count_report": "body_count_row", "publication_count_report": "metric_row", "admin_unit_count_report": "unit_count_row",
    "decision_report": "decision_row", "maturity_report": "maturity_row", "session_timestamp_report": "session_row", "last_harvest_report": "harvest_row",
}


@register(
    "run_reports",
    " union all ".join(
        f"select '{name}' as report, {'count_uri' if step == 'metric_row' else 'report_uri'} as uri, uuid, label, graph, harvester, unit_uri,"
        f" {'count' if step in ('metric_row', 'decision_row') else 'null'} as n,"
        f" {'epoch_us(first_session)' if step == 'session_row' else 'null'} as first_session,"
        f" {'notule_uri' if step == 'maturity_row' else _NULL_V} as notule_uri from {{{step}}}"
        for name, step in _REPORT_ROWS.items()
    ),
)
def _(p):
    """All reports of a run, from one stored prefix."""
    tables = reports.run_reports(nightly(p))
    none = lambda df, c, value: value if c in df.columns else F.lit(None)
    rows = [
        df.select(
            F.lit(name).alias("report"),
            F.col("count_uri" if "count_uri" in df.columns else "report_uri").alias("uri"),
            "uuid", "label", "graph", "harvester", "unit_uri",
            none(df, "count", F.col("count")).cast("long").alias("n"),
            none(df, "first_session", F.unix_micros(F.col("first_session").cast("timestamp"))).cast("long").alias("first_session"),
            none(df, "notule_uri", F.col("notule_uri")).cast("string").alias("notule_uri"),
        )
        for name, df in tables.items() if name in _REPORT_ROWS
    ]
    return reduce(DataFrame.unionByName, rows)


@register("prefix_metrics", f"select {_UNIT}, metric, n from {{reported_metric}}")
def _(p):
    """The seven metrics from tables in buckets by item."""
    return nightly(p).prepared(new_folder(p.spark, "prefix"), 8).metrics()


@register("run_report", "select * from {decision_row}")
def _(p):
    """The stored table after a report was run twice."""
    run, path = nightly(p), new_folder(p.spark, "reports")
    for _turn in range(2):
        columns = reports.run_report("DECISION_REPORT_DAILY", run, path)["decision_report"].columns
    return p.spark.read.parquet(f"{path}/decision_report").select(columns)


@register("load_dimension", "select harvester, unit_uri, unit_id, label, classification from {unit}")
def _(p):
    """The day's snapshot, built by the first call and loaded by the second."""
    path = new_folder(p.spark, "dimension")
    for _turn in range(2):
        tables = store.dimension_of_day(p.spark, path, DAY, lambda: dict(zip(store.DIMENSION, dimension(p), strict=True)))
    return tables["unit"]


# --- scalar functions --------------------------------------------------------------------------------

_DECOMPOSED = [
    (c, unicodedata.normalize("NFD", c))
    for c in map(chr, range(0xDF, 0x180))
    if unicodedata.normalize("NFD", c) != c and c.lower() == c
]


def _nfd_sql(expr: str) -> str:
    for composed, parts in _DECOMPOSED:
        expr = f"replace({expr}, '{composed}', '{parts}')"
    return expr


@register("norm_label", f"select doc_id, md5({_nfd_sql('lower(' + _trim('text') + ')')}) as digest from {{documents}}")
def _(p):
    return p["documents"].select("doc_id", F.md5(texts.norm_label(F.col("text"))).alias("digest"))


@register(
    "strip_once_lower",
    f"select event_id, {_strip_once('raw')} as name from (select event_id, concat(case when value < 10 then ' ' else '' end,"
    " upper(event_type), case when value > 5 then chr(160) else '' end) as raw from {events})",
)
def _(p):
    raw = F.concat(
        F.when(F.col("value") < 10, " ").otherwise(""),
        F.upper("event_type"),
        F.when(F.col("value") > 5, " ").otherwise(""),
    )
    return p["events"].select("event_id", texts.strip_once_lower(raw).alias("name"))


@register(
    "label_parts",
    "select unit_uri, string_split(label, ',')[1] as head, unnest(string_split(label, ',')) as part from {admin_unit}",
)
def _(p):
    unit = units.clean_units(p["unit_property"])
    return unit.select(
        "unit_uri",
        texts.label_head(F.col("label")).alias("head"),
        F.explode(texts.label_parts(F.col("label"))).alias("part"),
    )


@register(
    "escape_literal",
    r"""select doc_id, md5(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(9), '\t'),
        chr(13), '\r'), chr(12), '\f'), '"', '\"'), '''', '\''')) as escaped, md5(text) as restored from {documents}""",
)
def _(p):
    escaped = texts.escape_literal(F.col("text"))
    return p["documents"].select(
        "doc_id", F.md5(escaped).alias("escaped"), F.md5(texts.unescape_literal(escaped)).alias("restored")
    )


@register(
    "to_literal",
    f"""select o_orderkey, concat('"', strftime(o_orderdate, '%Y-%m-%d'), '"^^<{iri('xsd:date')}>') as day,
               concat('"', regexp_replace(cast(o_totalprice as varchar), '\\.0$', ''), '"^^<{iri('xsd:double')}>') as price,
               concat('"', cast(o_custkey as varchar), '"^^<{iri('xsd:integer')}>') as customer,
               concat('"', case when o_orderstatus = 'F' then 'true' else 'false' end, '"^^<{iri('xsd:boolean')}>') as final,
               concat('"', o_orderpriority, '"') as priority,
               concat('"', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), '+0',
                      cast(date_diff('hour', timezone('UTC', timezone('Europe/Brussels', o_orderdate)), o_orderdate) as varchar),
                      ':00"^^<{iri('xsd:dateTime')}>') as at
        from {{orders}}""",
)
def _(p):
    c = F.col
    return p["orders"].select(
        "o_orderkey",
        terms.to_literal(c("o_orderdate"), terms.XSD_DATE).alias("day"),
        terms.to_literal(c("o_totalprice"), terms.XSD_DOUBLE).alias("price"),
        terms.to_literal(c("o_custkey"), terms.XSD_INTEGER).alias("customer"),
        terms.to_literal(c("o_orderstatus") == "F", terms.XSD_BOOLEAN).alias("final"),
        terms.to_literal(c("o_orderpriority")).alias("priority"),
        terms.to_literal(c("o_orderdate"), terms.XSD_DATETIME).alias("at"),
    )


_URL_FORMS = ("url", "replace(url, '://', '://user@')", "regexp_replace(url, '^(https?://[^/]+)', '\\1:8080')", "split_part(url, '?', 1)", "concat('no uri ', url)")


@register(
    "is_plain_uri",
    " union all ".join(
        f"select page_id, {i} as form, regexp_matches({e}, '^https?://[^/?#@:]+(/[^?#]*)?(\\?)?(#.*)?$') as plain,"
        f" case when regexp_matches({e}, '^https?://[^/?#@:]+(/[^?#]*)?(\\?)?(#.*)?$') then concat('<', {e}, '>') end as node from {{pages}}"
        for i, e in enumerate(_URL_FORMS)
    ),
)
def _(p):
    url = F.col("url")
    forms = F.array(
        url,
        F.replace(url, F.lit("://"), F.lit("://user@")),
        F.regexp_replace(url, "^(https?://[^/]+)", "$1:8080"),
        F.split(url, r"\?", 2)[0],
        F.concat(F.lit("no uri "), url),
    )
    rows = p["pages"].select("page_id", F.posexplode(forms).alias("form", "u"))
    return rows.select(
        "page_id", "form", uris.is_plain_uri(F.col("u")).alias("plain"), uris.to_node(F.col("u")).alias("node")
    )


@register(
    "expand_uri",
    f"""select doc_id, case lang when 'en' then concat('{iri('skos:')}', 'note-', doc_id) when 'fr' then concat('http://example.org/notes/', 'note-', doc_id)
               when 'de' then null else concat('http://example.org/', lang, '/', doc_id) end as uri from {{documents}}""",
)
def _(p):
    lang, local = F.col("lang"), F.concat(F.lit("note-"), F.col("doc_id"))
    short = (
        F.when(lang == "en", F.concat(F.lit("skos:"), local))
        .when(lang == "fr", F.concat(F.lit("notes:"), local))
        .when(lang == "de", F.concat(F.lit("nowhere:"), local))
        .otherwise(F.concat(F.lit("http://example.org/"), lang, F.lit("/"), F.col("doc_id")))
    )
    return p["documents"].select("doc_id", uris.expand_uri(short, PREFIXES | {"notes": "http://example.org/notes/"}).alias("uri"))


_DAYS = {name: i for i, name in enumerate(["SUNDAY", "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY"])}


@register(
    "enum_key",
    "select event_id, case when event_type = 'view' then null else upper(strftime(ts, '%A')) end as key,"
    " concat('" + iri("time:") + "', strftime(ts, '%A')) as uri, cast(dayofweek(ts) as integer) as day from {events}",
)
def _(p):
    name = F.date_format("ts", "EEEE")
    uri_text = F.concat(F.lit(iri("time:")), F.when(F.col("event_type") == "view", "Someday").otherwise(name))
    return p["events"].select(
        "event_id",
        uris.enum_key(uri_text, DAY_OF_WEEK).alias("key"),
        uris.enum_uri(name, DAY_OF_WEEK).alias("uri"),
        times.day_of_week(F.col("ts")).alias("day"),
    )


@register(
    "parse_date",
    "select o_orderkey, case when o_orderstatus = 'P' then null else cast(o_orderdate as date) end as day from {orders}",
)
def _(p):
    d = F.col("o_orderdate")
    sep = F.when(F.col("o_orderstatus") == "P", "/").otherwise("-")
    return p["orders"].select(
        "o_orderkey", times.parse_date(F.concat(F.year(d), sep, F.month(d), sep, F.dayofmonth(d))).alias("day")
    )


_SECONDS = "(hour(ts) * 3600 + minute(ts) * 60)"


@register(
    "parse_time",
    f"""select event_id, cast(case event_type when 'view' then null when 'click' then {_SECONDS} * 1000
                 when 'signup' then ({_SECONDS} + second(ts) % 60) * 1000
                 else ({_SECONDS} + second(ts) % 60) * 1000 + 70 end as integer) as ms_of_day,
               cast(case event_type when 'view' then null when 'click' then 60 when 'signup' then -210 when 'error' then 60 else 330 end as integer) as offset_min,
               case event_type when 'signup' then concat(strftime(ts, '%H:%M:%S'), '.000-03:30') when 'purchase' then concat(strftime(ts, '%H:%M:%S'), '.070+05:30') end as written
        from {{events}}""",
)
def _(p):
    ts, kind = F.col("ts"), F.col("event_type")
    short = F.concat(F.hour(ts), F.lit(":"), F.minute(ts))
    full = F.concat(short, F.lit(":"), F.extract(F.lit("SECOND"), ts).cast("int"))
    raw = (
        F.when(kind == "click", short)
        .when(kind == "signup", F.concat(full, F.lit("-03:30")))
        .when(kind == "error", F.concat(full, F.lit(".07")))
        .when(kind == "purchase", F.concat(full, F.lit(".07+5:30")))
        .otherwise("noon")
    )
    parsed = p["events"].select("event_id", "event_type", times.parse_time(raw).alias("t")).select(
        "event_id", "event_type", "t.*"
    )
    written = times.format_time(F.col("ms_of_day"), F.col("offset_min"))
    return parsed.select(
        "event_id",
        "ms_of_day",
        "offset_min",
        F.when(F.col("event_type").isin("signup", "purchase"), written).alias("written"),
    )


@register(
    "make_local_ts",
    """select o_orderkey, epoch_us(timezone('Europe/Brussels', o_orderdate + interval 43200 second)) as instant,
              o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01' as in_year from {orders}""",
)
def _(p):
    d = F.col("o_orderdate")
    wall = lambda text: F.lit(text).cast("timestamp_ntz")
    return p["orders"].select(
        "o_orderkey",
        F.unix_micros(times.make_local_ts(d, F.lit(43200000))).alias("instant"),
        times.in_half_open(d, wall("1998-01-01"), wall("1999-01-01")).alias("in_year"),
    )


@register(
    "report_labels",
    f"""select unit_uri, case when classification = '{MUNICIPALITY}' then 'gemeente' else 'provincie' end as kind,
               concat('{REPORT_GRAPH_BASE}', unit_id, '{REPORT_GRAPH_SUFFIX}') as graph,
               concat('Count report for admin unit ''', label, ''' on 2024-03-31') as label from {{admin_unit}}""",
)
def _(p):
    unit = units.clean_units(p["unit_property"])
    return unit.select(
        "unit_uri",
        labels.unit_kind(F.col("classification")).alias("kind"),
        labels.report_graph(F.col("unit_id")).alias("graph"),
        labels.unit_report_label(F.col("label"), F.lit(DAY)).alias("label"),
    )


@register(
    "stable_id",
    f"select l_orderkey, l_linenumber, {_uuid('cast(l_orderkey as varchar)', 'cast(l_linenumber as varchar)')} as uuid, true as well_formed,"
    " false as short_form from {lineitem}",
)
def _(p):
    uuid = uris.stable_id(F.col("l_orderkey"), F.col("l_linenumber"))
    return p["lineitem"].select(
        "l_orderkey",
        "l_linenumber",
        uuid.alias("uuid"),
        uris.is_uuid(uuid).alias("well_formed"),
        uris.is_uuid(F.substring(uuid, 1, 30)).alias("short_form"),
    )


@register(
    "parameterised_query",
    "select harvester, count(*) as n from {session} where planned_start >= timestamp '1998-01-01' group by harvester",
)
def _(p):
    return parameterised(
        p.spark,
        "select harvester, count(*) as n from {session} where planned_start >= cast(:since as timestamp_ntz) group by harvester",
        {"session": p["session"]},
        since="1998-01-01",
    )
