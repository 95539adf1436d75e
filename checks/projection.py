"""The supplied relational tables read as published linked data.

Each entry is portable SQL that Spark and DuckDB run alike: Spark builds the inputs of the library
from it, the oracle queries inline it. ``{name}`` refers to a supplied table or another entry.

Units are customers, two consecutive ones sharing a label. Bodies are the priorities a customer
orders with, sessions are orders, agenda items are order lines, harvest runs are events. Keys are
spread over four harvesters by number, as one publisher's data is over several endpoints.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from graphreports.vocabulary import (
    MUNICIPALITY,
    ORGANISATION_GRAPH,
    PROVINCE,
    REPEAT_FREQUENCY,
    RUN_FAILED,
    RUN_SUCCESS,
    WELFARE_CENTRE,
    iri,
)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

BASE = "http://data.example.org/id/"
STRING = iri("xsd:string")


def text(expr: str) -> str:
    return f"cast({expr} as varchar(40))"


def uri(kind: str, *parts: str) -> str:
    inner = ", '/', ".join(parts)
    return f"concat('{BASE}{kind}/', {inner})"


def harvester(key: str) -> str:
    return f"concat('https://harvester-', {text(key + ' % 4')}, '.example.org/sparql')"


def body(customer: str, priority: str) -> str:
    return uri("body", text(customer), f"substring({priority}, 1, 1)")


# Composed and decomposed spelling of the same word, which must count as one label.
WORD = "case when c_acctbal > 5000 then 'Unit\u00e9 ' else 'Unite\u0301 ' end"
UNIT_LABEL = f"concat({WORD}, {text('cast(floor(c_custkey / 2) as bigint)')})"
CLASSIFICATION = (
    f"case when c_mktsegment = 'HOUSEHOLD' then '{PROVINCE}' "
    f"when c_acctbal >= 4000 then '{MUNICIPALITY}' else '{WELFARE_CENTRE}' end"
)
LINE = f"concat({text('l_orderkey')}, '-', {text('l_linenumber')})"
LINE_H = harvester("l_orderkey")
ITEM = uri("item", LINE)
HANDLING = uri("handling", LINE)
SESSION = uri("session", text("o_orderkey"))
RESOLUTION = uri("resolution", text("l_orderkey"), "l_linestatus")
TITLE_LANG = "case when p_type = 'PROMO' then 'fr' when p_type = 'SMALL' then 'nl' end"

PROJECTION = {
    # Organisations. One row per combination of values: machinery units have two labels.
    "unit_property": f"""
        select {uri('unit', text('c_custkey'))} as unit_uri, concat('u', {text('c_custkey')}) as unit_id,
               {UNIT_LABEL} as label, {CLASSIFICATION} as classification
        from {{customer}}
        union all
        select {uri('unit', text('c_custkey'))}, concat('u', {text('c_custkey')}),
               concat('Alias ', {text('c_custkey')}), {CLASSIFICATION}
        from {{customer}} where c_mktsegment = 'MACHINERY'
    """,
    "body_pair": f"""
        select distinct {uri('unit', text('o_custkey'))} as unit_uri,
               concat({body('o_custkey', 'o_orderpriority')}, '/abstract') as body_uri,
               {body('o_custkey', 'o_orderpriority')} as specific_uri, o_orderpriority as class_label
        from {{orders}}
    """,
    "unit_body": """
        select unit_uri, body_uri, class_label, 'abstract' as kind from {body_pair}
        union all
        select unit_uri, specific_uri, class_label, 'time-specific' from {body_pair}
    """,
    "harvest_title": f"""
        select distinct {harvester('o_orderkey')} as harvester, upper({UNIT_LABEL}) as title
        from {{orders}} join {{customer}} on c_custkey = o_custkey where c_acctbal >= 0
    """,
    # Facts. Order lines repeat, so the tables below hold some rows several times.
    "session": f"""
        select {harvester('o_orderkey')} as harvester, {SESSION} as session_uri,
               {body('o_custkey', 'o_orderpriority')} as held_by,
               case when o_totalprice < 25000 then null else o_orderdate end as planned_start
        from {{orders}}
        union all
        select {harvester('o_orderkey')}, {SESSION}, {uri('body', text('o_custkey'), "'2'")},
               case when o_totalprice < 25000 then null else o_orderdate end
        from {{orders}} where o_orderpriority = '1-URGENT'
    """,
    "session_item": f"""
        select {LINE_H} as harvester, {uri('session', text('l_orderkey'))} as session_uri, {ITEM} as item_uri
        from {{lineitem}}
    """,
    "item": f"""
        select {LINE_H} as harvester, {ITEM} as item_uri from {{lineitem}} where l_tax < 0.08
    """,
    "item_title": f"""
        select {LINE_H} as harvester, {ITEM} as item_uri, p_name as title,
               case when {TITLE_LANG} is null then '{STRING}' else '{iri('rdf:langString')}' end as title_datatype,
               {TITLE_LANG} as title_lang
        from {{lineitem}} join {{part}} on p_partkey = l_partkey where l_returnflag <> 'N'
    """,
    "item_description": f"""
        select {LINE_H} as harvester, {ITEM} as item_uri, concat('Flag ', l_returnflag) as description
        from {{lineitem}} where l_linestatus = 'F'
    """,
    "item_doc": f"""
        select {LINE_H} as harvester, {ITEM} as item_uri, {uri('doc', text('l_suppkey'))} as doc_uri
        from {{lineitem}}
    """,
    "handling_subject": f"""
        select {LINE_H} as harvester, {HANDLING} as handling_uri, {ITEM} as item_uri from {{lineitem}}
    """,
    "handling_resolution": f"""
        select {LINE_H} as harvester, {HANDLING} as handling_uri, {RESOLUTION} as resolution_uri
        from {{lineitem}} where l_returnflag = 'R'
    """,
    "handling_vote": f"""
        select {LINE_H} as harvester, {HANDLING} as handling_uri,
               {uri('vote', text('l_orderkey'), text('l_suppkey'))} as vote_uri
        from {{lineitem}} where l_quantity > 40
    """,
    "resolution": f"""
        select {LINE_H} as harvester, {RESOLUTION} as resolution_uri
        from {{lineitem}} where l_returnflag = 'R' and l_quantity <= 30
    """,
    "publication": f"""
        select {harvester('o_orderkey')} as harvester, {SESSION} as session_uri, 'notulen' as kind,
               {uri('minutes', text('o_orderkey'))} as url
        from {{orders}} where o_orderstatus <> 'P'
        union all
        select {harvester('o_orderkey')}, {SESSION}, 'besluitenlijst', {uri('list', text('o_orderkey'))}
        from {{orders}} where o_orderpriority in ('1-URGENT', '2-HIGH')
        union all
        select {harvester('o_orderkey')}, {SESSION}, 'uittreksel', {uri('extract', text('o_orderkey'))}
        from {{orders}} where o_orderpriority = '5-LOW'
    """,
    "publication_source": """
        select harvester, url, concat(url, '/source') as derived_from
        from {publication} join {orders} on session_uri = """
    + SESSION
    + """ where o_totalprice > 100000
    """,
    "harvest_run": f"""
        select {harvester('user_id')} as harvester, {uri('job', text('user_id'))} as scheduled_job,
               concat(case when value < 10 then ' ' else '' end, 'Unit\u00e9 ', {text('user_id')},
                      case when value > 20 then ' ' else '' end) as title,
               case event_type when 'purchase' then '{RUN_SUCCESS}' when 'error' then '{RUN_FAILED}'
                    else concat('{BASE}status/', event_type) end as status,
               ts as modified
        from {{events}}
    """,
}


def _quad(h: str, s: str, p: str, o: str, source: str, kind: str = "iri", datatype: str | None = None,
          lang: str = "cast(null as varchar(10))", graph: str = "http://mu.semte.ch/graphs/public",
          where: str = "") -> str:
    dt = f"cast({datatype} as varchar(80))" if datatype else "cast(null as varchar(80))"
    return (
        f"select {h} as harvester, '{graph}' as g, {s} as s, '{iri(p) if '://' not in p else p}' as p, {o} as o, "
        f"'{kind}' as o_kind, {dt} as o_datatype, {lang} as o_lang from {{{source}}} {where}"
    )


def _typed(source: str, s: str, cls: str, h: str = "harvester", graph: str = "http://mu.semte.ch/graphs/public", where: str = "") -> str:
    return _quad(h, s, "rdf:type", f"'{iri(cls)}'", f"{source}", graph=graph, where=where)


def _literal(dt: str = STRING) -> dict:
    return {"kind": "literal", "datatype": f"'{dt}'"}


STAMP = "concat(replace(cast({} as varchar(40)), ' ', 'T'), 'Z')"
ORG = "'organisations'"
_RUN = uri("run", text("event_id"))
_CONCEPT = "concat('_:c', class_label)"
_CHAIN = {part: f"concat('{BASE}{part}/', harvester, '/', title)" for part in ("file", "set", "box", "task", "plan", "schedule")}

QUAD_PARTS = {
    "q_session": [
        _typed("session", "session_uri", "besluit:Zitting"),
        _quad("harvester", "session_uri", "besluit:isGehoudenDoor", "held_by", "session"),
        _quad("harvester", "session_uri", "besluit:geplandeStart", STAMP.format("planned_start"), "session",
              where="where planned_start is not null", **_literal(iri("xsd:dateTime"))),
        _quad("harvester", "session_uri", "besluit:behandelt", "item_uri", "session_item"),
    ],
    "q_item": [
        _typed("item", "item_uri", "besluit:Agendapunt"),
        _quad("harvester", "item_uri", "dct:title", "title", "item_title", kind="literal",
              datatype="title_datatype", lang="title_lang"),
        _quad("harvester", "item_uri", "dct:description", "description", "item_description", **_literal()),
        _quad("harvester", "item_uri", "prov:wasDerivedFrom", "doc_uri", "item_doc"),
    ],
    "q_handling": [
        _typed("handling_subject", "handling_uri", "besluit:BehandelingVanAgendapunt"),
        _quad("harvester", "handling_uri", "dct:subject", "item_uri", "handling_subject"),
        _quad("harvester", "handling_uri", "prov:generated", "resolution_uri", "handling_resolution"),
        _quad("harvester", "handling_uri", "besluit:heeftStemming", "vote_uri", "handling_vote"),
        _typed("resolution", "resolution_uri", "besluit:Besluit"),
    ],
    "q_publication": [
        _quad("harvester", "session_uri", "besluit:heeftNotulen", "url", "publication", where="where kind = 'notulen'"),
        _quad("harvester", "session_uri", "besluit:heeftBesluitenlijst", "url", "publication", where="where kind = 'besluitenlijst'"),
        _quad("harvester", "session_uri", "besluit:heeftUittreksel", "url", "publication", where="where kind = 'uittreksel'"),
        _quad("harvester", "url", "prov:wasDerivedFrom", "derived_from", "publication_source"),
    ],
    "q_run": [
        _typed("events", _RUN, "cogs:Job", h=harvester("user_id"), graph="http://mu.semte.ch/graphs/job"),
        _quad(harvester("user_id"), _RUN, "dct:creator", uri("job", text("user_id")), "events", graph="http://mu.semte.ch/graphs/job"),
        _quad(harvester("user_id"), _RUN, "adms:status",
              f"case event_type when 'purchase' then '{RUN_SUCCESS}' when 'error' then '{RUN_FAILED}' else concat('{BASE}status/', event_type) end",
              "events", graph="http://mu.semte.ch/graphs/job"),
        _quad(harvester("user_id"), _RUN, "dct:modified", STAMP.format("ts"), "events",
              graph="http://mu.semte.ch/graphs/job", **_literal(iri("xsd:dateTime"))),
        _typed("events", uri("job", text("user_id")), "cogs:ScheduledJob", h=harvester("user_id"), graph="http://mu.semte.ch/graphs/job"),
        _quad("harvester", "scheduled_job", "dct:title", "title", "harvest_run", graph="http://mu.semte.ch/graphs/job", **_literal()),
    ],
    "q_harvest": [
        _typed("harvest_title", _CHAIN["file"], "nfo:RemoteDataObject"),
        _quad("harvester", _CHAIN["file"], "nie:url", "title", "harvest_title", **_literal()),
        _quad("harvester", _CHAIN["set"], "dct:hasPart", _CHAIN["file"], "harvest_title"),
        _quad("harvester", _CHAIN["box"], "task:hasHarvestingCollection", _CHAIN["set"], "harvest_title"),
        _quad("harvester", _CHAIN["task"], "task:inputContainer", _CHAIN["box"], "harvest_title"),
        _typed("harvest_title", _CHAIN["task"], "task:ScheduledTask"),
        _quad("harvester", _CHAIN["task"], "dct:isPartOf", _CHAIN["plan"], "harvest_title"),
        _typed("harvest_title", _CHAIN["plan"], "cogs:ScheduledJob"),
        _quad("harvester", _CHAIN["plan"], "dct:title", "title", "harvest_title", **_literal()),
        _quad("harvester", _CHAIN["plan"], "task:schedule", _CHAIN["schedule"], "harvest_title"),
        _quad("harvester", _CHAIN["schedule"], REPEAT_FREQUENCY, "'0 3 * * *'", "harvest_title", **_literal()),
    ],
    "q_unit": [
        _typed("unit_property", "unit_uri", "besluit:Bestuurseenheid", h=ORG),
        _quad(ORG, "unit_uri", "mu:uuid", "unit_id", "unit_property", **_literal()),
        _quad(ORG, "unit_uri", "skos:prefLabel", "label", "unit_property", **_literal()),
        _quad(ORG, "unit_uri", "org:classification", "classification", "unit_property"),
    ],
    "q_body": [
        _typed("body_pair", "body_uri", "besluit:Bestuursorgaan", h=ORG),
        _quad(ORG, "body_uri", "besluit:bestuurt", "unit_uri", "body_pair"),
        _quad(ORG, "body_uri", "org:classification", _CONCEPT, "body_pair", kind="bnode"),
        _typed("body_pair", _CONCEPT, "skos:Concept", h=ORG),
        _quad(ORG, _CONCEPT, "skos:prefLabel", "class_label", "body_pair", **_literal()),
        _quad(ORG, "specific_uri", "generiek:isTijdspecialisatieVan", "body_uri", "body_pair"),
    ],
}
# Whole document texts as language-tagged literals, and literals of the other datatypes.
_PART, _ORDER = uri("part", text("p_partkey")), uri("order", text("o_orderkey"))
_SHOP = "'https://harvester-0.example.org/sparql'"
QUAD_PARTS["q_document"] = [
    _quad(_SHOP, uri("document", text("doc_id")), "dct:description", "text", "documents",
          kind="literal", datatype=f"'{iri('rdf:langString')}'", lang="lang"),
]
QUAD_PARTS["q_typed"] = [
    _quad(_SHOP, _PART, "ext:size", text("p_size"), "part", **_literal(iri("xsd:integer"))),
    _quad(_SHOP, _PART, "ext:large", "case when p_size > 40 then '1' when p_size > 20 then 'true' else 'false' end",
          "part", **_literal(iri("xsd:boolean"))),
    _quad(_SHOP, _PART, "ext:brand", "p_brand", "part", **_literal()),
    _quad(_SHOP, _PART, "ext:broken", "p_type", "part", **_literal(iri("xsd:int"))),
    _quad(_SHOP, _PART, "ext:price", text("p_retailprice"), "part", **_literal(iri("xsd:double"))),
    _quad(_SHOP, _PART, "ext:exact", text("p_retailprice"), "part", **_literal(iri("xsd:decimal"))),
    _quad(_SHOP, _ORDER, "ext:day", "substring(cast(o_orderdate as varchar(40)), 1, 10)", "orders", **_literal(iri("xsd:date"))),
    _quad(_SHOP, _ORDER, "ext:at", STAMP.format("o_orderdate"), "orders", **_literal(iri("xsd:dateTime"))),
    _quad(_SHOP, _ORDER, "ext:node", "concat('_:n', o_orderstatus)", "orders", kind="bnode"),
    _quad(_SHOP, uri("event", text("event_id")), "ext:clock",
          "concat(substring(cast(ts as varchar(40)), 12, 8), '.250-05:30')", "events", **_literal(iri("xsd:time"))),
]
# Sessions whose starts are dates, have an offset without a colon, or can't be read.
_H = harvester("o_orderkey")
QUAD_PARTS["q_starts"] = [
    _typed("orders", SESSION, "besluit:Zitting", h=_H),
    _quad(_H, SESSION, "besluit:isGehoudenDoor", body("o_custkey", "o_orderpriority"), "orders"),
    _quad(_H, SESSION, "besluit:geplandeStart",
          "case o_orderstatus when 'F' then substring(cast(o_orderdate as varchar(40)), 1, 10) when 'P' then 'to be announced'"
          " else concat(replace(cast(o_orderdate as varchar(40)), ' ', 'T'), '+0200') end",
          "orders", where="where o_totalprice >= 25000", **_literal(iri("xsd:dateTime"))),
]
for _name, _selects in QUAD_PARTS.items():
    PROJECTION[_name] = " union all ".join(_selects)

QUAD_GROUPS = {
    "harvested": ("q_session", "q_item", "q_handling", "q_publication", "q_run", "q_harvest"),
    "organisations": ("q_unit", "q_body"),
}

_REFERENCE = re.compile(r"\{([a-z_]+)\}")


class Projection(Mapping):
    """Frames over one folder of supplied tables, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in PROJECTION:
                sql = PROJECTION[name]
                parts = {dep: self[dep] for dep in set(_REFERENCE.findall(sql))}
                self._frames[name] = self.spark.sql(sql, **parts)
            elif name in TABLES:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise KeyError(name)
        return self._frames[name]

    def __iter__(self):
        return iter([*TABLES, *PROJECTION])

    def __len__(self) -> int:
        return len(TABLES) + len(PROJECTION)

    def quads(self, *groups: str) -> DataFrame:
        """Quads of whole groups or of single parts."""
        parts = [p for g in groups for p in QUAD_GROUPS.get(g, (g,))]
        return reduce(DataFrame.unionByName, [self[p] for p in parts])


def with_projection(sql: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: ``sql`` with every ``{name}`` it needs inlined as a common table expression."""
    known = {**PROJECTION, **(extra or {})}
    ordered: list[str] = []

    def visit(body: str) -> None:
        for dep in _REFERENCE.findall(body):
            if dep in known and dep not in ordered:
                visit(known[dep])
                ordered.append(dep)

    visit(sql)
    plain = lambda body: _REFERENCE.sub(lambda m: f"f_{m[1]}" if m[1] in known else m[1], body).strip()
    ctes = ",\n".join(f"f_{name} as ({plain(known[name])})" for name in ordered)
    return f"with {ctes}\n{plain(sql)}" if ordered else plain(sql)
