from datetime import date

import pytest
from pyspark.sql import Observation
from pyspark.sql import Observation
from pyspark.sql import functions as F

from graphreports.schemas import QUADS
from graphreports.sources import graph, links, nquads, store
from graphreports.vocabulary import MUNICIPALITY, RDF_TYPE, iri

LINES = [
    '<http://a/s> <http://a/p> <http://a/o> <http://a/g> .',
    '<http://a/s> <http://a/p> "say \\"hi\\"\\n\\u00e9"@nl-BE .',
    '_:b1 <http://a/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://a/g> .',
    '<http://a/s> <http://a/p> _:b2 . # a comment',
    '<http://a/s> <http://a/p> "x" . # with "quotes" .',
    "# only a comment",
    "   ",
    "not a statement",
    '<http://a/s> <http://a/p> "un"escaped" .',
    '<http://a/s> "literal predicate" <http://a/o> .',
]


def test_parse_and_reject(spark, rows):
    lines = rows("value string", *[(line,) for line in LINES])
    quads = [tuple(r) for r in nquads.parse_nquads(lines, "h").collect()]
    string = iri("xsd:string")
    assert quads == [
        ("h", "http://a/g", "http://a/s", "http://a/p", "http://a/o", "iri", None, None),
        ("h", None, "http://a/s", "http://a/p", 'say "hi"\né', "literal", iri("rdf:langString"), "nl-be"),
        ("h", "http://a/g", "_:b1", "http://a/p", "5", "literal", iri("xsd:integer"), None),
        ("h", None, "http://a/s", "http://a/p", "_:b2", "bnode", None, None),
        ("h", None, "http://a/s", "http://a/p", "x", "literal", string, None),
    ]
    assert [r[0] for r in nquads.rejected_lines(lines).collect()] == LINES[-3:]


def test_long_literals_are_read_whole(spark, rows):
    body = "een regel\\n" * 50000
    line = f'<http://a/s> <http://a/p> "{body}" .'
    got = nquads.parse_nquads(rows("value string", (line,)), "h").first()
    assert got.o == "een regel\n" * 50000


def test_text_files_round_trip(spark, rows, tmp_path):
    lines = rows("value string", *[(line,) for line in LINES])
    nquads.write_nquads(nquads.parse_nquads(lines, "h").repartition(3), str(tmp_path / "nq"))
    seen = Observation()
    again = nquads.read_quads(spark, str(tmp_path / "nq"), "h", scope="d", observation=seen).collect()
    assert sorted(map(str, again)) == sorted(map(str, nquads.parse_nquads(lines, "h", scope="d").collect()))
    assert seen.get == {"statements": 5, "rejected": 0}


def test_blank_nodes(spark, rows, tmp_path):
    lines = rows("value string", ("<s:s> <p:p> _:b2.",), ("<s:s> <p:p> _:b.2 _:g.",), ("_:b. <p:p> <o:o> .",))
    seen = Observation()
    got = nquads.parse_nquads(lines, "h", scope="one", observation=seen).collect()
    assert [(r.o, r.g) for r in got] == [("_:one-b2", None), ("_:one-b.2", "_:one-g")]
    assert seen.get == {"statements": 2, "rejected": 1}
    lines.limit(1).write.text(str(tmp_path / "a"))
    lines.limit(1).write.text(str(tmp_path / "b"))
    nodes = {nquads.read_quads(spark, str(tmp_path / d), "h").first().o for d in "ab"}
    assert len(nodes) == 2, "equal labels of two dumps are two nodes"


def _quads(rows, *triples, harvester="h"):
    out = []
    for s, p, o, *rest in triples:
        kind = rest[0] if rest else "iri"
        datatype = rest[1] if len(rest) > 1 else (iri("xsd:string") if kind == "literal" else None)
        out.append((harvester, "g", s, p, o, kind, datatype, rest[2] if len(rest) > 2 else None))
    return rows(QUADS, *out) if out else rows(QUADS)


def test_store_prunes_to_one_predicate(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    quads = _quads(rows, ("s", "p1", "o"), ("s", "p2", "o"), ("t", "p2", "o"))
    store.write_quads(quads, path)
    stored = store.load_quads(spark, path)
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, quads.collect()), key=str)
    one = graph.property_of(stored, "p2")
    assert "PartitionFilters: [isnotnull(p" in one._jdf.queryExecution().toString()
    assert one.count() == 2


def test_a_new_harvest_replaces_all_of_its_harvester(spark, rows, tmp_path):
    path = str(tmp_path / "store")
    store.write_quads(_quads(rows, ("s", "p1", "o"), ("s", "p2", "o")), path)
    store.write_quads(_quads(rows, ("s", "p2", "o"), harvester="other"), path)
    store.write_quads(_quads(rows, ("s", "p1", "new")), path)
    got = sorted((r.harvester, r.p, r.o) for r in store.load_quads(spark, path).collect())
    assert got == [("h", "p1", "new"), ("other", "p2", "o")]


def test_starts_of_any_form_count(spark, rows):
    from graphreports.operators.sessions import on_day, with_planned_start

    starts = {"a": "2024-05-02", "b": "2024-05-01T22:30:00+0000", "c": "2024-05-02T01:30:00.250+02:00", "d": "soon", "e": "2024-05-01T23:59:59", "f": None}
    triples = []
    for s, start in starts.items():
        triples += [(s, RDF_TYPE, iri("besluit:Zitting")), (s, iri("besluit:isGehoudenDoor"), "body")]
        triples += [(s, iri("besluit:geplandeStart"), start, "literal")] if start else []
    table = links.session_table(_quads(rows, *triples))
    assert {r.session_uri for r in with_planned_start(table).collect()} == set("abcde")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for z in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", z)
        assert {r.session_uri for r in on_day(table, date(2024, 5, 2)).collect()} == set("abc")
    spark.conf.set("spark.sql.session.timeZone", zone)
    with pytest.raises(TypeError):
        on_day(table.withColumn("planned_start", F.lit("x")), date(2024, 5, 2))


def test_star_needs_every_property_and_keeps_every_value(rows):
    quads = _quads(
        rows, ("a", RDF_TYPE, "C"), ("b", RDF_TYPE, "C"), ("a", "p", "1"), ("a", "p", "2"), ("a", "q", "x"), ("b", "p", "1")
    )
    assert sorted(tuple(r)[1:] for r in graph.star(quads, "C", {"p": "p", "q": "q"}).collect()) == [
        ("a", "1", "x"), ("a", "2", "x"),
    ]


def test_path_does_not_pass_through_text(rows):
    quads = _quads(rows, ("a", "p", "b"), ("c", "p", "b", "literal"), ("b", "q", "end"))
    assert [tuple(r) for r in graph.follow_path(quads, ["p", "q"]).collect()] == [("h", "a", "end")]


def test_any_value_without_values_means_all(rows):
    quads = _quads(rows, ("a", "p", "1"), ("b", "p", "2"))
    assert graph.with_any_value(quads, "p", []).count() == 2
    assert [r.s for r in graph.with_any_value(quads, "p", ["2"]).collect()] == ["b"]


def test_abstract_body_without_specific_one_is_left_out(rows):
    node, label = iri("org:classification"), iri("skos:prefLabel")
    triples = [("_:c", RDF_TYPE, iri("skos:Concept")), ("_:c", label, "Raad", "literal")]
    for body in ("b1", "b2"):
        triples += [(body, RDF_TYPE, iri("besluit:Bestuursorgaan")), (body, iri("besluit:bestuurt"), "u"), (body, node, "_:c", "bnode")]
    triples.append(("t1", iri("generiek:isTijdspecialisatieVan"), "b1"))
    got = sorted(tuple(r) for r in links.unit_bodies(_quads(rows, *triples)).collect())
    assert got == [("u", "b1", "Raad", "abstract"), ("u", "t1", "Raad", "time-specific")]


def test_titles_with_other_language_stay_apart(rows):
    title = iri("dct:title")
    quads = _quads(rows, ("i", title, "A", "literal", "d", "nl"), ("i", title, "A", "literal", "d", "fr"))
    assert links.title_table(quads).count() == 2


def test_session_without_start_stays(rows):
    quads = _quads(
        rows, ("s", RDF_TYPE, iri("besluit:Zitting")), ("s", iri("besluit:isGehoudenDoor"), "b"),
        ("x", iri("besluit:isGehoudenDoor"), "b"),
    )
    assert [(r.session_uri, r.planned_start) for r in links.session_table(quads).collect()] == [("s", None)]


def test_dimension_snapshots(spark, rows, tmp_path):
    path, day = str(tmp_path / "dim"), date(2024, 1, 2)
    assert not store.has_snapshot(spark, path, day)
    store.save_dimension(rows("u string", ("old",)), path, date(2024, 1, 1))
    store.save_dimension(rows("u string", ("first",)), path, day)
    store.save_dimension(rows("u string", ("new",)), path, day)
    assert store.has_snapshot(spark, path, day)
    assert [r.u for r in store.load_dimension(spark, path).collect()] == ["new"]
    assert [r.u for r in store.load_dimension(spark, path, date(2024, 1, 1)).collect()] == ["old"]


def test_federate_tells_harvesters_apart(rows):
    both = graph.federate({"x": _quads(rows, ("a", "p", "1")), "y": _quads(rows, ("a", "p", "1"))})
    assert graph.property_of(both, "p").count() == 2
    assert graph.in_graph(both, "elsewhere").isEmpty()


def test_unit_properties_select_by_class_or_override(rows):
    from graphreports.operators.units import select_units

    triples = []
    for unit, cls, classification in (("a", True, MUNICIPALITY), ("b", True, "other"), ("c", False, MUNICIPALITY)):
        if cls:
            triples.append((unit, RDF_TYPE, iri("besluit:Bestuurseenheid")))
        triples += [
            (unit, iri("mu:uuid"), unit, "literal"), (unit, iri("skos:prefLabel"), unit, "literal"),
            (unit, iri("org:classification"), classification),
        ]
    quads = _quads(rows, *triples)
    assert [r.unit_uri for r in select_units(quads).collect()] == ["a"]
    assert sorted(r.unit_uri for r in select_units(quads, ["b", "c"]).collect()) == ["b", "c"]


def test_rejects_and_quads_come_of_one_pass(spark, tmp_path):
    dump, folder = tmp_path / "dump", str(tmp_path / "staged")
    dump.mkdir()
    (dump / "a.nq").write_text('<a:s> <a:p> "x" .\nbroken\n# note\n\n_:b <a:p> _:b <a:g> .\n<a:s> <a:p> "un"quoted" .\n')
    lines = spark.read.text(str(dump))
    quads, rejects = nquads.stage_quads(lines, "h", folder, scope="d")
    (dump / "a.nq").unlink()  # neither frame reads the dump again
    assert sorted((r.s, r.o, r.g) for r in quads.collect()) == [("_:d-b", "_:d-b", "a:g"), ("a:s", "x", None)]
    assert sorted(tuple(r) for r in rejects.collect()) == [("h", '<a:s> <a:p> "un"quoted" .'), ("h", "broken")]


def test_many_dumps_are_one_scan(spark, tmp_path):
    dumps = {}
    for k in range(200):
        place = tmp_path / f"dump {k}%41é"
        place.mkdir()
        for n in range(2):
            (place / f"f {n}.nq").write_text(f"<a:s{n}> <a:p> _:b .\n")
        dumps[str(place)] = f"h{k % 3}"
    single = tmp_path / "one.nq"
    single.write_text('<a:s> <a:p> "x" .\nbroken\n')
    dumps[str(single)] = "single"
    seen = Observation()
    df = nquads.read_dumps(spark, dumps, seen)
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan text") == 1
    got = df.collect()
    assert len(got) == 401 and len({r.o for r in got}) == 201 and seen.get == {"statements": 401, "rejected": 1}
    assert {r.harvester for r in got} == {"h0", "h1", "h2", "single"}
    a = nquads.read_quads(spark, next(iter(dumps)), "h0")
    assert {tuple(r) for r in a.collect()} <= {tuple(r) for r in got}


def test_intermediate_tables_need_a_shared_folder():
    from graphreports.runtime import fallback_folder

    assert fallback_folder("local[4]", "file:/w/") == "file:/w/_checkpoints" and fallback_folder("local", "/w") == "/w/_checkpoints"
    assert fallback_folder("yarn", "hdfs://n/w") == "hdfs://n/w/_checkpoints"
    for master in ("yarn", "spark://m:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            fallback_folder(master, "file:/w")
