"""N-Quads and N-Triples text: distributed reading and writing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphreports.functions.terms import XSD_STRING
from graphreports.functions.text import escape_literal, unescape_literal
from graphreports.runtime import file_system
from graphreports.schemas import QUADS, conform
from graphreports.vocabulary import iri

LANG_STRING = iri("rdf:langString")

_IRI = r"<([^<>\x00-\x20]*+)>"
# A label may hold dots but does not end with one: that dot ends the statement.
_BNODE = r"(_:[^\s<>\".#]++(?:\.++[^\s<>\".#]++)*+)"
_SUFFIX = r"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^<([^<>\x00-\x20]*+)>)?"


def _statement(literal: str, tail: str) -> str:
    """Anchored pattern of one statement. Groups: subject IRI, subject bnode, predicate, object
    IRI, object bnode, literal, language, datatype, graph IRI, graph bnode."""
    return (
        rf"(?s)^\s*+(?:{_IRI}|{_BNODE})\s*+{_IRI}\s*+"
        rf"(?:{_IRI}|{_BNODE}|\"({literal})\"{_SUFFIX})\s*+(?:{_IRI}|{_BNODE})?\s*+\.{tail}\z"
    )


# The literal is matched as one run of any characters, which needs no recursion for long texts;
# quotes left unescaped inside it are looked for afterwards. The second form is only tried on
# lines the first one cannot read.
STATEMENT = _statement(".*", r"\s*+")
COMMENTED = _statement(".*?", r"\s*+#.*")
IGNORED = r"(?s)^\s*+(?:#.*)?\z"

QUAD, REJECTED = "quad", "rejected"  # status of a line
_SEP = "\x1f"  # cannot occur in an IRI; the literal is put last
_FIELDS = ("s_iri", "s_bnode", "p", "o_iri", "o_bnode", "lang", "datatype", "g_iri", "g_bnode", "lex")
_ORDER = (1, 2, 3, 4, 5, 7, 8, 9, 10, 6)


def _rewritten(line: Column, form: str) -> Column:
    """Separated fields of a line that matches; a line that does not stays as it is."""
    return F.split(
        F.regexp_replace(line, form, _SEP.join(f"${n}" for n in _ORDER)), _SEP, len(_FIELDS)
    )


def _checked(fields: Column, line: Column, form: str) -> Column:
    """``fields`` of a statement, NULL for a line that is none."""
    matched = (F.size(fields) == len(_FIELDS)) & (~line.contains(_SEP) | line.rlike(form))
    literal = F.get(fields, F.lit(len(_FIELDS) - 1))
    bare = F.regexp_replace(literal, r"(?s)\\.", "")
    well_escaped = (~literal.contains('"') & ~literal.contains("\\")) | (
        ~bare.contains('"') & ~bare.contains("\\")
    )
    return F.when(matched & well_escaped, fields)


def _with_fields(lines: DataFrame, line: str, *others: Column) -> DataFrame:
    """``others``, ``line`` and ``fields`` of each line. The pattern runs once per line: exploding
    an array of one keeps later filters from being moved below it, where they would run it again, and
    the checks from being put into every column made of the fields. Only a line it cannot read is tried with the second pattern."""
    c = F.col("line")
    first = lines.select(
        *others, F.col(line).alias("line"), F.explode_outer(F.array(_rewritten(F.col(line), STATEMENT))).alias("first")
    )
    second = _checked(_rewritten(c, COMMENTED), c, COMMENTED)
    fields = F.coalesce(_checked(F.col("first"), c, STATEMENT), second)
    return first.select(*[x for x in first.columns if x != "first"], F.explode_outer(F.array(fields)).alias("fields"))


_LOCAL = "^file:/+"  # local paths are written with one slash or three


def _uniform(path: str) -> str:
    return re.sub(_LOCAL, "file:/", path)


def _terms(scope: Column | None) -> dict[str, Column]:
    """The columns of a quad, from ``fields``."""
    scoped = lambda label: label if scope is None else F.concat(F.lit("_:"), scope, F.lit("-"), F.substring(label, 3, 2**31 - 1))
    field = {name: F.col("fields")[i] for i, name in enumerate(_FIELDS)}
    filled = lambda name: field[name] != ""

    def resource(kind: str) -> Column:
        return F.when(filled(f"{kind}_iri"), unescape_literal(field[f"{kind}_iri"])).when(
            filled(f"{kind}_bnode"), scoped(field[f"{kind}_bnode"])
        )

    is_literal = ~filled("o_iri") & ~filled("o_bnode")
    return {
        "g": resource("g"),
        "s": resource("s"),
        "p": unescape_literal(field["p"]),
        "o": F.coalesce(resource("o"), unescape_literal(field["lex"])),
        "o_kind": F.when(filled("o_iri"), "iri").when(filled("o_bnode"), "bnode").otherwise("literal"),
        "o_datatype": F.when(is_literal & filled("lang"), LANG_STRING)
        .when(is_literal & filled("datatype"), field["datatype"])
        .when(is_literal, XSD_STRING),
        "o_lang": F.when(filled("lang"), F.lower(field["lang"])),
    }


def _columns(harvester: str | Column, scope: str | Column | None) -> list[Column]:
    """``harvester`` and, if there is one, ``scope``."""
    found = [F.lit(harvester) if isinstance(harvester, str) else harvester]
    found += [] if scope is None else [F.lit(scope) if isinstance(scope, str) else scope]
    return [c.alias(name) for c, name in zip(found, ("harvester", "scope"), strict=False)]


def parse_nquads(
    lines: DataFrame, harvester: str | Column, column: str = "value", scope: str | Column | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Quads from a DataFrame of text lines.

    ``scope`` becomes part of every blank-node label, which only means something within its dump.
    Lines that are no statement are left out. ``observation`` gets ``statements`` and ``rejected``,
    counted in the same pass, once the quads are computed; :func:`rejected_lines` has the lines, and :func:`stage_quads` both."""
    parsed = _with_fields(lines, column, *_columns(harvester, scope))
    if observation is not None:
        read = F.col("fields").isNotNull()
        bad = F.count_if(~read & ~F.col("line").rlike(IGNORED))
        parsed = parsed.observe(observation, F.count_if(read).alias("statements"), bad.alias("rejected"))
    parsed = parsed.filter(F.col("fields").isNotNull())
    terms = _terms(None if scope is None else F.col("scope"))
    return conform(parsed.select("harvester", *[c.alias(name) for name, c in terms.items()]), QUADS)


def stage_quads(
    lines: DataFrame, harvester: str | Column, folder: str, column: str = "value", scope: str | Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Quads, and ``(harvester, line)`` of the lines that are neither a statement, a comment nor blank. Lines are read and parsed once, into
    ``folder``, which has a part for either; both frames read that folder."""
    spark = lines.sparkSession
    parsed = _with_fields(lines, column, *_columns(harvester, scope))
    rejected = F.col("fields").isNull()
    told = parsed.filter(~(rejected & F.col("line").rlike(IGNORED))).select(
        "harvester", *[c.alias(name) for name, c in _terms(None if scope is None else F.col("scope")).items()],
        F.when(rejected, F.col("line")).alias("line"), F.when(rejected, REJECTED).otherwise(QUAD).alias("status"),
    )
    told.write.partitionBy("status").parquet(folder)
    back = spark.read.schema(told.schema).parquet(folder)
    kept = lambda status: back.filter(F.col("status") == status)
    return conform(kept(QUAD), QUADS), kept(REJECTED).select("harvester", "line")


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither a statement, a comment nor blank."""
    parsed = _with_fields(lines, column)
    return parsed.filter(F.col("fields").isNull() & ~F.col("line").rlike(IGNORED)).select("line")


def dump_scope(harvester: str, *paths: str) -> str:
    """What tells the blank nodes of one dump from those of others."""
    return hashlib.md5("\n".join([harvester, *paths]).encode()).hexdigest()[:12]


def read_quads(
    spark: SparkSession, path: str | list[str], harvester: str, scope: str | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """Quads of one harvester from the N-Quads or N-Triples files of one dump; large files are read
    in splits. Blank nodes are scoped by ``scope``, by default a digest of harvester and path."""
    paths = [path] if isinstance(path, str) else list(path)
    if scope is None:
        scope = dump_scope(harvester, *paths)
    return parse_nquads(spark.read.text(paths), harvester, scope=scope, observation=observation)


def read_dumps(spark: SparkSession, dumps: Mapping[str, str], observation: Observation | None = None) -> DataFrame:
    """Quads of many dumps, ``{path of a file or folder of files: harvester}``, in one scan however many there are. Each line's dump is told by
    its file's path, joined with the dumps named; blank nodes are scoped as :func:`read_quads` scopes those of one."""
    named: dict[str, list[tuple[str, str, str]]] = {"folder": [], "file": []}
    for path, harvester in dumps.items():
        place, fs = file_system(spark, path)
        scope = dump_scope(harvester, path)
        kind = "folder" if fs.getFileStatus(place).isDirectory() else "file"
        named[kind].append((_uniform(fs.makeQualified(place).toUri().toString()), harvester, scope))
    file = F.regexp_replace("_metadata.file_path", _LOCAL, "file:/")
    dumped = spark.read.text(list(dumps)).select("value", file.alias("file"), F.regexp_replace(file, "/[^/]*$", "").alias("folder"))
    for kind in named:  # one row a dump, as many as the caller names
        table = spark.createDataFrame(named[kind], f"{kind} string, {kind}_harvester string, {kind}_scope string")
        dumped = dumped.join(F.broadcast(table), kind, "left")
    either = lambda name: F.coalesce(f"file_{name}", f"folder_{name}")
    return parse_nquads(dumped, either("harvester"), scope=either("scope"), observation=observation)


def statement_text() -> Column:
    """N-Quads text of a row of quads."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    suffix = (
        F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), F.col("o_lang")))
        .when(F.coalesce(F.col("o_datatype"), F.lit(XSD_STRING)) == XSD_STRING, F.lit(""))
        .otherwise(F.concat(F.lit("^^<"), F.col("o_datatype"), F.lit(">")))
    )
    literal = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), suffix)
    term = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o")))
    terms = F.concat_ws(" ", node(F.col("s")), node(F.col("p")), term, node(F.col("g")))
    return F.concat(terms, F.lit(" ."))


def format_nquads(quads: DataFrame) -> DataFrame:
    """One column ``value`` with the N-Quads text of each row."""
    return quads.select(statement_text().alias("value"))


def write_nquads(quads: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write quads as N-Quads text, one file per task. Left uncompressed, since a reader can
    split such files."""
    format_nquads(quads).write.mode(mode).text(path)
