"""Terms shared by all modules: prefixes, classes, predicates, enumerations."""

from __future__ import annotations

from dataclasses import dataclass

# Namespace table of the published data. Results only match when these are exact.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "mu": "http://mu.semte.ch/vocabularies/core/",
    "task": "http://redpencil.data.gift/vocabularies/tasks/",
    "dct": "http://purl.org/dc/terms/",
    "prov": "http://www.w3.org/ns/prov#",
    "nie": "http://www.semanticdesktop.org/ontologies/2007/01/19/nie#",
    "ext": "http://mu.semte.ch/vocabularies/ext/",
    "cogs": "http://vocab.deri.ie/cogs#",
    "adms": "http://www.w3.org/ns/adms#",
    "nfo": "http://www.semanticdesktop.org/ontologies/2007/03/22/nfo#",
    "besluit": "http://data.vlaanderen.be/ns/besluit#",
    "generiek": "https://data.vlaanderen.be/ns/generiek#",
    "org": "http://www.w3.org/ns/org#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "monitoring": "http://example.org/ns/monitoring#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "time": "http://www.w3.org/2006/time#",
}

# Classifications of administrative units.
MUNICIPALITY = (
    "http://data.vlaanderen.be/id/concept/BestuurseenheidClassificatieCode/5ab0e9b8a3b2ca7c5e000001"
)
WELFARE_CENTRE = (
    "http://data.vlaanderen.be/id/concept/BestuurseenheidClassificatieCode/5ab0e9b8a3b2ca7c5e000002"
)
PROVINCE = (
    "http://data.vlaanderen.be/id/concept/BestuurseenheidClassificatieCode/5ab0e9b8a3b2ca7c5e000000"
)
REPORTED_CLASSIFICATIONS = (MUNICIPALITY, WELFARE_CENTRE, PROVINCE)

# Final states of a harvest run.
RUN_SUCCESS = "http://redpencil.data.gift/id/concept/JobStatus/success"
RUN_FAILED = "http://redpencil.data.gift/id/concept/JobStatus/failed"
FINAL_RUN_STATES = (RUN_SUCCESS, RUN_FAILED)

# Defaults for written resources; a run names its own (see ``Names``).
REPORT_NAMESPACE = PREFIXES["monitoring"]
REPORT_GRAPH_BASE = "http://example.org/graphs/organizations/"
REPORT_GRAPH_SUFFIX = "/reports"
RESOURCE_BASE = "http://example.org/id/"
LOCAL_TIMEZONE = "Europe/Brussels"

# Graphs of jobs and of organisations.
JOB_GRAPH = "http://mu.semte.ch/graphs/job"
ORGANISATION_GRAPH = "http://mu.semte.ch/graphs/public"

# Days as URIs.
DAY_OF_WEEK = {
    "MONDAY": "http://www.w3.org/2006/time#Monday",
    "TUESDAY": "http://www.w3.org/2006/time#Tuesday",
    "WEDNESDAY": "http://www.w3.org/2006/time#Wednesday",
    "THURSDAY": "http://www.w3.org/2006/time#Thursday",
    "FRIDAY": "http://www.w3.org/2006/time#Friday",
    "SATURDAY": "http://www.w3.org/2006/time#Saturday",
    "SUNDAY": "http://www.w3.org/2006/time#Sunday",
}

# Label of each count metric, in report order.
METRIC_LABELS = {
    "sessions": "Zitting",
    "items": "Agendapunt",
    "items_without_title": "AgendapuntTitle",
    "items_without_description": "AgendapuntDescription",
    "resolutions": "Besluit",
    "votes": "Stemming",
    "duplicate_items": "AgendapuntDuplicates",
}


def iri(short: str) -> str:
    """Full IRI of a ``prefix:local`` name, for constants written in code."""
    prefix, local = short.split(":", 1)
    return PREFIXES[prefix] + local


RDF_TYPE = iri("rdf:type")
REPEAT_FREQUENCY = "http://schema.org/repeatFrequency"


@dataclass(frozen=True)
class Names:
    """Where written resources live: namespace of report terms, base of resources, base and suffix of report graphs."""

    namespace: str = REPORT_NAMESPACE
    resource_base: str = RESOURCE_BASE
    graph_base: str = REPORT_GRAPH_BASE
    graph_suffix: str = REPORT_GRAPH_SUFFIX

    def iri(self, short: str) -> str:
        """Full IRI of a ``prefix:local`` name; ``monitoring:`` is this namespace."""
        prefix, local = short.split(":", 1)
        return self.namespace + local if prefix == "monitoring" else iri(short)
