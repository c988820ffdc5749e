"""Detectors of filings: contract, registry, one plan over all of them, findings and their documents.

A detector turns tables into instances: rows (accession, instance_id, issue_codes, data), data as JSON text. ``run`` unions the
instances of all detectors that a filing's form allows and makes one finding per filing and pattern, with its citations, break triggers,
instances in the order of their ids, the gate on citations, and the finding that is reported.

Defined results: filings without instances have no finding; instances of filings that aren't in ``filings`` are dropped; repeated instances
count once; empty tables give no rows. A detector whose tables are missing is skipped and told of by ``skipped``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import signatures as S
from stratalens.operators import anchoring, collapse, facts, findings, ledger, rules, taxonomy

Tables = Mapping[str, DataFrame]
INSTANCE = ["accession", "instance_id", "issue_codes", "data"]
CITATION = "struct<source:string,citation:string,url:string,retrieved_at:string,sha256:string,notes:string>"


@dataclass(frozen=True)
class Detector:
    """What a pattern is called, which tables it reads, and how it makes instances. ``forms`` None allows every form."""

    pattern_id: str
    name: str
    kind: str
    needs: tuple[str, ...]
    instances: Callable[[Tables], DataFrame]
    alert_eligible: bool = True
    forms: tuple[str, ...] | None = None
    #: Identifiers of the break triggers that apply.
    triggers: tuple[str, ...] = ()
    #: Whether every instance is a primary one, or only the first of a filing.
    all_primary: bool = True


class Registry:
    """Detectors by pattern, in the order of registration; a second one for a pattern replaces the first."""

    def __init__(self, detectors: Iterable[Detector] = ()):
        self.detectors: dict[str, Detector] = {}
        for d in detectors:
            self.register(d)

    def register(self, detector: Detector) -> Detector:
        self.detectors[detector.pattern_id] = detector
        return detector

    def unregister(self, pattern_id: str) -> None:
        self.detectors.pop(pattern_id, None)

    def get(self, pattern_id: str) -> Detector:
        if pattern_id not in self.detectors:
            raise ValueError(f"no detector is registered for {pattern_id}")
        return self.detectors[pattern_id]

    def patterns(self, alert_eligible: bool = False) -> list[str]:
        return [p for p, d in self.detectors.items() if d.alert_eligible or not alert_eligible]


def as_json(*columns: str | Column) -> Column:
    """A row's payload; fields in the order of their names, as ``to_json`` writes them."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _duplicates(t: Tables) -> DataFrame:
    return facts.detect(t["facts"], t["contexts"]).select("accession", "instance_id", "issue_codes", as_json("facts", "n_facts", "signature").alias("data"))


def _anchoring(t: Tables) -> DataFrame:
    return anchoring.detect(t["concepts"], t["relationships"], t["facts"]).select("accession", "instance_id", "issue_codes", as_json(F.col("clark").alias("concept"), "examples", "signature").alias("data"))


def _rules(t: Tables) -> DataFrame:
    return rules.detect(t["facts"]).select("accession", "instance_id", F.array("issue_code").alias("issue_codes"), as_json("concept", "context_ref", "signature").alias("data"))


def _taxonomy(t: Tables) -> DataFrame:
    found = taxonomy.detect(t["schema_refs"], t["declared"], t["facts"].select("accession", F.col("qname.namespace").alias("namespace")).where("namespace <> ''"))
    return found.select("accession", "instance_id", F.array("issue_code").alias("issue_codes"), as_json("details", "signature").alias("data"))


def _collapse(t: Tables) -> DataFrame:
    found = collapse.detect(t["facts"], t.get("lookups"))
    return found.select("accession", "instance_id", "issue_codes", as_json("members", "members_truncated", "n_members", "weak_key").alias("data"))


def drift_instances(events: DataFrame) -> DataFrame:
    """An event is an instance of every filing that one of its references names; its payload has bases, candidates, keys and references."""
    ref = F.transform("refs", lambda r: F.struct(r["accession"].alias("accession"), r["filed_date"].alias("filed_date"), r["observation_id"].alias("observation_id"), r["report_period"].alias("report_period"), r["scope_key"].alias("scope_key"), r["source_id"].alias("source_id")))
    payload = as_json("basis_after", "basis_before", "chain_id", "continuity_class", "identity_keys", ref.alias("refs"), "registry_candidates", "registry_status", "scope_key", "weak_key")
    rows = events.withColumns({"data": payload, "accession": F.explode(F.array_distinct(F.filter(F.transform("refs", lambda r: r["accession"]), lambda a: F.coalesce(a, F.lit("")) != "")))})
    return rows.select("accession", F.col("event_id").alias("instance_id"), "issue_codes", "data")


def _drift(t: Tables) -> DataFrame:
    return drift_instances(ledger.drift_events(t["observations"], t.get("registry")))


#: Kinds of instances, and identifiers of break triggers.
DETECTORS = Registry([
    Detector("P001", "Duplicate facts", "duplicate_fact_set", ("facts", "contexts"), _duplicates, triggers=("BT001", "BT004")),
    Detector("P002", "Extension concepts without proper anchors", "extension_anchoring_issue", ("concepts", "relationships", "facts"), _anchoring, triggers=("BT002", "BT003", "BT004")),
    Detector("P004", "Types, units and numeric attributes", "fact_numeric_typing_issue", ("facts",), _rules, triggers=("BT003", "BT004")),
    Detector("P005", "Taxonomy references", "taxonomy_reference_issue", ("schema_refs", "declared", "facts"), _taxonomy, triggers=("BT003", "BT004")),
    Detector("P008", "Instruments that share a weak key", "instrument_identity_collapse", ("facts",), _collapse, triggers=("BT008",)),
    Detector("P009", "Instrument identity over time", "instrument_identity_drift", ("observations",), _drift, triggers=("BT009",), all_primary=False),
])


def skipped(tables: Tables, registry: Registry = DETECTORS) -> dict[str, list[str]]:
    """The tables that are missing, by the pattern that needs them."""
    return {p: gone for p, d in registry.detectors.items() if (gone := [n for n in d.needs if n not in tables])}


def instances(tables: Tables, filings: DataFrame, registry: Registry = DETECTORS, patterns: Iterable[str] | None = None) -> DataFrame:
    """accession, pattern_id, kind, instance_id, issue_codes, data of all detectors whose tables are there, over filings of their forms."""
    wanted = [d for p, d in registry.detectors.items() if (patterns is None or p in set(patterns)) and p not in skipped(tables, registry)]
    parts = []
    for d in wanted:
        own = filings if d.forms is None else filings.where(F.upper(F.trim("form")).isin(*d.forms))
        rows = d.instances(tables).select(*INSTANCE).dropDuplicates(["accession", "instance_id"])
        parts.append(rows.join(own.select("accession").distinct(), "accession", "left_semi").withColumns({"pattern_id": F.lit(d.pattern_id), "kind": F.lit(d.kind)}))
    if not parts:
        none = filings.select("accession", F.lit("").alias("instance_id"), F.array(F.lit("")).alias("issue_codes"), F.lit("").alias("data"), F.lit("").alias("pattern_id"), F.lit("").alias("kind"))
        return none.limit(0)
    return reduce(DataFrame.unionByName, parts)


def run(tables: Tables, filings: DataFrame, rule_basis: DataFrame | None = None, registry: Registry = DETECTORS, patterns: Iterable[str] | None = None, limit: int = findings.INSTANCE_LIMIT, prefix: str = "F") -> DataFrame:
    """One row per filing (accession, form) and pattern with instances. rule_basis has pattern_id and the citation's fields; without it findings aren't
    gated. ``selection`` marks the finding to report."""
    rows = instances(tables, filings, registry, patterns)
    kept = findings.truncated(rows, ["accession", "pattern_id"], ["instance_id"], limit).withColumn("__first", F.col("pos") == 1)
    primary = F.lit(False)
    for d in registry.detectors.values():
        primary = F.when(F.col("pattern_id") == d.pattern_id, F.lit(True) if d.all_primary else F.col("__first")).otherwise(primary)
    one = F.struct("instance_id", "kind", primary.alias("primary"), "issue_codes", "data")
    out = kept.groupBy("accession", "pattern_id", "total", "included", "truncated").agg(F.array_sort(F.collect_list(one)).alias("instances"))
    out = out.withColumnsRenamed({"total": "instance_count_total", "included": "instance_count_included", "truncated": "instances_truncated"})
    name, alert, triggers = F.lit(""), F.lit(False), F.array().cast("array<string>")
    for d in registry.detectors.values():
        own = F.col("pattern_id") == d.pattern_id
        name, alert = F.when(own, d.name).otherwise(name), F.when(own, F.lit(d.alert_eligible)).otherwise(alert)
        triggers = F.when(own, F.array(*map(F.lit, sorted(d.triggers))).cast("array<string>")).otherwise(triggers)
    out = out.withColumns({"finding_id": S.finding_id(F.col("accession"), F.col("pattern_id"), prefix), "pattern_name": name, "alert_eligible": alert, "break_triggers": triggers, "status": F.lit("detected"), "human_review_required": F.lit(True)})
    if rule_basis is None:
        out = out.withColumns({"rule_basis": F.array().cast(f"array<{CITATION}>"), "suppression_reason": F.lit("")})
    else:
        fields = [F.col(c) if c in rule_basis.columns else F.lit(None).cast("string").alias(c) for c in ("source", "citation", "title", "url", "retrieved_at", "sha256", "notes")]
        raw = rule_basis.select("pattern_id", F.struct(*fields).alias("c"))
        cites = raw.groupBy("pattern_id").agg(F.array_sort(F.collect_set(findings.normal_citation(F.col("c")))).alias("rule_basis"), F.bool_or(findings.valid_citation(F.col("c"))).alias("__valid"))  # a few per pattern
        out = out.join(cites, "pattern_id", "left").withColumn("rule_basis", F.coalesce("rule_basis", F.array().cast(f"array<{CITATION}>")))
        good = F.coalesce("__valid", F.lit(False))
        out = out.withColumns({"status": F.when(good, F.col("status")).otherwise("suppressed"), "suppression_reason": F.when(good, F.lit("")).otherwise("no valid citation")}).drop("__valid")
    return findings.ranked(out, ["accession"], eligible=F.col("alert_eligible") & (F.col("status") == "detected")).drop("rank")


def documents(found: DataFrame, filings: DataFrame, generated_at: str, toolchain: Mapping[str, str] | None = None, markers: DataFrame | None = None) -> DataFrame:
    """accession, document: one JSON text per filing, findings in the order of their ids, markers by id and boundary, field names sorted. Filings
    without findings have a document without any. ``generated_at`` is given, so that a document depends on its inputs only."""
    fields = ["alert_eligible", "break_triggers", "finding_id", "human_review_required", "instance_count_included", "instance_count_total", "instances", "instances_truncated", "pattern_id", "pattern_name", "rule_basis", "selection", "status", "suppression_reason"]
    lists = found.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct("finding_id", F.struct(*fields).alias("f")))).alias("__f"))  # one row per pattern
    rows = filings.select("accession", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("cik", "form", "filed_date"))).dropDuplicates(["accession"]).join(lists, "accession", "left")
    parts = {"findings": F.coalesce(F.transform("__f", lambda x: x["f"]), F.array()), "generated_at": F.lit(generated_at), "input": F.struct("accession", "cik", "filed_date", "form")}
    if markers is not None:
        own = F.struct(F.col("marker").alias("marker_id"), F.col("prior_accession").alias("from_accession"), F.col("accession").alias("to_accession"))
        rows = rows.join(markers.groupBy("accession").agg(F.array_sort(F.collect_set(own)).alias("__m")), "accession", "left")
        parts["markers"] = F.coalesce("__m", F.array().cast("array<struct<marker_id:string,from_accession:string,to_accession:string>>"))
    parts |= {"schema_version": F.lit("1.0"), "toolchain": F.struct(*(F.lit(v).alias(k) for k, v in sorted((toolchain or {"engine": "stratalens"}).items())))}
    return rows.select("accession", F.to_json(F.struct(*(c.alias(k) for k, c in sorted(parts.items())))).alias("document"))
