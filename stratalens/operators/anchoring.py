"""Anchoring of extension concepts (pattern P002)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import signatures as S

#: Namespaces of standard taxonomies, and arc roles that count as anchoring.
STANDARD = (
    "http://fasb.org/us-gaap/",
    "http://xbrl.sec.gov/dei/",
    "http://xbrl.sec.gov/country/",
    "http://xbrl.sec.gov/currency/",
    "http://xbrl.ifrs.org/taxonomy/",
    "http://www.xbrl.org/2003/instance",
    "http://www.w3.org/2001/XMLSchema",
)
ARC_ROLES = (
    "http://www.xbrl.org/2003/arcrole/concept-label",
    "http://www.xbrl.org/2003/arcrole/concept-reference",
    "http://xbrl.us/us-gaap/role/label/negated",
)


def is_extension(namespace: Column, standard: tuple[str, ...] = STANDARD) -> Column:
    out = F.lit(True)
    for prefix in standard:
        out = out & ~namespace.startswith(prefix)
    return out


def defects(concepts: DataFrame, anchors: DataFrame, key: list[str], concept: str, target: str, tests: dict[str, Column]) -> DataFrame:
    """key, concept, issue_codes: concepts without an anchor are ``unanchored``, the others get the codes whose test holds
    for an anchor. ``anchors`` has the concept and the target's columns; the tests name both sides' columns."""
    joined = concepts.join(anchors, [*key, concept], "left")
    found = F.array_compact(F.array(F.when(F.col(target).isNull(), F.lit("unanchored")), *(F.when(F.col(target).isNotNull() & F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items())))
    each = joined.select(*key, concept, F.explode(found).alias("code"))
    return each.groupBy(*key, concept).agg(F.array_sort(F.collect_set("code")).alias("issue_codes"))


def examples(left: DataFrame, facts: DataFrame, key: list[str], order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` facts of each key, joined to the left rows; rows without facts are dropped."""
    ranked = facts.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= n)
    return left.join(ranked, key)


def detect(concepts: DataFrame, relationships: DataFrame, facts: DataFrame, arc_roles: tuple[str, ...] = ARC_ROLES) -> DataFrame:
    """accession, clark, issue_codes, signature, instance_id, examples of extension concepts with defects and facts."""
    own = concepts.where(is_extension(F.col("namespace")))
    targets = concepts.select("accession", F.col("clark").alias("to_clark"), F.col("namespace").alias("t_namespace"), F.col("type").alias("t_type"), F.col("period_type").alias("t_period"), F.col("abstract").alias("t_abstract"))
    anchors = relationships.where(F.col("arcrole").isin(*arc_roles)).select("accession", F.col("from_clark").alias("clark"), "to_clark").distinct().join(targets, ["accession", "to_clark"], "left")
    tests = {
        "anchor_target_abstract": F.col("t_abstract"),
        "period_type_mismatch": F.col("period_type") != F.col("t_period"),
        "type_mismatch": F.col("type") != F.col("t_type"),
        "anchor_to_extension": is_extension(F.col("t_namespace")),
    }
    bad = defects(own, anchors, ["accession"], "clark", "to_clark", tests).where(F.size("issue_codes") > 0)
    sig = S.anchoring(F.col("clark"), F.col("issue_codes"))
    refs = facts.select("accession", F.col("qname.clark").alias("clark"), "context_ref", "value").where("context_ref is not null")
    shown = examples(bad, refs, ["accession", "clark"], ["context_ref", "value"])
    out = shown.groupBy("accession", "clark", "issue_codes").agg(F.array_sort(F.collect_list(F.struct("rank", "context_ref", "value"))).alias("examples"))
    return out.select("accession", "clark", "issue_codes", sig.alias("signature"), S.sha(sig).alias("instance_id"), "examples")
