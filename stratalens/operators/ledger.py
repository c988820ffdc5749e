"""Identity ledger, alias graph, drift events (pattern P009) from normalised observations.

Chains and weak groups are global to the corpus. Observations are rows with observation_id, scope_key, source_family, source_adapter, source_id,
accession, source_record_id, report_period, filed_date, ordinal, paths (sorted), ids (struct figi, cusip, isin, sedol, ticker, others
array<struct<id_type,value>>), weak (array<struct<key,value>>).

Chains and groups may have any number of members, so no step gathers one. Events come from aggregates that merge (``summaries``); members stay rows; ids, which by
their definition cover all members in order, are hashed while sorted rows stream by. Only ``with_lists`` makes lists, for documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens import storage
from stratalens.functions import signatures as S
from stratalens.functions import text as T
from stratalens.operators import graph, registry

SORT = ("report_period", "source_id", "scope_key", "path", "ordinal", "observation_id")
CAP_SORT = ("source_family", "source_adapter", "scope_key", "report_period", "source_id", "path", "ordinal", "observation_id")
RESOLVED = ("resolved", "duplicate_identical")
CLASS_RANK = {"registry_bridged": 0, "registry_ambiguous": 1, "proven_transition": 2, "registry_missing": 3, "weak_collision": 4, "weak_unresolved": 5}


@dataclass(frozen=True)
class Caps:
    observations_per_scope: int = 10_000
    events_per_code: int = 1_000
    candidates_per_event: int = 20
    paths_per_ref: int = 20


def cap_rows(rows: DataFrame, scope: list[str], order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to a running count per scope, and the omitted ones."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
    return ranked.where(F.col("__rank") <= limit).drop("__rank"), ranked.where(F.col("__rank") > limit).drop("__rank")


#: From this cap on, the scopes beyond it are so few (a row of each at most for so many observations) that their names go to all tasks.
FEW_BEYOND = 1_000


def cap_scopes(rows: DataFrame, order: list, limit: int) -> tuple[DataFrame, DataFrame]:
    """``cap_rows`` by scope_key; only the rows of scopes that have more than ``limit`` are shuffled and ranked."""
    if limit < FEW_BEYOND:
        return cap_rows(rows, ["scope_key"], order, limit)
    counts = rows.groupBy(F.col("scope_key").alias("__s")).agg(F.count("*").alias("__n"))
    beyond = F.broadcast(counts.where(F.col("__n") > limit).select("__s"))
    same = F.col("scope_key").eqNullSafe(F.col("__s"))
    kept, omitted = cap_rows(rows.join(beyond, same, "left_semi"), ["scope_key"], order, limit)
    return rows.join(beyond, same, "left_anti").unionByName(kept), omitted


def basis(ids: Column, weak_present: Column) -> Column:
    """struct(basis_type, basis_value): the strongest reported identifier, else a weak description, else absent."""
    other = F.try_element_at(ids["others"], F.lit(1))
    pair = lambda kind, value: F.struct(F.lit(kind).alias("basis_type"), value.alias("basis_value"))
    out = F.when(F.lit(False), pair("", F.lit("")))
    for name in ("figi", "cusip", "isin", "sedol"):
        out = out.when(F.coalesce(ids[name], F.lit("")) != "", pair(name, ids[name]))
    out = out.when(F.coalesce(other["value"], F.lit("")) != "", pair("other_typed_identifier", F.concat_ws(":", other["id_type"], other["value"])))
    out = out.when(F.coalesce(ids["ticker"], F.lit("")) != "", pair("ticker", ids["ticker"]))
    return out.when(weak_present, pair("weak_descriptive", F.lit(""))).otherwise(pair("absent", F.lit("")))


def reported_keys(ids: Column) -> Column:
    own = F.array(*(F.struct(F.lit(n).alias("key_type"), F.coalesce(ids[n], F.lit("")).alias("value"), F.lit("reported").alias("source")) for n in ("figi", "cusip", "isin", "sedol")))
    others = F.transform(F.coalesce(ids["others"], F.array()), lambda o: F.struct(F.lit("other_typed_identifier").alias("key_type"), F.concat_ws(":", o["id_type"], o["value"]).alias("value"), F.lit("reported").alias("source")))
    return F.filter(F.concat(own, others), lambda k: k["value"] != "")


def lookup_keys(observations: DataFrame) -> DataFrame:
    """observation_id, pos, id_type, id_value in the order of precedence."""
    ids = F.col("ids")
    own = F.array(*(F.struct(F.lit(n).alias("id_type"), F.coalesce(ids[n], F.lit("")).alias("id_value")) for n in ("figi", "cusip", "isin", "sedol")))
    others = F.transform(F.coalesce(ids["others"], F.array()), lambda o: F.struct(F.concat(F.lit("other:"), o["id_type"]).alias("id_type"), o["value"].alias("id_value")))
    keys = F.filter(F.concat(own, others), lambda k: k["id_value"] != "")
    return observations.select("observation_id", F.posexplode(keys).alias("pos", "k")).select("observation_id", "pos", "k.id_type", "k.id_value")


def build_ledger(observations: DataFrame, registry_rows: DataFrame | None = None, caps: Caps = Caps()) -> tuple[DataFrame, DataFrame]:
    """The ledger's references and the diagnostics of omitted observations."""
    rows = observations.withColumn("path", F.coalesce(F.try_element_at("paths", F.lit(1)), F.lit("")))
    kept, omitted = cap_scopes(rows, list(CAP_SORT), caps.observations_per_scope)
    if registry_rows is None:
        looked = kept.withColumns({"status": F.lit("snapshot_absent"), "candidates": F.array().cast("array<struct<figi:string,row_id:string>>")})
    else:
        found = registry.by_precedence(lookup_keys(kept), registry.lookup_table(registry_rows), ["observation_id"]).select("observation_id", "status", "candidates")
        looked = kept.join(found, "observation_id", "left").withColumns({"status": F.coalesce("status", F.lit("missing")), "candidates": F.coalesce("candidates", F.array().cast("array<struct<figi:string,row_id:string>>"))})
    bridge = F.when(F.col("status").isin(*RESOLVED), F.transform(F.slice("candidates", 1, 1), lambda c: F.struct(F.lit("figi").alias("key_type"), c["figi"].alias("value"), F.lit("registry").alias("source")))).otherwise(F.array().cast("array<struct<key_type:string,value:string,source:string>>"))
    ticker = F.coalesce(F.col("ids.ticker"), F.lit(""))
    weak = F.concat(F.coalesce("weak", F.array().cast("array<struct<key:string,value:string>>")), F.array(F.struct(F.lit("ticker").alias("key"), ticker.alias("value"))))
    some = F.exists(weak, lambda p: p["value"] != "")
    ledger = looked.withColumns(
        {
            "strong_keys": F.array_sort(F.array_distinct(F.concat(reported_keys(F.col("ids")), bridge))),
            "reported_basis": basis(F.col("ids"), F.exists(F.coalesce("weak", F.array().cast("array<struct<key:string,value:string>>")), lambda p: p["value"] != "")),
            "weak_key": F.when(some, F.concat(F.lit("P009:weak|"), S.fields(weak))).otherwise(F.lit("")),
        }
    )
    resolved = F.when(F.col("status").isin(*RESOLVED), F.struct(F.lit("figi").alias("basis_type"), F.col("candidates")[0]["figi"].alias("basis_value"))).otherwise(F.col("reported_basis"))
    ledger = ledger.withColumn("resolved_basis", resolved)
    diagnostics = omitted.select(F.lit("P009-LEDGER-E001").alias("code"), F.lit("max observations per source scope exceeded; observation omitted").alias("message"), "scope_key", "observation_id")
    return ledger, diagnostics


def key_signature(key: Column) -> Column:
    return S.fields(S.pairs(source=key["source"], key_type=key["key_type"], value=key["value"]))


def alias_edges(ledger: DataFrame) -> DataFrame:
    """a, b (key signatures, a < b), edge_type, n_observations: all unordered pairs of an observation's reported keys, reported
    keys with a resolved registry key, and one (type, value) from both sources. Pairs are within one observation's few keys."""
    keys = ledger.select("observation_id", "status", F.explode("strong_keys").alias("k")).select("observation_id", "status", "k.*", key_signature(F.col("k")).alias("sig"))
    a = keys.where("source = 'reported'").select("observation_id", F.col("sig").alias("a"), F.struct("key_type", "value", "source").alias("ka"))
    b = keys.select("observation_id", F.col("sig").alias("b"), F.struct("key_type", "value", "source").alias("kb"), "source", "status")
    joined = a.join(b, "observation_id")
    same = joined.where("source = 'reported' and ka < kb").select("a", "b", F.lit("same_observation").alias("edge_type"))
    bridge = joined.where(F.col("source") == "registry").where(F.col("status").isin(*RESOLVED)).select("a", "b", F.lit("registry_bridge").alias("edge_type"))
    counted = same.union(bridge).groupBy("a", "b", "edge_type").agg(F.count("*").alias("n_observations"))
    # one row a key and source, whatever number of observations has it
    each = keys.groupBy("key_type", "value", "source", "sig").agg(F.count("*").alias("n"))
    side = lambda s: each.where(F.col("source") == s).select("key_type", "value", F.col("sig").alias(s), F.col("n").alias(f"n_{s}"))
    exact = side("registry").join(side("reported"), ["key_type", "value"])
    exact = exact.select(F.least("registry", "reported").alias("a"), F.greatest("registry", "reported").alias("b"), F.lit("exact_identifier").alias("edge_type"), (F.col("n_registry") + F.col("n_reported")).alias("n_observations"))
    return counted.union(exact)


#: Pieces of a text that is hashed as it streams by: literal, item of a list, head, inner item and tail of an item that has a list itself.
LITERAL, ITEM, HEAD, INNER, TAIL = "L", "I", "H", "N", "T"
PLACES = ("o1", "o2", "o3", "o4", "o5", "o6")
PIECE = ("kind", "group", "section", *PLACES, "piece", "text")


def pieces(rows: DataFrame, section: int, piece: str, text: Column, places: dict[str, Column] | None = None) -> DataFrame:
    """Rows (kind, group) as pieces of their group's text; ``places`` orders those of one section."""
    given = {p: (places or {}).get(p, F.lit(None)).cast("bigint" if p == "o5" else "string").alias(p) for p in PLACES}
    return rows.select("kind", "group", F.lit(section).alias("section"), *given.values(), F.lit(piece).alias("piece"), text.alias("text"))


def streamed_sha(parts: DataFrame) -> DataFrame:
    """kind, group, sha256 of each group's pieces in order; lists are joined by commas. Spark sorts, a task keeps the state of one hash: a group of any
    number of pieces is never gathered."""

    def digest(batches):
        import hashlib

        import pyarrow as pa

        now, state, outer, inner = None, None, False, False
        for batch in batches:
            done = []
            for kind, group, piece, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "group", "piece", "text"))):
                if (kind, group) != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state, outer, inner = (kind, group), hashlib.sha256(), False, False
                if piece == "N" and inner or piece in "IH" and outer:
                    state.update(b",")
                state.update(text.encode())
                outer = piece != "L" and (piece in "IT" or outer)
                inner = piece == "N"
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(("kind", "group", "sha"), map(list, zip(*done)))))
        if state is not None:
            yield pa.RecordBatch.from_pydict({"kind": [now[0]], "group": [now[1]], "sha": [state.hexdigest()]})

    order = ["kind", "group", "section", *PLACES, "piece"]
    return parts.select(*PIECE).repartition("kind", "group").sortWithinPartitions(*order).mapInArrow(digest, "kind string, `group` string, sha string")


KEY_PLACES = ("key_type", "value", "source")


def key_places(key: str) -> dict[str, Column]:
    return {f"o{i + 1}": F.col(f"{key}.{n}") for i, n in enumerate(KEY_PLACES)}


def build_chains(ledger: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains (chain_id, edge_types, continuity_class, n_keys), their keys (chain_id, k) and the chain of each observation."""
    root = storage.fresh_dir(ledger.sparkSession, "chains")
    keys = ledger.select("observation_id", F.explode("strong_keys").alias("k")).select("observation_id", "k", key_signature(F.col("k")).alias("sig"))
    comp = storage.written(graph.node_components(keys, edges, "sig", "a", "b"), f"{root}/components")
    nodes = keys.select("k", "sig").distinct().join(comp, "sig").select(F.lit("chain").alias("kind"), F.col("component").alias("group"), "k", "sig")
    nodes = storage.written(nodes, f"{root}/nodes")
    head = pieces(nodes.select("kind", "group").distinct(), 0, LITERAL, F.lit("v1|P009:chain|"))
    ids = streamed_sha(head.unionByName(pieces(nodes, 1, ITEM, F.col("sig"), key_places("k")))).select(F.col("group").alias("component"), F.col("sha").alias("chain_id"))
    ids = storage.written(ids, f"{root}/ids")
    types = edges.join(comp.withColumnRenamed("sig", "a"), "a").groupBy("component").agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"))  # of three types
    sizes = nodes.groupBy(F.col("group").alias("component")).agg(F.count("*").alias("n_keys"))
    chains = ids.join(sizes, "component").join(types, "component", "left")
    chains = chains.select("chain_id", F.coalesce("edge_types", F.array().cast("array<string>")).alias("edge_types"), F.when(F.array_contains("edge_types", "registry_bridge"), "registry_bridged").otherwise("proven").alias("continuity_class"), "n_keys")
    chain_keys = nodes.select(F.col("group").alias("component"), "k").join(ids, "component").select("chain_id", "k")
    # the keys of one observation are linked with each other: one chain each
    member = keys.groupBy("observation_id").agg(F.min("sig").alias("sig")).join(comp, "sig").join(ids, "component").select("observation_id", "chain_id")
    return chains, chain_keys, member


@dataclass(frozen=True)
class Drift:
    """Events without lists; their references and identity keys as rows of (kind, group, event_id, ...); and diagnostics (code, message, scope_key, subject_id)."""

    events: DataFrame
    refs: DataFrame
    keys: DataFrame
    diagnostics: DataFrame


STATUS_NONE = "9"


def status_order() -> Column:
    rank = T.mapped(F.col("status"), {k: str(v) for k, v in registry.STATUS_RANK.items()}, F.lit(STATUS_NONE))
    return F.struct(rank.alias("rank"), F.col("status").alias("status"))


def group_refs(ledger: DataFrame, chain_keys: DataFrame) -> DataFrame:
    """Each observation's part in its chain (kind ``chain``) and in its weak group (``weak``). The keys of one observation are in one chain, so its least
    signature names it; references without keys are not shuffled, and both parts come from one pass."""
    names = chain_keys.select(key_signature(F.col("k")).alias("__sig"), "chain_id")
    rows = ledger.withColumns({"keyed": F.size("strong_keys") > 0, "__sig": F.array_min(F.transform("strong_keys", key_signature))})
    some = F.coalesce("keyed", F.lit(False))
    rows = rows.where(some).join(names, "__sig", "left").unionByName(rows.where(~some).withColumn("chain_id", F.lit(None).cast("string"))).drop("__sig")
    part = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("group"))
    parts = F.array_compact(F.array(F.when(F.col("chain_id").isNotNull(), part("chain", "chain_id")), F.when(F.col("weak_key") != "", part("weak", "weak_key"))))
    return rows.withColumn("__p", F.explode(parts)).select("__p.*", *rows.columns)


def summaries(refs: DataFrame) -> DataFrame:
    """One row a group from aggregates that merge: its ends in order, whether a keyless reference follows one with keys, its chains
    (none, one, more), statuses and periods. Partial aggregation comes before the exchange, so a group of any size is no more than a few rows for its task."""
    order = F.struct(*SORT)
    end = F.struct(*SORT, F.col("reported_basis"))
    return refs.groupBy("kind", "group").agg(
        F.count("*").alias("n_refs"), F.min(end).alias("first"), F.max(end).alias("last"), F.min(F.when(F.col("keyed"), order)).alias("first_keyed"), F.max(F.when(~F.col("keyed"), order)).alias("last_keyless"),
        F.min("chain_id").alias("chain_low"), F.max("chain_id").alias("chain_high"), F.bool_or(F.col("status") == "missing").alias("missing"), F.bool_or(F.col("status").isin(*RESOLVED)).alias("bridged"),
        F.min(status_order()).alias("best"), F.max("report_period").alias("newest"),
    ).where("n_refs > 1")


CANDIDATES = "array<struct<figi:string,row_id:string>>"


def classified(groups: DataFrame) -> DataFrame:
    """Events of the summaries, in one pass over them; a weak group can give two."""
    best = F.when(F.col("best.rank") == STATUS_NONE, F.lit("")).otherwise(F.col("best.status"))
    listed = lambda *codes: F.array_compact(F.array(*codes))
    event = lambda kind, codes, klass, status, weak, chain: F.struct(
        F.lit(kind).alias("kind"), F.col("group").alias("group"), codes.alias("issue_codes"), klass.alias("continuity_class"), F.col("first.scope_key").alias("scope_key"), F.col("first.reported_basis").alias("basis_before"),
        F.col("last.reported_basis").alias("basis_after"), status.alias("registry_status"), weak.alias("weak_key"), chain.alias("chain_id"), F.col("n_refs").alias("n_refs"), F.col("newest").alias("newest"),
    )
    none, name, weak = F.lit(""), F.col("group"), F.col("kind") == "weak"
    moved = F.col("first.reported_basis") != F.col("last.reported_basis")
    codes = listed(F.when(moved, F.lit("identifier_basis_transition")), F.when(F.col("bridged"), F.lit("registry_bridge_available")))
    chain = F.when((F.col("kind") == "chain") & (F.size(codes) > 0), event("chain", codes, F.when(F.col("bridged"), "registry_bridged").otherwise("proven_transition"), best, none, name))
    collision = F.when(weak & (F.col("chain_low") != F.col("chain_high")), event("collision", F.array(F.lit("weak_key_temporal_collision")), F.lit("weak_collision"), none, name, none))
    removed = F.coalesce(F.col("first_keyed") < F.col("last_keyless"), F.lit(False))
    codes = listed(F.when(F.col("missing"), F.lit("registry_bridge_missing")), F.when(removed, F.lit("strong_identifier_removed")), F.lit("weak_continuity_only"))
    continuity = F.when(weak & (F.col("chain_low").isNull() | F.col("last_keyless").isNotNull()), event("continuity", codes, F.when(F.col("missing"), "registry_missing").otherwise("weak_unresolved"), best, name, none))
    return groups.select(F.inline(F.array_compact(F.array(chain, collision, continuity))))


def event_pieces(events: DataFrame, refs: DataFrame, keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """The signature's fields in the order of their names; lists stream as rows."""
    side = lambda b: S.fields(S.pairs(basis_type=b["basis_type"], basis_value=b["basis_value"]))
    some = F.col("n_keys") > 0
    start = S.fields(S.pairs(basis_before=side(F.col("basis_before")), basis_after=side(F.col("basis_after")), chain_id=F.col("chain_id"), continuity_class=F.col("continuity_class")))
    middle = F.concat(F.lit(";"), S.fields(S.pairs(issue_codes=F.array_join("issue_codes", ","))), F.lit(";observation_ids="))
    rest = S.fields(S.pairs(registry_status=F.col("registry_status"), source_scope_key=F.col("scope_key"), weak_key=F.col("weak_key")))
    parts = [
        pieces(events, 0, LITERAL, F.concat(F.lit("v1|P009:event|"), start, F.when(some, F.lit(";identity_keys=")).otherwise(""))),
        pieces(keys, 1, ITEM, S.token(key_signature(F.col("k"))), key_places("k")),
        pieces(events, 2, LITERAL, middle),
        pieces(refs, 3, ITEM, F.col("observation_id"), {f"o{i + 1}": F.col(n) for i, n in enumerate(SORT)}),
        pieces(events, 4, LITERAL, F.when(F.col("n_candidates") > 0, F.lit(";registry_candidate_ids=")).otherwise("")),
        pieces(candidates, 5, ITEM, S.token(F.col("row_id")), {"o1": F.col("figi"), "o2": F.col("row_id")}),
        pieces(events, 6, LITERAL, F.concat(F.when(rest != "", F.lit(";")).otherwise(""), rest)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_candidates(candidates: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("kind", "group").orderBy("figi", "row_id")
    return candidates.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def drift_tables(observations: DataFrame, registry_rows: DataFrame | None = None, caps: Caps = Caps()) -> Drift:
    """Observations to events. Tables that several steps read are written once."""
    root = storage.fresh_dir(observations.sparkSession, "ledger")
    save = lambda df, name: storage.written(df, f"{root}/{name}")
    ledger, left_out = build_ledger(observations, registry_rows, caps)
    ledger = save(ledger, "refs")
    _, chain_keys, _ = build_chains(ledger, save(alias_edges(ledger), "edges"))
    chain_keys = save(chain_keys, "chain_keys")
    refs = save(group_refs(ledger, chain_keys), "group_refs")
    found = save(classified(summaries(refs)), "found")
    # what belongs to an event: references of its group, keys of its chains, candidates of its references
    of = found.select("kind", "group", F.when(F.col("kind") == "chain", "chain").otherwise("weak").alias("__of"))
    own = refs.withColumnRenamed("kind", "__of").join(of, ["__of", "group"]).drop("__of")
    weak_chains = refs.where("kind = 'weak' and chain_id is not null").select(F.lit("collision").alias("kind"), "group", "chain_id").distinct()
    links = found.where("kind = 'chain'").select("kind", "group", F.col("group").alias("chain_id")).union(weak_chains.join(found.select("kind", "group"), ["kind", "group"], "left_semi"))
    keys = save(links.join(chain_keys, "chain_id").select("kind", "group", "k").distinct(), "keys")
    lists = own.where("kind <> 'collision'").select("kind", "group", F.explode("candidates").alias("c")).select("kind", "group", "c.figi", "c.row_id").distinct()
    candidates = save(lists, "candidates")
    count = lambda df, name: df.groupBy("kind", "group").agg(F.count("*").alias(name))
    sized = found.join(count(keys, "n_keys"), ["kind", "group"], "left").join(count(candidates, "n_candidates"), ["kind", "group"], "left").fillna(0, ["n_keys", "n_candidates"])
    # one reference alone is ambiguous: its few keys and candidates are at hand
    alone = ledger.where("status = 'ambiguous'").withColumns({
        "kind": F.lit("ambiguous"), "issue_codes": F.array(F.lit("registry_bridge_ambiguous")), "continuity_class": F.lit("registry_ambiguous"), "basis_before": F.col("reported_basis"), "basis_after": F.col("reported_basis"),
        "registry_status": F.col("status"), "n_refs": F.lit(1).cast("bigint"), "newest": F.col("report_period"), "n_keys": F.size("strong_keys").cast("bigint"), "n_candidates": F.size("candidates").cast("bigint"), "chain_id": F.lit(""),
        "group": F.concat_ws("|", "observation_id", F.sha2(F.to_json(F.struct(*SORT)), 256)),
    })
    alone = save(alone.dropDuplicates(["kind", "group"]), "alone")
    names = sized.columns
    events = save(sized.unionByName(alone.select(*names)), "events")
    keys = keys.union(alone.select("kind", "group", F.explode("strong_keys")))
    candidates = candidates.union(alone.select("kind", "group", F.explode("candidates").alias("c")).select("kind", "group", "c.figi", "c.row_id"))
    own = own.unionByName(alone.select("kind", "group", *(c for c in own.columns if c in alone.columns and c not in ("kind", "group", "chain_id")), F.lit(None).cast("string").alias("chain_id"), (F.size("strong_keys") > 0).alias("keyed")))
    ids = save(streamed_sha(event_pieces(events, own, keys, candidates)).withColumnRenamed("sha", "event_id"), "ids")
    order = [T.mapped(F.col("continuity_class"), {k: str(v) for k, v in CLASS_RANK.items()}, F.lit("9")), F.array_join("issue_codes", ","), F.desc("newest"), F.col("event_id"), F.col("kind"), F.col("group")]
    named = events.join(ids, ["kind", "group"])
    rank = F.row_number().over(Window.partitionBy("__code").orderBy(*order))
    kept = named.withColumn("__code", F.col("issue_codes")[0]).withColumn("__rank", rank).where(F.col("__rank") <= caps.events_per_code).drop("__code", "__rank")
    kept = save(kept, "kept")
    dropped = named.join(kept.select("kind", "group"), ["kind", "group"], "left_anti")
    told = dropped.select(F.lit("P009-LEDGER-E002").alias("code"), F.concat(F.lit("more events than are kept for "), F.col("issue_codes")[0]).alias("message"), "scope_key", F.col("event_id").alias("subject_id"))
    few = save(top_candidates(candidates.join(kept.select("kind", "group"), ["kind", "group"], "left_semi"), caps.candidates_per_event), "few")
    # an event whose candidates are cut has an id of its own
    cut = kept.where(F.col("n_candidates") > caps.candidates_per_event)
    semi = lambda df: df.join(cut.select("kind", "group"), ["kind", "group"], "left_semi")
    again = streamed_sha(event_pieces(cut, semi(own), semi(keys), semi(few))).withColumnRenamed("sha", "__id")
    shown = few.groupBy("kind", "group").agg(F.array_sort(F.collect_list(F.struct("figi", "row_id"))).alias("registry_candidates"))  # bounded by the cap
    final = kept.join(again, ["kind", "group"], "left").join(shown, ["kind", "group"], "left")
    final = final.withColumn("event_id", F.coalesce("__id", "event_id")).withColumn("registry_candidates", F.coalesce("registry_candidates", F.array().cast(CANDIDATES))).drop("__id")
    final = save(final, "final")
    name = final.select("kind", "group", "event_id")
    parts = own.join(name, ["kind", "group"]).withColumn("paths", F.slice("paths", 1, caps.paths_per_ref)).drop("chain_id", "keyed")
    return Drift(final, parts, keys.join(name, ["kind", "group"]), left_out.withColumnRenamed("observation_id", "subject_id").union(told))


REF = (*SORT, "reported_basis", "status", "candidates", "strong_keys", "accession", "filed_date", "weak", "paths", "ids")


def with_lists(d: Drift) -> DataFrame:
    """Events as documents show them, with lists of their references and keys: for events that somebody reads, not for the scan."""
    refs = d.refs.groupBy("kind", "group").agg(F.array_sort(F.collect_list(F.struct(*REF))).alias("refs"))
    keys = d.keys.groupBy("kind", "group").agg(F.array_sort(F.collect_list("k")).alias("identity_keys"))
    none = F.array().cast("array<struct<key_type:string,value:string,source:string>>")
    out = d.events.join(refs, ["kind", "group"]).join(keys, ["kind", "group"], "left")
    return out.withColumn("identity_keys", F.coalesce("identity_keys", none)).drop("kind", "group", "n_keys", "n_candidates")


def drift(observations: DataFrame, registry_rows: DataFrame | None = None, caps: Caps = Caps()) -> tuple[DataFrame, DataFrame]:
    """Events with lists, and the diagnostics of the observations and events that the caps leave out."""
    d = drift_tables(observations, registry_rows, caps)
    return with_lists(d), d.diagnostics


def drift_events(observations: DataFrame, registry_rows: DataFrame | None = None, caps: Caps = Caps()) -> DataFrame:
    """Events with lists, without the diagnostics that ``drift`` gives."""
    return drift(observations, registry_rows, caps)[0]
