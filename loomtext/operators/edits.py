"""Layered and versioned edits: last writer wins, tiers, drafts, ledgers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.session import table


def last_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by ``order``, with ``first_seen``: the key's first place.

    One hash aggregation; a key with very many edits is combined map-side.
    """
    rest = [c for c in log.columns if c not in keys]
    g = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"), F.min(F.struct(*order)).alias("first_seen"))
    return g.select(*keys, "_v.*", "first_seen")


def tiered_union(layers: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Layers from base to local merged by key: the highest tier's latest row wins; adds ``tier``."""
    u = None
    for i, layer in enumerate(layers):
        t = layer.withColumn("tier", F.lit(i))
        u = t if u is None else u.unionByName(t, allowMissingColumns=True)
    return last_wins(u, keys, ["tier", order]).drop("first_seen")


def apply_draft(base: DataFrame, draft: DataFrame) -> DataFrame:
    """``base`` (target_id, revision, value) after a draft (target_id, base_revision, value), atomically.

    A record conflicts if its base revision is not the target's (0 for a new
    one); any conflict leaves everything as it was.
    """
    j = draft.select("target_id", "base_revision", F.col("value").alias("new")).join(base, "target_id", "left")
    bad = j.where(F.col("base_revision") != F.coalesce("revision", F.lit(0))).select(F.lit(True).alias("bad")).limit(1)
    ok = draft.join(bad, F.lit(True), "left_anti")  # empty if there is a conflict
    a = base.join(ok.select("target_id", F.col("value").alias("new"), F.lit(True).alias("hit")), "target_id", "full")
    return a.select("target_id", F.when(F.col("hit"), F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"), F.when(F.col("hit"), F.col("new")).otherwise(F.col("value")).alias("value"))


def draft_conflicts(base: DataFrame, draft: DataFrame) -> DataFrame:
    """target_id, base_revision, revision of the records that conflict."""
    j = draft.select("target_id", "base_revision").join(base.select("target_id", "revision"), "target_id", "left")
    return j.select("target_id", "base_revision", F.coalesce("revision", F.lit(0)).alias("revision")).where("base_revision <> revision")


def merge_drafts(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """target_id, value, status: identical records merge silently, different ones are 'conflict'."""
    a, b = local.select("target_id", F.col("value").alias("l")), incoming.select("target_id", F.col("value").alias("r"))
    j = a.withColumn("hl", F.lit(True)).join(b.withColumn("hr", F.lit(True)), "target_id", "full")
    status = F.when(F.col("hl").isNull(), "added").when(F.col("hr").isNull(), "local").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("conflict")
    return j.select("target_id", F.when(status == "added", F.col("r")).otherwise(F.col("l")).alias("value"), status.alias("status"))


def fold_ledger(events: DataFrame) -> DataFrame:
    """manuscript_id, event_id, version, problem of review events in order.

    ``events``: manuscript_id, seq, event_id, base_version, previous_version,
    decision.  An accepted event moves the version to 'base+event'; each event
    must name the version before it, and ids must not repeat.  A ledger is
    folded in one task; it holds the reviews of one manuscript.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        version, seen, out = None, set(), []
        for e in g.itertuples():
            version = e.base_version if version is None else version
            problem = "duplicate" if e.event_id in seen else "chain" if e.previous_version != version else None
            seen.add(e.event_id)
            if problem is None and e.decision == "accepted":
                version = f"{e.base_version}+{e.event_id}"
            out.append((e.manuscript_id, e.event_id, version, problem))
        return pd.DataFrame(out, columns=["manuscript_id", "event_id", "version", "problem"])

    return events.groupBy("manuscript_id").applyInPandas(run, "manuscript_id string, event_id string, version string, problem string")


def descendants(nodes: DataFrame, root: str) -> DataFrame:
    """id, depth of ``root`` and all below it in (id, parent_id), level by level.

    Every node counts at its least depth, so a cycle ends.  Each level is written to the shared folder, so neither
    the plan nor the number of rows is limited by a recursion.  A root that is no node gives no row; null ids are
    no nodes, repeated rows change nothing.
    """
    n = table(nodes.where("id is not null").select("id", "parent_id").distinct(), "nodes")
    level = table(n.where(F.col("id") == root).select("id").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    while level.loom_rows:
        depth = int(level.first().depth) + 1
        below = n.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        level = table(below.withColumn("depth", F.lit(depth)), "level")
        seen = seen.unionByName(level) if level.loom_rows else seen
    return seen


def unit_tree(nodes: DataFrame, order: str) -> DataFrame:
    """id, parent_id, depth, path: all nodes of (id, parent_id, order) below the roots, path by order.

    Roots have no parent or an unknown one.  ``path`` joins the places of a node and those above it by '.', each
    padded, so that it sorts as the tree reads.  Nodes of a cycle without a root are left out.
    """
    n = nodes.where("id is not null").dropDuplicates(["id"])
    w = Window.partitionBy("parent_id").orderBy(F.col(order).asc_nulls_last(), "id")
    n = table(n.join(n.select(F.col("id").alias("_p")), F.col("parent_id") == F.col("_p"), "left").withColumn("parent_id", F.col("_p")).withColumn("_n", F.format_string("%06d", F.row_number().over(w))).select("id", "parent_id", "_n"), "tree")
    level = table(n.where("parent_id is null").select("id", "parent_id", F.lit(0).alias("depth"), F.col("_n").alias("path")), "level")
    out = level
    while level.loom_rows:
        up = level.select(F.col("id").alias("parent_id"), F.col("depth").alias("_d"), F.col("path").alias("_path"))
        level = table(n.join(up, "parent_id").select("id", "parent_id", (F.col("_d") + 1).alias("depth"), F.concat_ws(".", "_path", "_n").alias("path")), "level")
        out = out.unionByName(level) if level.loom_rows else out
    return out


def without_subtree(nodes: DataFrame, root: str) -> DataFrame:
    """``nodes`` without ``root`` and everything below it."""
    return nodes.join(descendants(nodes, root).select("id"), "id", "left_anti")


#: Keys by which the collections of editorial data are merged; section edits go by unit, old ones by their own id.
COLLECTIONS = {"units": ["id"], "alignments": ["id"], "sentence_edits": ["id"], "section_edits": ["unit_key"], "text_edits": ["passage", "source"], "lexicon_entries": ["id"], "syntax_annotations": ["id"]}


def publish(published: dict[str, DataFrame], local: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(published, local) after local editorial data was published: the local row of a key replaces the published one.

    Both name frames of equal columns by collection (see ``COLLECTIONS``); of rows of one key within a side the last
    by ``seq`` counts.  Afterwards nothing is local.
    """
    out = {}
    for name, keys in COLLECTIONS.items():
        if name not in published and name not in local:
            continue
        both = [d.withColumn("unit_key", F.coalesce("unit_id", "id")) if name == "section_edits" else d for d in (published.get(name), local.get(name)) if d is not None]
        merged = tiered_union(both, keys, "seq").drop("tier")
        out[name] = merged.drop("unit_key") if name == "section_edits" else merged
    return out, {name: d.limit(0) for name, d in local.items()}


def checked_alignments(new: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) new alignments (id, targets: map of source to token ids): at least one token of the base
    source, and two sources with tokens."""
    filled = F.map_filter(F.coalesce("targets", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0)
    reason = F.when(~F.map_contains_key(filled, base), "no base token").when(F.size(filled) < 2, "one source only")
    d = new.withColumn("reason", reason)
    return d.where("reason is null").drop("reason"), d.where("reason is not null").select("id", "reason")


def checked_moves(moves: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) boundary moves (id, passage, targets: map of source to token ids, to_unit).

    ``units``: passage, unit_id, source, token_ids of the effective units.  A move has tokens of exactly one source,
    goes to a known unit, and not to the one unit that holds all of them already.  Accepted moves name the
    units they take tokens from (``from_units``, sorted).
    """
    filled = F.map_filter(F.coalesce("targets", F.create_map().cast("map<string,array<string>>")), lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0)
    m = moves.withColumn("_t", filled).withColumn("source", F.get(F.map_keys("_t"), 0)).withColumn("token_ids", F.get(F.map_values("_t"), 0))
    known = units.select("passage", F.col("unit_id").alias("to_unit")).distinct().withColumn("_known", F.lit(True))
    own = units.select("passage", "source", "unit_id", F.explode("token_ids").alias("t"))
    origin = m.select("id", "passage", "source", F.explode("token_ids").alias("t")).join(own, ["passage", "source", "t"]).groupBy("id").agg(F.array_sort(F.collect_set("unit_id")).alias("from_units"))
    m = m.join(known, ["passage", "to_unit"], "left").join(origin, "id", "left").withColumn("from_units", F.coalesce("from_units", F.array().cast("array<string>")))
    reason = F.when(F.size("_t") != 1, "not one source").when(F.col("_known").isNull(), "unknown unit").when(F.col("from_units") == F.array("to_unit"), "already there")
    m = m.withColumn("reason", reason)
    return m.where("reason is null").select("id", "passage", "source", "token_ids", "from_units", "to_unit"), m.where("reason is not null").select("id", "reason")


def text_edit_drafts(drafts: DataFrame, base: DataFrame, published: DataFrame, new: DataFrame) -> DataFrame:
    """Text edit drafts (passage, source, id, text) after ``new`` ones (passage, source, id, text).

    An edit equal to the published text (to the base text where nothing is published) deletes the draft; any other
    replaces it and keeps the draft's id.  ``base`` and ``published``: passage, source, text.
    """
    k = ["passage", "source"]
    j = new.select(*k, F.col("id").alias("new_id"), F.col("text").alias("new"))
    j = j.join(base.select(*k, F.col("text").alias("b")), k, "left").join(published.select(*k, F.col("text").alias("p")), k, "left").join(drafts.select(*k, "id"), k, "left")
    kept = j.where(~F.col("new").eqNullSafe(F.coalesce("p", "b", F.lit(""))))
    return drafts.select(*k, "id", "text").join(new.select(*k), k, "left_anti").unionByName(kept.select(*k, F.coalesce("id", "new_id").alias("id"), F.col("new").alias("text")))


def entry_drafts(local: DataFrame, known: DataFrame, new: DataFrame) -> DataFrame:
    """Local lexicon or syntax records after ``new`` ones.

    ``new``: id, existing_id (the record shown before, or null), value; ``local``: id, value, supersedes.  A record that is
    local already keeps its id and is replaced; one that exists elsewhere (``known``: id) is superseded by the new id.
    """
    j = new.join(local.select(F.col("id").alias("existing_id"), F.lit(True).alias("_local")), "existing_id", "left").join(known.select(F.col("id").alias("existing_id"), F.lit(True).alias("_known")).distinct(), "existing_id", "left")
    out = j.select(F.when(F.col("_local"), F.col("existing_id")).otherwise(F.col("id")).alias("id"), "value", F.when(F.col("_local").isNull() & F.col("_known"), F.col("existing_id")).alias("supersedes"))
    return local.select("id", "value", "supersedes").join(out.select("id"), "id", "left_anti").unionByName(out)


def appended(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the records of ``new`` it lacks; an identical one is no change, a different one an error."""
    rest = [c for c in existing.columns if c not in keys]
    n = new.select(*keys, F.struct(*rest).alias("_new")).distinct()
    j = n.join(existing.select(*keys, F.struct(*rest).alias("_old")), keys, "left")
    clash = F.col("_old").isNotNull() & ~F.to_json("_old").eqNullSafe(F.to_json("_new"))
    j = j.where(F.when(clash, F.raise_error(F.concat_ws(" ", F.lit("a different record exists:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")).otherwise(F.col("_old").isNull()))
    return existing.unionByName(j.select(*keys, "_new.*").select(*existing.columns))


def draft_with(draft: DataFrame, base: DataFrame, changes: DataFrame) -> DataFrame:
    """Draft records (id, kind, target_id, base_revision, revision, value, author, created_at, updated_at, history) after
    ``changes`` (kind, target_id, value, author, at).

    A change replaces the draft's record of its target and puts the value it had into the history; its revision is
    the base's plus one (``base``: target_id, revision; an unknown target has 0).
    """
    old = draft.select("target_id", F.col("id").alias("_id"), F.col("value").alias("_value"), F.col("created_at").alias("_made"), "history")
    j = changes.join(old, "target_id", "left").join(base.select("target_id", F.col("revision").alias("_rev")), "target_id", "left")
    rev = F.coalesce("_rev", F.lit(0))
    none = F.array().cast(draft.schema["history"].dataType)
    out = j.select(
        F.coalesce("_id", F.concat(F.lit("draft-"), "target_id")).alias("id"), "kind", "target_id", rev.alias("base_revision"), (rev + 1).alias("revision"), "value", "author",
        F.coalesce("_made", "at").alias("created_at"), F.col("at").alias("updated_at"), F.concat(F.coalesce("history", none), F.when(F.col("_id").isNotNull(), F.array("_value")).otherwise(none)).alias("history"))
    return draft.select(*out.columns).join(changes.select("target_id"), "target_id", "left_anti").unionByName(out)


DECISIONS = ("accepted", "rejected", "returned")


def apply_ledger(base: DataFrame, events: DataFrame, changes: DataFrame) -> DataFrame:
    """manuscript_id, version, problem, target_id, revision, value, event_id after the review events of every manuscript.

    ``base``: manuscript_id, version, target_id, revision, value; ``events``: manuscript_id, seq, event_id, proposal_id,
    base_version, previous_version, decision, reviewer, note; ``changes``: manuscript_id, event_id, target_id,
    base_revision, value.  Accepted changes are applied in order, each must start from its target's present
    revision (0 for a new one), and the version becomes '{base}+review.{event}'.  Any fault (a foreign base version, a repeated or
    missing event id, a second decision on a proposal, an unknown decision, a missing reviewer or note, a broken
    chain of versions, a conflict, an accepted event without changes) leaves the whole base as it was and is named.
    One manuscript's history is folded in one task, as every event depends on the ones before.
    """
    ch = changes.groupBy("manuscript_id", "event_id").agg(F.sort_array(F.collect_list(F.struct("target_id", "base_revision", "value"))).alias("changes"))
    ev = events.join(ch, ["manuscript_id", "event_id"], "left")
    ddl = f"manuscript_id {base.schema['manuscript_id'].dataType.simpleString()}, version string, problem string, target_id string, revision int, value string, event_id string"

    def run(key, b: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        first = b["version"].iloc[0] if len(b) else None
        data = {r.target_id: (int(r.revision), r.value, None) for r in b.itertuples()}
        before, version, problem, ids, decided = dict(data), first, None, set(), set()
        for r in e.sort_values("seq").itertuples():
            rows = list(r.changes) if r.changes is not None else []
            problem = (
                "base version" if r.base_version != first else "event id" if not r.event_id or r.event_id in ids else "second decision" if r.proposal_id in decided
                else "decision" if r.decision not in DECISIONS else "provenance" if not (r.reviewer and str(r.note or "").strip()) else "chain" if r.previous_version != version else None)
            ids.add(r.event_id)
            decided.add(r.proposal_id)
            if problem is None and r.decision == "accepted":
                if not rows:
                    problem = "no changes"
                elif len({c["target_id"] for c in rows}) < len(rows) or any(data.get(c["target_id"], (0,))[0] != c["base_revision"] for c in rows):
                    problem = "conflict"
                else:
                    data.update({c["target_id"]: (c["base_revision"] + 1, c["value"], r.event_id) for c in rows})
                    version = f"{first}+review.{r.event_id}"
            if problem:
                data, version = before, first
                break
        out = [(key[0], version, problem, t, *v) for t, v in sorted(data.items())]
        return pd.DataFrame(out, columns=["manuscript_id", "version", "problem", "target_id", "revision", "value", "event_id"])

    return base.groupBy("manuscript_id").cogroup(ev.groupBy("manuscript_id")).applyInPandas(run, ddl)


def decide(base: DataFrame, events: DataFrame, changes: DataFrame, decision: DataFrame) -> DataFrame:
    """``events`` with ``decision`` (one row: manuscript_id, event_id, proposal_id, decision, reviewer, note) appended.

    It names the present version as its predecessor.  A ledger with a fault, and a proposal that has a decision
    already, are errors.
    """
    now = apply_ledger(base, events, changes).groupBy("manuscript_id").agg(F.max("version").alias("version"), F.max("problem").alias("problem"))
    first = base.groupBy("manuscript_id").agg(F.max("version").alias("base_version"))
    last = events.groupBy("manuscript_id").agg(F.max("seq").alias("seq"))
    had = events.select("manuscript_id", "proposal_id").distinct().withColumn("_had", F.lit(True))
    d = decision.join(now, "manuscript_id", "left").join(first, "manuscript_id", "left").join(last, "manuscript_id", "left").join(had, ["manuscript_id", "proposal_id"], "left")
    fault = F.when(F.col("version").isNull(), "unknown manuscript").when(F.col("problem").isNotNull(), F.concat(F.lit("faulty ledger: "), "problem")).when(F.col("_had"), "the proposal has a decision")
    d = d.where(F.when(fault.isNull(), F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")))
    return events.unionByName(d.select("manuscript_id", (F.coalesce("seq", F.lit(0)) + 1).cast(events.schema["seq"].dataType).alias("seq"), "event_id", "proposal_id", "base_version", F.col("version").alias("previous_version"), "decision", "reviewer", "note").select(*events.columns))
