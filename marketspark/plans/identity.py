"""Ticker episodes, transitions, lineages and securities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions.scalars import status_case
from marketspark.operators.graph import connected_components
from marketspark.operators.joins import asof_join
from marketspark.operators.mutate import assign_ids, upsert
from marketspark.operators.quality import assert_assigned_once
from marketspark.operators.ranking import ranked_rows
from marketspark.operators.selection import best_match, latest_per_key
from marketspark.operators.sets import union_distinct
from marketspark.operators.timeline import neighbours, running
from marketspark.session import stage


def ticker_episodes(evidence: DataFrame, clean: DataFrame) -> DataFrame:
    """Cut each ticker's history at validated identity changes; count its internal gaps (TB-4)."""
    valid = evidence.where(F.col("same_security") & F.col("effective_date").isNotNull())
    boundaries = union_distinct(
        *[
            valid.where(F.col(side).isNotNull()).select(F.col(side).alias("act_symbol"), F.col("effective_date").alias("date"))
            for side in ("from_ticker", "to_ticker")
        ]
    )
    days = clean.select("act_symbol", "date").distinct()
    marked = boundaries.select("*", F.lit(0).alias("_side")).unionByName(days.select("*", F.lit(1).alias("_side")))
    numbered = running(
        marked, ["act_symbol"], ["date", "_side"],
        {"episode_number": ("sum", F.when(F.col("_side") == 0, 1).otherwise(0))},
    ).where("_side = 1").withColumn("episode_number", F.col("episode_number") + 1).drop("_side")
    gapped = neighbours(numbered, ["act_symbol", "episode_number"], ["date"], {"_previous": "date"}).withColumn(
        "_gap", F.datediff("date", "_previous")
    )
    stats = gapped.groupBy("act_symbol", "episode_number").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("n_observations"),
        F.max("_gap").alias("max_internal_gap_days"), F.count_if(F.col("_gap") > 7).alias("gaps_over_7_days"),
        F.count_if(F.col("_gap") > 30).alias("gaps_over_30_days"),
    )
    code = F.concat("act_symbol", F.lit("_E"), F.lpad(F.col("episode_number").cast("string"), 3, "0"))
    return stats.select(code.alias("ticker_episode_id"), *stats.columns)


def ticker_lineage_evidence(changes: DataFrame, source_type: str, source_reference: str) -> DataFrame:
    """Two kinds of claims from a ticker change list: issuer mapping and predecessor (TB-5)."""
    cik = F.coalesce("cik", F.lit(""))

    def claim(kind, rows, from_ticker, *parts):
        return rows.select(
            F.md5(F.concat_ws("|", F.lit(source_type), F.lit(kind), *parts)).alias("evidence_id"),
            F.lit(kind).alias("claim_type"), from_ticker.alias("from_ticker"), F.col("ticker").alias("to_ticker"), "cik",
            F.lit(source_type).alias("source_type"), F.lit(source_reference).alias("source_reference"), "flat_file_only",
        )

    mapped = claim("ticker_cik_mapping", changes.where("cik IS NOT NULL"), F.lit(None).cast("string"), "ticker", cik)
    earlier = claim(
        "historical_predecessor", changes.where("old_ticker IS NOT NULL"), F.col("old_ticker"), "old_ticker", "ticker", cik
    )
    return mapped.unionByName(earlier)


def ticker_transitions(evidence: DataFrame, episodes: DataFrame) -> DataFrame:
    """Map each validated change to the closest pair of episodes around its date (TB-6, JN-18).

    The distance is a sum of one term per side, so the best pair is the last old episode
    to end by then with the first new one to start after it: one lookup per side.
    """
    valid = evidence.where("same_security")
    old = episodes.select(
        F.col("act_symbol").alias("from_ticker"), F.col("ticker_episode_id").alias("from_episode_id"),
        F.col("start_date").alias("from_episode_start"), F.col("end_date").alias("from_episode_end"),
    )
    new = episodes.select(
        F.col("act_symbol").alias("to_ticker"), F.col("ticker_episode_id").alias("to_episode_id"),
        F.col("start_date").alias("to_episode_start"), F.col("end_date").alias("to_episode_end"),
    )
    last = best_match(old, ["from_ticker", "from_episode_end"], ["from_episode_id"])
    first = best_match(new, ["to_ticker", "to_episode_start"], ["to_episode_id"])
    parts = {c: c for c in ("from_episode_id", "from_episode_start", "from_episode_end")}
    left = asof_join(valid, last, ["from_ticker"], "effective_date", "from_episode_end", parts)
    parts = {c: c for c in ("to_episode_id", "to_episode_start", "to_episode_end")}
    best = asof_join(left, first, ["to_ticker"], "effective_date", "to_episode_start", parts, forward=True)
    best = best.where("from_episode_id IS NOT NULL AND to_episode_id IS NOT NULL")
    before, after = F.datediff("effective_date", "from_episode_end"), F.datediff("to_episode_start", "effective_date")
    return best.select(
        F.md5(F.concat_ws("|", "evidence_id", "from_episode_id", "to_episode_id")).alias("transition_id"),
        *best.columns, before.alias("days_old_end_to_effective"), after.alias("days_effective_to_new_start"),
        status_case(
            [
                ((before <= 4) & (after == 0), "observed_transition"),
                (before <= 4, "new_side_gap"),
                (after == 0, "old_side_gap"),
            ],
            "both_sides_gap",
        ).alias("coverage_diagnostic"),
    )


def nearest_transitions(transitions: DataFrame) -> DataFrame:
    """One transition per evidence id, that of the least distance: evidence stated in several rows is one change.

    Transitions without an evidence id all stay.
    """
    distance = F.col("days_old_end_to_effective") + F.col("days_effective_to_new_start")
    stated = transitions.where("evidence_id IS NOT NULL")
    nearest = best_match(stated, ["evidence_id"], [distance, "from_episode_id", "to_episode_id", "effective_date"])
    return nearest.unionByName(transitions.where("evidence_id IS NULL"))


def record_transition_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Add or replace evidence rows under an id made of what they claim (TB-7)."""
    keyed = incoming.withColumn(
        "evidence_id",
        F.md5(F.concat_ws("|", "source_type", "from_ticker", "to_ticker", F.col("effective_date").cast("string"))),
    )
    return upsert(existing, keyed, ["evidence_id"])


def lineage_components(transitions: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes linked by validated transitions, each with its component's least episode id."""
    edges = transitions.where("same_security")
    found = connected_components(edges, "from_episode_id", "to_episode_id")
    members = episodes.select("ticker_episode_id", "act_symbol", "start_date", "end_date", "n_observations")
    return members.join(
        found.select(F.col("node").alias("ticker_episode_id"), F.col("component").alias("component_root")), "ticker_episode_id"
    )


def _latest_ticker(components: DataFrame) -> DataFrame:
    latest = latest_per_key(components, ["component_root"], ["end_date", "start_date", "ticker_episode_id"])
    return latest.select("component_root", F.col("act_symbol").alias("latest_ticker"))


def lineage_preview(components: DataFrame) -> DataFrame:
    """Members of every component under a code made of its latest ticker (TB-8)."""
    named = components.join(_latest_ticker(components), "component_root")
    return named.select(
        F.concat("latest_ticker", F.lit("_1")).alias("lineage_code"),
        "ticker_episode_id", "act_symbol", "start_date", "end_date", "n_observations",
    )


def lineage_master(preview: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per lineage with a stable number; known codes keep theirs (TB-9)."""
    found = preview.groupBy("lineage_code").agg(
        F.max_by("act_symbol", F.struct("end_date", "start_date", "ticker_episode_id")).alias("latest_ticker"),
        F.min("start_date").alias("first_observed_date"), F.max("end_date").alias("last_observed_date"),
    )
    return assign_ids(existing, found, ["lineage_code"], "lineage_id")


def lineage_membership(preview: DataFrame, master: DataFrame) -> DataFrame:
    """Episodes of each lineage in order of their start (TB-9)."""
    rows = preview.join(master.select("lineage_code", "lineage_id"), "lineage_code")
    numbered = ranked_rows(rows, ["lineage_id"], ["start_date", "ticker_episode_id"], "sequence_number")
    return numbered.select("lineage_id", "ticker_episode_id", "sequence_number")


def reconcile_preview(components: DataFrame, membership: DataFrame) -> DataFrame:
    """What to do with each component: create, reuse or leave for a manual merge (TB-10)."""
    stats = components.groupBy("component_root").agg(
        F.count(F.lit(1)).alias("episode_count"), F.min("start_date").alias("first_observed_date"),
        F.max("end_date").alias("last_observed_date"),
    )
    known = (
        components.select("component_root", "ticker_episode_id")
        .join(membership.select("ticker_episode_id", "lineage_id"), "ticker_episode_id", "left")
        .groupBy("component_root")
        .agg(F.count_distinct("lineage_id").alias("existing_lineage_count"), F.min("lineage_id").alias("existing_lineage_id"))
    )
    action = status_case(
        [
            (F.col("existing_lineage_count") == 0, "CREATE_NEW_LINEAGE"),
            (F.col("existing_lineage_count") == 1, "REUSE_EXISTING_LINEAGE"),
        ],
        "MANUAL_MERGE_REQUIRED",
    )
    joined = stats.join(_latest_ticker(components), "component_root").join(known, "component_root")
    return joined.withColumn("reconciliation_action", action)


def free_suffix_codes(wanted: DataFrame, existing_codes: DataFrame) -> DataFrame:
    """Give each (ticker, order) row the ticker's next free ``<ticker>_<n>`` code (MUT-7).

    The k-th free number is k plus the used numbers u (i-th in order) with ``u - i < k``;
    both lists are merged in one ordered pass, so a ticker may have any number of codes.
    """
    used = existing_codes.select(
        F.regexp_extract("lineage_code", r"^(.*)_[0-9]+$", 1).alias("latest_ticker"),
        F.regexp_extract("lineage_code", r"_([0-9]+)$", 1).try_cast("long").alias("_u"),
    ).where("_u IS NOT NULL AND _u > 0").distinct()
    ranked = ranked_rows(used, ["latest_ticker"], ["_u"], "_i", "_all")
    # along the order the used numbers' gaps only grow: the last one below k says how many stand before the k-th free number
    gaps = ranked.groupBy("latest_ticker", (F.col("_u") - F.col("_i")).alias("_at")).agg(F.max("_i").alias("_skip"))
    numbered = ranked_rows(wanted, ["latest_ticker"], ["component_root"], "_k", "_all").drop("_all")
    asked = numbered.select("latest_ticker", (F.col("_k") - 1).alias("_at"), "component_root")
    merged = gaps.withColumn("_side", F.lit(0)).unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    found = running(merged, ["latest_ticker"], ["_at", "_side", "component_root"], {"_skipped": ("last", F.col("_skip"))}, slice_by=F.floor(F.col("_at") / 100_000))
    skipped = found.where("_side = 1").select("component_root", F.col("_skipped").alias("_skip"))
    joined = numbered.join(skipped, "component_root", "left")
    number = (F.col("_k") + F.coalesce("_skip", F.lit(0))).cast("string")
    return joined.withColumn("lineage_code", F.concat_ws("_", "latest_ticker", number)).drop("_k", "_skip")


def reconcile_lineages(
    components: DataFrame, master: DataFrame, membership: DataFrame
) -> dict[str, DataFrame]:
    """Apply the preview: new and updated lineages, members, a log and open issues (TB-10, MUT-7).

    A component that touches several lineages is only reported, never merged.
    """
    plan = reconcile_preview(components, membership)
    fresh = free_suffix_codes(plan.where("existing_lineage_count = 0"), master)
    created = assign_ids(master.select("lineage_id", "lineage_code"), fresh, ["lineage_code"], "lineage_id", only_new=True)
    names = ["lineage_id", "lineage_code", "latest_ticker", "first_observed_date", "last_observed_date"]
    reused = plan.where("existing_lineage_count = 1").withColumn("lineage_id", F.col("existing_lineage_id")).join(
        master.select("lineage_id", "lineage_code"), "lineage_id"
    )
    done = created.unionByName(reused, allowMissingColumns=True)
    new_master = upsert(master.select(*names), done.select(*names), ["lineage_id"])
    members = components.select("component_root", "ticker_episode_id", "start_date").join(
        done.select("component_root", "lineage_id"), "component_root"
    )
    numbered = ranked_rows(members, ["component_root"], ["start_date", "ticker_episode_id"], "sequence_number")
    keys = ["lineage_id", "ticker_episode_id"]
    added = numbered.select(*keys, "sequence_number").join(membership, keys, "left_anti")
    several = plan.where("existing_lineage_count > 1").select("component_root")
    ids = (
        components.select("component_root", "ticker_episode_id").join(several, "component_root")
        .join(membership, "ticker_episode_id").select("component_root", "lineage_id").distinct()
    )
    issues = ids.groupBy("component_root").agg(
        F.lit("MULTIPLE_EXISTING_LINEAGES").alias("issue_type"),
        F.array_join(F.transform(F.sort_array(F.collect_list("lineage_id")), lambda x: x.cast("string")), ",").alias("existing_lineage_ids"),
    )
    return {
        "ticker_lineage_master": new_master,
        "ticker_lineage_membership": membership.select(*keys, "sequence_number").unionByName(added),
        "lineage_reconciliation_log": done.select(
            "component_root", F.col("reconciliation_action").alias("action"), "lineage_id", "lineage_code", "episode_count"
        ),
        "lineage_reconciliation_issue": issues,
    }


def security_tables(episodes: DataFrame, membership: DataFrame, lineages: DataFrame) -> dict[str, DataFrame]:
    """Securities: one per validated lineage and one per episode outside any lineage (TB-11).

    Ids follow from the order of episode ids and lineage ids, so a rebuild repeats them.
    """
    single = episodes.join(membership.select("ticker_episode_id"), "ticker_episode_id", "left_anti").select(
        F.concat(F.lit("E|"), "ticker_episode_id").alias("natural_key"), F.lit("singleton_episode").alias("identity_status"),
        F.lit(None).cast("long").alias("lineage_id"), F.col("start_date").alias("first_observed_date"),
        F.col("end_date").alias("last_observed_date"), "ticker_episode_id",
    )
    whole = lineages.select(
        F.concat(F.lit("L|"), F.lpad(F.col("lineage_id").cast("string"), 19, "0")).alias("natural_key"),
        F.lit("validated_lineage").alias("identity_status"), F.col("lineage_id").cast("long").alias("lineage_id"),
        "first_observed_date", "last_observed_date", F.lit(None).cast("string").alias("ticker_episode_id"),
    )
    numbered = assign_ids(None, single.unionByName(whole), ["natural_key"], "security_id")
    master = numbered.select("security_id", "identity_status", "lineage_id", "first_observed_date", "last_observed_date")
    own = numbered.where("ticker_episode_id IS NOT NULL").select("security_id", "ticker_episode_id", F.col("identity_status").alias("membership_method"))
    shared = master.where("identity_status = 'validated_lineage'").join(membership, "lineage_id").select(
        "security_id", "ticker_episode_id", F.lit("validated_lineage").alias("membership_method")
    )
    return {"security_master": master, "security_episode_membership": own.unionByName(shared)}


def rebuild_identity(evidence: DataFrame, clean: DataFrame) -> dict[str, DataFrame]:
    """Episodes to securities in one pass, refused when an episode is not owned exactly once (TB-12)."""
    episodes = stage(ticker_episodes(evidence, clean))
    transitions = stage(ticker_transitions(evidence, episodes))
    preview = stage(lineage_preview(lineage_components(transitions, episodes)))
    lineages = stage(lineage_master(preview))
    members = stage(lineage_membership(preview, lineages))
    securities = security_tables(episodes, members, lineages)
    owners = stage(securities["security_episode_membership"])
    assert_assigned_once(episodes, owners, "ticker_episode_id")
    return {
        "ticker_episode": episodes, "ticker_transition": transitions, "ticker_lineage_master": lineages,
        "ticker_lineage_membership": members, "security_master": securities["security_master"], "security_episode_membership": owners,
    }
