"""Worked examples of returns, guards, caps, filings and evaluation."""

import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketspark.operators.quality import QualityError, assert_rules, assert_unique, leakage_rules
from marketspark.plans import actions, crosssection, filings, identity, metrics, prices, reference, research, returns, shares
from marketspark.session import stage
from marketspark.streaming import guard

D1, D2, D3, D4 = (date(2020, 6, d) for d in (15, 16, 17, 18))
OVERRIDE = ("security_id long, event_date date, corporate_action_type string, dividend_share_basis string, override_split_ratio double, "
            "override_dividend_amount double, override_dividend_ex_date date, resolution_source string, source_reference string, resolution_notes string")


def one_event(spark, before, after, ratio, dividend, basis):
    calendar = spark.createDataFrame([(D1,), (D2,)], "session_date date")
    px = spark.createDataFrame([(1, "T", D1, before, True, "primary"), (1, "T", D2, after, True, "primary")],
                               "security_id long, ticker string, date date, close double, research_eligible boolean, source string")
    split = spark.createDataFrame([(1, D2, ratio)], "security_id long, split_date date, split_ratio double")
    over = spark.createDataFrame([(1, D2, "reverse_split", basis, ratio, dividend, None, "issuer", "ref", "note")], OVERRIDE)
    factors = actions.split_factor(px, split, over)
    div = spark.createDataFrame([(1, "T", D2, dividend, "provisionally_accepted")],
                                "security_id long, ticker string, ex_date date, amount double, validation_status string")
    fixes = spark.createDataFrame([], "security_id long, event_date date, corrected_dividend_amount double")
    events = actions.dividend_events(div, factors, calendar, over, fixes)
    rows = returns.daily_return(calendar, events, returns.return_basis(px, factors))
    return {r.date: r for r in rows.collect()}[D2]


def test_reverse_split_with_post_split_dividend(spark):
    row = one_event(spark, 4.20, 16.70, 0.25, 0.60, "post_split")
    assert row.split_normalized_close == pytest.approx(4.175)
    assert row.split_normalized_dividend == pytest.approx(0.15)
    assert row.gross_total_return == pytest.approx(0.0298, abs=1e-4)


def test_reverse_split_with_pre_split_distribution(spark):
    row = one_event(spark, 20.00, 16.42, 1 / 3, 14.00, "pre_split")
    assert row.split_normalized_close == pytest.approx(5.4733, abs=1e-4)
    assert row.gross_total_return == pytest.approx(-0.0263, abs=1e-4)


def test_no_return_across_a_gap_and_segments(spark):
    calendar = spark.createDataFrame([(D1,), (D2,), (D3,), (D4,)], "session_date date")
    px = spark.createDataFrame(
        [(1, D1, 10.0), (1, D2, 11.0), (1, D4, 12.0), (2, D1, 5.0), (2, D2, 5.5), (2, D3, 6.05), (2, D4, 0.0)],
        "security_id long, date date, close double").withColumns({
            "ticker": F.lit("T"), "price_research_eligible": F.lit(True), "cumulative_split_multiplier": F.lit(1.0),
            "daily_split_ratio": F.lit(1.0), "split_normalized_close": F.col("close")})
    none = spark.createDataFrame([], "security_id long, effective_dividend_ex_date date, research_eligible boolean, dividend_previous_share_basis double, raw_dividend_amount double")
    daily = returns.daily_return(calendar, none, px)
    status = {(r.security_id, r.date): r.return_status for r in daily.collect()}
    assert status[1, D4] == "missing_previous_price" and status[1, D1] == "no_previous_market_session"
    diagnostics = spark.createDataFrame([], "security_id long, date date, diagnostic_class string, price_level_diagnostic string")
    research_rows = returns.research_return(daily, diagnostics)
    index = {(r.security_id, r.date): r for r in returns.total_return_index(research_rows).collect()}
    assert index[2, D3].gross_total_return_index == pytest.approx(1.21)
    assert index[2, D4].research_quarantine_reason == "nonpositive_wealth_factor" and index[2, D4].gross_total_return_index is None
    assert index[1, D4].return_segment_id == index[1, D2].return_segment_id + 1


def test_split_backfill_needs_the_exact_counterfactual(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 1.5, 0.25, "exact_date_ratio_conflict", 0.5), (2, 1.0, 1.5, 0.26, "exact_date_ratio_conflict", 0.5), (3, 2.0, 1.5, 0.25, "exact_date_ratio_conflict", 0.5)],
        "security_id long, daily_split_ratio double, provider_raw_return double, provider_adjusted_return double, split_comparison_status string, provider_split_ratio double")
    good = [r.security_id for r in actions.split_backfill_validation(rows).where("exact_date_missing_split_validated").collect()]
    assert good == [1]


def test_closed_day_copies(spark):
    calendar = spark.createDataFrame([(D1,), (D3,)], "session_date date")
    bars = [("A", D1, 1.0, 5), ("A", D2, 1.0, 5), ("A", D3, 2.0, 5), ("B", D1, 1.0, 5), ("B", D2, 3.0, 5), ("B", D3, 3.0, 5), ("C", D2, 9.0, 1), ("E", D1, 4.0, 1), ("E", D2, 4.0, 1), ("E", D3, 4.0, 1)]
    df = spark.createDataFrame([(s, d, c, c, c, c, v) for s, d, c, v in bars], "act_symbol string, date date, open double, high double, low double, close double, volume long")
    got = {r.act_symbol: r.quality_status for r in prices.ohlcv_quality(df, calendar).where(F.col("date") == F.lit(D2)).collect()}
    assert got == {"A": "closed_session_duplicate_previous", "B": "closed_session_duplicate_next", "C": "closed_session_anomalous", "E": "closed_session_duplicate_both"}


FACTS = ("security_id long, ticker string, vendor_provider_symbol string, shares_period_date date, shares_filing_date date, vendor_filed_shares double, "
         "first_eligible_shares double, first_eligible_factor double, invalidated boolean, selected_days long")


def filed(values, factors=None, bad=()):
    start = date(2020, 1, 1)
    return [(1, "T", "T.US", start + timedelta(days=90 * i), start + timedelta(days=90 * i + 30), v or 1.0, v, (factors or [1.0] * len(values))[i], i in bad, 1) for i, v in enumerate(values)]


def test_guard_never_learns_from_a_flag(spark):
    rows = spark.createDataFrame(filed([40e6, 40e9, 41e9, 39e9, 40.5e6]), FACTS)
    got = [r.guard_status for r in guard.classify_filings(rows).orderBy("shares_filing_date").collect()]
    assert got == ["no_prior_eligible_observation"] + ["quarantined_100x_up"] * 3 + ["accepted"]


def test_guard_split_boundary_and_ineligible_rows(spark):
    rows = spark.createDataFrame(filed([1e6, 500e6, None, 400e6, 2e12], [1.0, 2.0, 2.0, 2.0, 2.0], bad={4}), FACTS)
    got = [r.guard_status for r in guard.classify_filings(rows).orderBy("shares_filing_date").collect()]
    assert got == ["no_prior_eligible_observation", "split_boundary_unchecked", "not_eligible", "accepted", "not_eligible"]


def test_guard_slices_equal_one_walk(spark):
    """Yearly slices against a plain loop over all filings of a security."""
    rng, rows, want = random.Random(4), [], {}
    for security in (1, 2, 3):
        base = None
        for k in range(40):
            day = date(2010, 1, 1) + timedelta(days=75 * k + security)
            shares, factor, bad = rng.choice([1e6, 1.2e6, 3e9, 5e8, None]), rng.choice([1.0] * 12 + [2.0]), rng.random() < 0.1
            rows.append((security, "T", "T.US", day, day, float(k), shares, factor, bad, 1))
            if bad or shares is None:
                kind = "not_eligible"
            elif base is None:
                kind = "no_prior_eligible_observation"
            elif abs(factor / base[1] - 1) > 0.01:
                kind = "split_boundary_unchecked"
            else:
                kind = "quarantined_100x_up" if shares / base[0] >= 100 else "accepted"
            want[security, day] = (kind, base[0] if base else None)
            if kind not in ("not_eligible", "quarantined_100x_up"):
                base = (shares, factor)
    got = guard.classify_filings(spark.createDataFrame(rows, FACTS)).collect()
    assert {(r.security_id, r.shares_filing_date): (r.guard_status, r.prior_accepted_shares) for r in got} == want and len(got) == len(rows)


def test_guard_on_a_stream_keeps_its_baseline(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = filed([40e6, 40e9, 41e9, 40.5e6])
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(source)
        stream = guard.classify_filings_stream(spark.readStream.schema(FACTS).parquet(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = [r.guard_status for r in spark.read.parquet(str(tmp_path / "out")).orderBy("shares_filing_date").collect()]
    assert got == ["no_prior_eligible_observation", "quarantined_100x_up", "quarantined_100x_up", "accepted"]


def test_late_filings_are_judged_in_their_place(spark, tmp_path):
    """Filings in any order of arrival end with the verdicts of the batch form; the state keeps a bounded span."""
    rng = random.Random(14)
    counts = [40e6 * rng.choice([1, 1.01, 0.98, 1000, 1100]) for _ in range(30)]
    rows = filed(counts)
    order = list(range(len(rows)))
    order[3], order[9], order[15], order[28] = order[28], order[15], order[9], order[3]
    source = str(tmp_path / "in")
    for k in range(0, 30, 6):
        spark.createDataFrame([rows[i] for i in order[k:k + 6]], FACTS).coalesce(1).write.mode("append").parquet(source)
        stream = guard.revised_filings_stream(spark.readStream.schema(FACTS).parquet(source), keep_days=100_000)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    judged = spark.read.parquet(str(tmp_path / "out"))
    got = guard.latest_verdicts(judged)
    want = guard.classify_filings(spark.createDataFrame(rows, FACTS))
    assert judged.count() > len(rows) == got.count()
    names = ["shares_filing_date", "guard_status", "prior_accepted_filing_date"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(map(tuple, want.select(names).collect()), key=str)
    frame = pd.DataFrame({"shares_filing_date": [date(2020, 1, 1), date(2021, 6, 1), date(2022, 1, 1)]})
    assert list(guard._later_than(frame, 365)) == [False, True, True]


def cap_inputs(spark):
    days = [date(2020, 1, 14), date(2020, 1, 15), date(2020, 2, 28), date(2021, 1, 14), date(2021, 1, 15), date(2021, 2, 27), date(2021, 3, 1)]
    px = spark.createDataFrame([(1, d, "T", 10.0, "primary", True) for d in days] + [(2, d, "U", 10.0, "primary", True) for d in days],
                               "security_id long, date date, ticker string, close double, source string, research_eligible boolean")
    effective = spark.createDataFrame([(t, f"{t}.US", date(2019, 12, 31), date(2020, 1, 15), n, "USD", date(2021, 3, 1), "vendor_balance_sheet") for t, n in (("T", 900.0), ("U", 700.0))],
                                      "ticker string, provider_symbol string, period_date date, filing_date date, shares_outstanding double, currency_symbol string, retrieved_at date, shares_source string")
    manual = spark.createDataFrame([(2, "U", date(2020, 2, 28), 555.0, date(2020, 2, 1), date(2020, 2, 20), "filing", "D", "U.US", date(2019, 12, 31), date(2020, 1, 15), 700.0)],
                                   "security_id long, ticker string, price_date date, sourced_shares double, shares_as_of_date date, source_publication_date date, source_name string, source_document_id string, target_provider_symbol string, target_period_date date, target_filing_date date, target_shares double")
    ident = spark.createDataFrame([("T", False), ("U", False)], "ticker string, ticker_identity_ambiguous boolean")
    factors = spark.createDataFrame([(s, d, 1.0, 1.0) for s in (1, 2) for d in [date(2019, 1, 1), *days]], "security_id long, date date, daily_split_ratio double, cumulative_split_multiplier double")
    calibration = spark.createDataFrame([], "security_id long, calibration_status string, comparable_snapshots long")
    resolution = spark.createDataFrame([(1, "T", "T common stock", "NYSE"), (2, "U", "U common stock", "NYSE")], "security_id long, ticker string, bronze_security_name string, resolved_exchange string")
    pairs = spark.createDataFrame([], "security_id_a long, security_id_b long")
    snapshots = spark.createDataFrame([("first", 1, date(2020, 2, 28), date(2020, 2, 28), "C", "I", 1200.0, 1.0)],
                                      "family string, security_id long, observation_date date, price_date date, security_code string, isin string, snapshot_closing_shares double, anchor_split_multiplier double")
    return [px, effective, manual, ident, factors, calibration, resolution, pairs, snapshots]


def test_market_cap_source_priority_and_carry(spark):
    inputs = cap_inputs(spark)
    got = {(r.security_id, r.date): (r.selected_source, r.selected_shares_candidate) for r in shares.daily_market_cap(*inputs).collect()}
    assert got[1, date(2020, 1, 14)] == ("no_eligible_share_source", None)
    assert got[1, date(2020, 1, 15)] == ("vendor", 900.0)
    assert got[1, date(2020, 2, 28)] == ("snapshot", 1200.0) == got[1, date(2021, 2, 27)]
    assert got[1, date(2021, 3, 1)] == ("no_eligible_share_source", None)
    # the sourced count fills its own day and rejects exactly one vendor row
    assert got[2, date(2020, 2, 28)] == ("manual_sourced", 555.0)
    assert got[2, date(2020, 1, 15)] == ("no_eligible_share_source", None)
    inputs[7] = spark.createDataFrame([(1, 2)], "security_id_a long, security_id_b long")
    assert {r.vendor_basis_status for r in shares.daily_market_cap(*inputs).where("vendor_filed_shares IS NOT NULL").collect()} == {"multi_issue_issuer_total"}


def test_filing_resolution(spark):
    schema = "f string, shares_as_of_date date, taxonomy string, concept string, class_member string, shares_outstanding double"
    cover, balance = filings.COVER, filings.BALANCE
    rows = [
        ("sum", D1, "dei", cover, "A", 10.0), ("sum", D1, "dei", cover, "B", 5.0), ("sum", D1, "dei", cover, "B", 5.0), ("sum", D2, "us-gaap", balance, None, 99.0),
        ("late", D1, "dei", cover, None, 1.0), ("late", D2, "dei", cover, None, 2.0), ("plain", D1, "us-gaap", balance, None, 7.0), ("plain", D1, "us-gaap", balance, "A", 3.0),
        ("clash", D1, "us-gaap", balance, None, 7.0), ("clash", D1, "us-gaap", balance, None, 8.0), ("classes", D1, "us-gaap", balance, "A", 3.0), ("classes", D1, "us-gaap", balance, "B", 4.0)]
    got = {r.f: (r.shares_outstanding, r.resolution_method, r.component_count) for r in filings.resolve_filing_shares(spark.createDataFrame(rows, schema), ["f"]).collect()}
    assert got == {"sum": (15.0, "dei_sum_classes", 2), "late": (2.0, "dei_single", 1), "plain": (7.0, "gaap_undimensioned", 1), "classes": (7.0, "gaap_sum_classes", 2)}


def test_class_evidence_directions(spark):
    schema = "cik string, class_member string, filing_date date, accession_number string, trading_symbol string, symbol_mapping_status string"
    m, n = "mapped_unique_symbol", "no_trading_symbol"
    rows = [("1", "A", D1, "a", "X", m), ("1", "A", D2, "b", None, n), ("1", "A", D3, "c", "x", m), ("2", "A", D1, "d", None, n), ("2", "A", D2, "e", "Y", m),
            ("3", "A", D2, "f", None, n), ("4", "A", D1, "g", "P", m), ("4", "A", D1, "h", "Q", m), ("4", "A", D2, "i", None, n), ("5", "A", D1, "j", "Z", m), ("5", "A", D2, "k", None, n)]
    got = {r.accession_number: (r.evidence_status, r.possible_symbol) for r in filings.class_symbol_evidence(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"b": ("bracketed_same_symbol", "X"), "d": ("later_evidence_only", "Y"), "f": ("no_symbol_evidence", None), "i": ("multiple_historical_symbols", None), "k": ("earlier_evidence_only", "Z")}


def test_perfect_ranking(spark):
    rows = [(s, date(2023, 1, 1) + timedelta(days=d), date(2023, 1, 2) + timedelta(days=d), s / 100, (s - 50) / 1000 + d * 1e-6, int(s > 50)) for d in range(20) for s in range(100)]
    df = spark.createDataFrame(rows, "security_id long, date date, target_end_date date, predicted_probability double, forward_relative_return double, target int")
    tables = crosssection.evaluate_cross_section(df, 1)
    statistics = {r.decile: r for r in tables["decile_statistics"].collect()}
    assert len(statistics) == 11 and statistics["D10-D1"].mean_period_return > 0
    assert tables["ranked"].groupBy("date", "decile").count().where("count <> 10").count() == 0
    assert tables["rank_ic_summary"].first().mean_ic == pytest.approx(1.0) and tables["rank_ic_summary"].first().hit_rate == 1.0
    assert tuple(tables["monotonicity"].first()) == (pytest.approx(1.0), True)
    index = {(r.series, r.date): r.index_level for r in crosssection.payoff_indices(tables["ranked"], 1).collect()}
    assert len({s for s, _ in index}) == 11 and index["D10", date(2023, 1, 1)] == 100.0
    last = date(2023, 1, 21)
    assert index["D10", last] > index["D1", last]
    growth = 100.0
    for d in range(20):
        growth *= 1 + sum((s - 50) / 1000 + d * 1e-6 for s in range(90, 100)) / 10
    assert index["D10", last] == pytest.approx(growth)


def test_probability_metrics_extremes(spark):
    good = spark.createDataFrame([(1, 1.0), (1, 0.9), (0, 0.1), (0, 0.0)], "y int, p double")
    assert metrics.evaluate_predictions(good, "y", "p").first().roc_auc == 1.0
    flat = metrics.evaluate_predictions(good.withColumn("p", F.lit(0.5)), "y", "p").first()
    assert flat.roc_auc == 0.5 and flat.brier_score == 0.25
    assert metrics.roc_auc(good.withColumn("y", F.lit(1)), "y", "p").first()[0] is None
    with pytest.raises(Exception, match="probability in"):
        metrics.probability_metrics(good.withColumn("p", F.lit(1.5)), "y", "p").collect()


def test_unequal_samples_are_not_compared(spark):
    a = spark.createDataFrame([("a", 10)], "model string, n long")
    with pytest.raises(Exception, match="row counts differ"):
        crosssection.compare_runs(a, spark.createDataFrame([("b", 11)], "model string, n long")).collect()


def test_quotas(spark):
    def quotas(rows, total):
        counts = spark.createDataFrame(rows, "calendar_year long, n long")
        return {r.calendar_year: r.quota for r in research.year_quotas(counts, total).collect()}

    assert quotas([(2000, 5), (2001, 100), (2002, 100)], 65) == {2000: 5, 2001: 30, 2002: 30}
    assert quotas([(2000, 5), (2001, 100), (2002, 100)], 90) == {2000: 5, 2001: 43, 2002: 42}
    assert quotas([(2000, 3), (2001, 2)], 100) == {2000: 3, 2001: 2}
    assert quotas([(2020, 100), (2021, 100), (2022, 100)], 90) == {2020: 30, 2021: 30, 2022: 30}
    assert sum(quotas([(y, 10) for y in range(7)], 31).values()) == 31
    assert quotas([(2000, 0), (2001, 9)], 2) == {2001: 2} and quotas([(2001, 4), (2002, 9)], 1) == {2001: 1}
    with pytest.raises(ValueError):
        quotas([(2000, 1)], 0)


def test_free_codes_and_reconcile(spark):
    wanted = spark.createDataFrame([("r1", "AA"), ("r2", "AA"), ("r3", "BB")], "component_root string, latest_ticker string")
    used = spark.createDataFrame([("AA_1",), ("AA_3",), ("AA_x",)], "lineage_code string")
    got = {r.component_root: r.lineage_code for r in identity.free_suffix_codes(wanted, used).collect()}
    assert got == {"r1": "AA_2", "r2": "AA_4", "r3": "BB_1"}


def test_boundary_and_uniqueness_checks(spark):
    df = spark.createDataFrame([(1, D1, D2), (1, D1, D4)], "security_id long, date date, target_end_date date")
    with pytest.raises(QualityError, match="label_outside"):
        assert_rules(df, leakage_rules("2020-06-01", "2020-06-17"))
    with pytest.raises(QualityError, match="duplicate"):
        assert_unique(df, ["security_id", "date"])


def test_override_seed_is_whole_and_resolvable(spark):
    from marketspark.plans.override_seed import override_seed

    seed = override_seed(spark)
    assert seed.count() == 47 and seed.dropDuplicates(["ticker", "event_date"]).count() == 47
    spans = seed.select(F.concat("ticker", F.lit("_E001")).alias("ticker_episode_id"), F.col("ticker").alias("act_symbol"),
                        F.lit("2000-01-01").cast("date").alias("start_date"), F.lit("2030-01-01").cast("date").alias("end_date")).distinct()
    owners = spans.select("ticker_episode_id", F.crc32("ticker_episode_id").alias("security_id"))
    empty = seed.limit(0).select(F.lit(0).cast("long").alias("security_id"), "*")
    assert actions.corporate_action_overrides(empty, seed, spans, owners).count() == 47


def _rebuild_inputs(spark):
    days = [date(2022, 1, 3) + timedelta(days=i) for i in range(12)]
    px = spark.createDataFrame([(s, d, 10.0 + s + i * (s + 1) / 10, 100 + i) for s in (1, 2) for i, d in enumerate(days)], "security_id long, date date, close double, volume long")
    px = px.withColumns({c: F.col("close") for c in ("open", "high", "low")} | {
        "ticker": F.concat(F.lit("T"), F.col("security_id")), "source": F.lit("primary"), "source_symbol": F.lit("T"), "source_lookup_method": F.lit("native"),
        "reconciliation_status": F.lit("native"), "observation_type": F.lit("native"), "research_eligible": F.lit(True)})

    def none(schema):
        return spark.createDataFrame([], schema)

    universe = px.select("security_id", "date", F.lit(True).alias("primary_research_eligible_broad"), F.lit(True).alias("primary_research_eligible_exchange"))
    return px, days, {
        "security_daily_ohlcv": px, "trading_calendar": px.select(F.col("date").alias("session_date")).distinct(), "research_universe_eligibility": universe,
        "automatic_price_correction": none("security_id long, correction_date date, open double, high double, low double, close double, volume long, provider_symbol string"),
        "security_split_event": spark.createDataFrame([(1, days[5], 1.5)], "security_id long, split_date date, split_ratio double"),
        "corporate_action_override": none(OVERRIDE), "automatic_split_backfill": none("security_id long, split_date date, split_ratio double"),
        "security_dividend_candidate": none("security_id long, ticker string, ex_date date, amount double, validation_status string"),
        "automatic_dividend_correction": none("security_id long, event_date date, corrected_dividend_amount double"),
        "extreme_return_diagnostic": none("security_id long, date date, diagnostic_class string, price_level_diagnostic string"),
        "security_master": px.select("security_id").distinct(),
    }


def test_rebuild_writes_checked_tables(spark, tmp_path):
    from marketspark.plans.rebuild import STEPS, needed_steps, rebuild

    px, days, inputs = _rebuild_inputs(spark)
    steps = needed_steps(["research_feature_label_model"], inputs)
    built = rebuild(inputs, str(tmp_path), steps=steps)
    assert built["security_daily_return"].where("research_eligible").count() == 22
    model = {(r.security_id, r.date): r for r in built["research_feature_label_model"].collect()}
    assert len(STEPS) == 40 and model[1, days[5]].lag_1d_gtr > 0.4 and model[2, days[1]].target_end_date_5d == days[6]
    assert set(built.actions.values()) == {"built"} and len(built.actions) == len(steps)
    fewer = px.where(F.col("date") < days[8])
    with pytest.raises(QualityError, match="rows moved"):
        rebuild(inputs | {"security_daily_ohlcv": fewer}, str(tmp_path), drift=0.01, steps=steps)
    with pytest.raises(QualityError, match="orphan"):
        rebuild(inputs | {"security_master": px.select("security_id").distinct().limit(1)}, str(tmp_path / "orphan"), steps=steps)
    with pytest.raises(ValueError, match="neither inputs nor built"):
        rebuild(inputs, str(tmp_path / "none"))


def test_broken_rebuild_goes_on_where_it_stopped(spark, tmp_path):
    from marketspark.plans.rebuild import needed_steps, rebuild, table_digest

    px, days, inputs = _rebuild_inputs(spark)
    steps = needed_steps(["research_feature_label_model"], inputs)
    names = [s.name for s in steps]

    def stop(step):
        if step.name == "security_gtr_index":
            raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        rebuild(inputs, str(tmp_path), steps=steps, before_step=stop)
    resumed = rebuild(inputs, str(tmp_path), steps=steps)
    at = names.index("security_gtr_index")
    assert [resumed.actions[n] for n in names] == ["kept"] * at + ["built"] * (len(names) - at)
    again = rebuild(inputs | {"security_daily_ohlcv": px.repartition(3)}, str(tmp_path), steps=steps)
    assert set(again.actions.values()) == {"kept"}, "the order of rows does not matter"
    # a changed input rebuilds what reads it, and what reads that
    changed = inputs | {"extreme_return_diagnostic": spark.createDataFrame(
        [(1, days[4], "vendor_confirms_extreme_after_adjustment", "x")], inputs["extreme_return_diagnostic"].schema)}
    third = rebuild(changed, str(tmp_path), steps=steps)
    assert third.actions["security_daily_return"] == "kept" and third.actions["security_daily_return_research"] == "built"
    fresh = rebuild(changed, str(tmp_path / "fresh"), steps=steps)
    assert {n: table_digest(third[n]) for n in names} == {n: table_digest(fresh[n]) for n in names} == {n: fresh.digests[n] for n in names}


def test_steps_read_only_what_comes_before():
    from marketspark.plans.rebuild import STEPS, needed_steps

    seen = set()
    for step in STEPS:
        later = {s.name for s in STEPS} - seen
        assert not set(step.reads) & later, step.name
        seen.add(step.name)
    assert [s.name for s in needed_steps(["security_split_event"])] == ["security_split_candidate", "split_full_history_comparison", "security_split_event"]


def test_sample_by_hash_groups_equals_plain_ranks(spark, tmp_path):
    import hashlib

    rows = [(s, date(2000 + s % 4, 1, 1) + timedelta(days=i), s % 2, 0.5) for s in range(40) for i in range(30 if s % 4 else 3)]
    pool = spark.createDataFrame(rows, "security_id long, date date, target int, x double")
    quotas = research.year_quotas(research.candidate_counts(pool), 400)
    wanted = {r.calendar_year: r.quota for r in quotas.collect()}
    assert wanted == {2000: 30, 2001: 124, 2002: 123, 2003: 123}

    def key(r):
        return (hashlib.md5(f"{r[0]}|{r[1]}|s|5".encode()).hexdigest(), r[0], r[1])

    want = [r for year, n in wanted.items() for r in sorted((r for r in rows if r[1].year == year), key=key)[:n]]
    got = research.hash_sample(pool, quotas, 5, "s")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    manifest = {r.calendar_year: r for r in research.export_sample(pool, str(tmp_path), 400, 5, "s").collect()}
    assert {y: (m.quota, m.rows, m.candidate_rows) for y, m in manifest.items()} == {2000: (30, 30, 30), 2001: (124, 124, 300), 2002: (123, 123, 300), 2003: (123, 123, 300)}
    assert manifest[2001].sampling_seed == "s" and manifest[2001].securities == 10
    assert spark.read.parquet(f"{tmp_path}/5d/train").count() == 400


def test_one_documented_change_counts_per_class_and_date(spark):
    facts = [("1", "A", f"f{i}", date(2020, m, 1), "no_trading_symbol", None) for i, m in enumerate((1, 3, 5, 9))]
    rows = spark.createDataFrame(facts, "cik string, class_member string, accession_number string, filing_date date, symbol_mapping_status string, trading_symbol string")
    changes = spark.createDataFrame([("1", "A", date(2020, 2, 1), "W", "X"), ("1", "A", date(2020, 4, 1), "X", "Y"), ("1", "A", date(2020, 8, 1), "Y", "Z")],
                                    "cik string, class_member string, change_date date, symbol_before string, symbol_after string")
    got = sorted((r.accession_number, r.possible_symbol) for r in filings.class_symbol_evidence(rows, changes).collect())
    assert got == [("f0", "W"), ("f1", "X"), ("f2", "Y"), ("f3", "Z")]


def test_bad_model_rows_are_refused(spark):
    from marketspark.plans import models

    good = [(1, D1, "T", D2, 0.1, 1, 1.0, 2.0), (2, D1, "T", D2, -0.1, 0, 3.0, 4.0)]
    schema = "security_id long, date date, ticker string, target_end_date date, forward_relative_return double, target int, a double, b double"
    rows = spark.createDataFrame(good, schema)
    assert models.validate_sample(rows, ["a", "b"], "2020-01-01", "2020-12-31") is rows
    with pytest.raises(QualityError, match="b_not_finite"):
        models.fit_logistic(rows.withColumn("b", F.when(F.col("security_id") == 1, float("inf")).otherwise(F.col("b"))), ["a", "b"])
    with pytest.raises(QualityError, match="a_not_finite"):
        models.fit_gbt(rows.withColumn("a", F.lit(None).cast("double")), ["a", "b"])
    with pytest.raises(QualityError, match="target_not_0_or_1"):
        models.fit_gbt(rows.withColumn("target", F.lit(2)), ["a", "b"])
    with pytest.raises(QualityError, match="missing columns: c"):
        models.validate_model_rows(rows, ["c"])
    with pytest.raises(QualityError, match="split_label_outside"):
        models.validate_sample(rows.withColumn("target_end_date", F.lit("2021-01-02").cast("date")), ["a"], "2020-01-01", "2020-12-31")


def test_sample_summary_reads_the_whole_pool(spark, monkeypatch):
    from marketspark.catalog import registry, research

    rows = spark.range(900).select(
        F.col("id").alias("security_id"), F.lit("1999-01-04").cast("date").alias("date"), (F.col("id") % 3 == 0).cast("int").alias("target"))
    monkeypatch.setattr(research, "pool", lambda v: rows)
    found = registry.QUERIES["rs11_sample_summary"](spark, "unused").first()
    assert (found["rows"], found["securities"]) == (900, 900) and abs(found["positive_rate"] - 1 / 3) < 1e-5


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equal_sourced_counts_and_names_are_one_counted_row(spark):
    """Equal sourced counts of a day and equal names multiply the rows of the plain table; the counted one keeps one and every figure."""
    inputs = cap_inputs(spark)
    inputs[1] = inputs[1].unionByName(inputs[1].withColumns({"filing_date": F.lit(date(2020, 2, 1)), "shares_outstanding": F.col("shares_outstanding") * 1000}))
    inputs[2] = inputs[2].where("FALSE").unionByName(spark.createDataFrame(
        [(1, "T", d, 555.0, d, date(2018, 1, 1), "filing", "D", f"X{k}", date(2019, 1, 1), date(2019, 2, 1), float(k)) for d in (date(2020, 1, 15), date(2021, 1, 14)) for k in range(5)], inputs[2].schema))
    inputs[6] = inputs[6].unionByName(inputs[6])
    inputs[8] = inputs[8].where("FALSE")
    counted, plain = shares.counted_market_cap(*inputs), shares.daily_market_cap(*inputs)
    assert counted.count() == 14 and plain.count() == 2 * (14 + 2 * 4)
    assert rows_of(shares.repeated(counted)) == rows_of(plain)
    results = []
    for caps in (stage(counted), stage(plain)):
        guard_rows = stage(shares.guard_observations(caps))
        impact = stage(shares.guard_impact(caps, guard_rows))
        after = stage(shares.apply_guard(caps, impact))
        results.append([rows_of(shares.repeated(x)) for x in (
            guard_rows, impact, after, shares.anomaly_audit(after), shares.source_counts(after), shares.jump_review(after, guard_rows, impact),
            shares.market_cap_closure(after, inputs[6]), shares.basis_impact(after), shares.known_cases(after, caps.select("security_id", "date")))])
    assert results[0] == results[1] and results[0][1] and results[0][5]


def test_multi_listed_securities_without_pairs(spark):
    rng = random.Random(5)
    days = []
    for security in range(60):
        for ticker in range(rng.randint(1, 2)):
            first = rng.randint(0, 4000)
            days += [(security, date.fromordinal(730000 + d), f"t{security}{ticker}", True) for d in (first, first + rng.randint(0, 400))]
    universe = spark.createDataFrame(days, "security_id long, date date, ticker string, primary_research_eligible_exchange boolean")
    issuers = universe.select(F.col("security_id").alias("_s"), F.upper("ticker").alias("ticker")).distinct().select((F.col("_s") % 7).cast("string").alias("cik"), "ticker")
    pairs = reference.multi_listed_pairs(universe, issuers)
    want = {r[0] for r in pairs.select("security_id_a").union(pairs.select("security_id_b")).collect()}
    got = [r[0] for r in reference.multi_listed_securities(universe, issuers).collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < 60


def test_reference_candidates_per_ticker(spark):
    returns = spark.createDataFrame([(s, t, D1) for s, t in ((1, "A"), (2, "A"), (3, "B"), (None, "A"))], "security_id long, ticker string, date date")
    references = spark.createDataFrame([("A", "ETF", "X", "I1", False), ("a", "ETF", "Y", "I2", True), ("B_OLD", "FUND", "X", "I3", True)],
                                       "code string, instrument_type string, exchange string, isin string, is_delisted boolean")
    manual = spark.createDataFrame([], "ticker string, instrument_type string")
    listed = reference.symbol_fallback(spark.createDataFrame([], "act_symbol string, security_name string, listing_exchange string, is_etf int, is_test_issue int, last_seen date"))
    one = reference.ticker_candidates(returns, references)
    assert one.count() == 3  # each ticker once, whatever its securities
    plain = reference.ticker_reference_resolution(returns, manual, reference.reference_candidates(returns, references), listed)
    assert rows_of(reference.ticker_reference_resolution(returns, manual, one, listed).select(*plain.columns)) == rows_of(plain)


def test_overlap_around_single_matches_gives_the_same_snapshots(spark):
    day = date(2020, 2, 27)
    ids = spark.createDataFrame([(day, f"C{k}", "candidate_exact_code_name", isin, 1.0, 1.0) for k, isin in enumerate(["I1", "I2", "I2", "I3", "I4"])],
                                "observation_date date, security_code string, identity_status string, isin string, shares_today double, closing_shares double")
    held = [(1, "T1", "I1"), (2, "T2", "I2"), (3, "T3", "I2"), (4, "T4", "I3"), (4, "T5", "I4")]
    universe = spark.createDataFrame([(s, day, t, i, True) for s, t, i in held], "security_id long, date date, ticker string, isin string, primary_research_eligible_exchange boolean")
    prices = spark.createDataFrame([(s, day, t, 5.0) for s, t, _ in held], "security_id long, date date, ticker string, close double")
    factors = spark.createDataFrame([(s, day, 1.0, 1.0) for s in (1, 2, 3, 4)], "security_id long, date date, daily_split_ratio double, cumulative_split_multiplier double")
    found = []
    for single in (False, True):
        rows = shares.priced_overlap(ids, universe, prices, around_single=single)
        audit = rows.withColumns({"closing_share_variants": F.lit(1), "snapshot_closing_shares": F.lit(9.0)})
        found.append((rows, rows_of(shares.preferred_snapshots({"first": audit}, factors).select("security_id", "security_code"))))
    assert found[0][0].count() == 7 and found[1][0].count() == 3
    assert found[0][1] == found[1][1] == [(1, "C0")]
