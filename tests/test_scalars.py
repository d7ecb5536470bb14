from pyspark.sql import functions as F

from marketspark.functions import scalars as S
from marketspark.functions.text import name_similarity


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_isin(spark):
    codes = ["US0378331005", "US0378331006", "us0378331005", "GB0002634946", "XX", ""]
    df = spark.createDataFrame([(c,) for c in codes] + [(None,)], "c string")
    assert [r.v for r in df.select(S.valid_isin("c").alias("v")).collect()] == [True, False, False, True, False, False, None]


def test_ratio_text(spark):
    df = spark.createDataFrame([("2/1",), ("1/0",), ("0/3",), ("x",), ("3/2/1",), (None,)], "t string")
    got = [r.r and (r.r.to_factor, r.r.for_factor, r.r.ratio) for r in df.select(S.parse_ratio("t").alias("r")).collect()]
    assert got == [(2.0, 1.0, 2.0), None, None, None, None, None]


def test_symbols_and_keys(spark):
    assert one(spark, S.symbol_candidates(F.lit("brk.b")), S.symbol_candidates(F.lit("IBM"))) == (["BRK.B.US", "BRK-B.US"], ["IBM.US"])
    assert one(spark, S.normalize_cik(F.lit("CIK320193")), S.canonical_code(F.lit("abc-d_old12"))) == ("0000320193", "ABC.D")
    assert one(spark, S.strip_market_suffix(F.lit("x.us"))) == ("X",)


def test_bars(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 0.5, 1.5, 3), (1.0, 1.2, 0.5, 1.5, 3), (1.0, 1.0, 1.0, 1.0, 0), (1.0, 2.0, None, 1.5, 3)],
        "open double, high double, low double, close double, volume long")
    assert [tuple(r) for r in df.select(S.valid_bar(), S.flat_zero_volume()).collect()] == [
        (True, False), (False, False), (True, True), (False, False)]


def test_instrument_wording(spark):
    cases = [
        ("A$B", "x common stock", "Preferred Stock"), ("AB.WS", "x", "Warrant"), ("AB.W", "x", "Warrant"), ("AB.U", "x", "Unit"), ("AB.R", "x", "Right"),
        ("AB", "Acme Preferred Stock", "Preferred Stock"), ("AB", "Acme Common Stock (Preferred Stock parent)", "Common Stock"),
        ("AB", "Acme - Warrants (exp 2030)", "Warrant"), ("AB", "Acme Units, one share", "Unit"), ("AB", "Acme Rights", "Right"),
        ("AB", "Acme ETN linked", "ETN"), ("AB", "Acme 5% Notes due 2030", "Notes"), ("AB", "Acme Closed End Fund", "FUND"),
        ("AB", "Acme American Depositary Shares", "Common Stock"), ("AB", "Acme when issued", "When-Issued"), ("AB", "Acme", None),
    ]
    df = spark.createDataFrame([(a, b, 0, 0) for a, b, _ in cases], "s string, n string, e int, t int")
    assert [r[0] for r in df.select(S.classify_instrument("s", "n", "e", "t")).collect()] == [c for _, _, c in cases]


def test_names_that_agree_score_one(spark):
    a = spark.createDataFrame([("k", "Apple, Inc."), ("k", "Zebra"), ("m", "abcd")], "key string, x string")
    b = spark.createDataFrame([("k", "APPLE INC"), ("m", "abxd")], "key string, y string")
    got = {r.key: r.best_name_similarity for r in name_similarity(a, b, "key", "x", "y").collect()}
    assert got == {"k": 1.0, "m": 0.75}
