"""Scoring and classification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.stats import exact_quantiles
from keelson.functions.tiers import portfolio_tier, request_tier
from keelson.plans.materialize import materialize

# Score weights and the request-path normalisers (~p99 of training data).
W_PROB, W_MAG, W_EXT = 0.5, 0.3, 0.2
REQUEST_DAYS_P99 = 12.0
REQUEST_EXT_P99 = 0.95


def round_half_even(x: Column, digits: int) -> Column:
    """numpy/pandas ``round``: rint(x * 10^d) / 10^d."""
    scale = float(10 ** digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def _clip01(c: Column) -> Column:
    """c within [0, 1]; null stays null (greatest and least would pass over it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def _raw_score(p: Column, mag: Column, ext: Column) -> Column:
    return (F.lit(W_PROB) * p + F.lit(W_MAG) * mag + F.lit(W_EXT) * ext) * F.lit(100.0)


def portfolio_score(df: DataFrame, p: str = "Predicted_Delay_Probability",
                    days: str = "Predicted_Delay_Days", ext: str = "External_Risk_Pressure") -> DataFrame:
    """D1 + D2: score against whole-table p99s (1-row statistics), then right-closed tier.

    Adds ``Shipment_Risk_Score`` (1 dp), ``Risk_Score_Tenths`` (exact integer grid
    for order-independent sums) and ``Risk_Tier``.  A zero p99 gives a null score.
    """
    q = materialize(exact_quantiles(df, {"_p99_days": (days, 0.99), "_p99_ext": (ext, 0.99)}), "score-p99")
    d = df.crossJoin(F.broadcast(q))
    mag = _clip01(F.try_divide(F.col(days).cast("double"), F.col("_p99_days")))
    extn = _clip01(F.try_divide(F.col(ext).cast("double"), F.col("_p99_ext")))
    tenths = F.rint(_raw_score(F.col(p), mag, extn) * F.lit(10.0))
    return (d.withColumn("Risk_Score_Tenths", tenths.cast("bigint"))
            .withColumn("Shipment_Risk_Score", tenths / F.lit(10.0))
            .withColumn("Risk_Tier", portfolio_tier(F.col("Shipment_Risk_Score")))
            .drop("_p99_days", "_p99_ext"))


def request_score(p: Column, days: Column, ext: Column) -> Column:
    """D3: fixed divisors 12.0 and 0.95, upper clip only; rounded to 1 dp."""
    mag = F.least(days / F.lit(REQUEST_DAYS_P99), F.lit(1.0))
    extn = F.least(ext / F.lit(REQUEST_EXT_P99), F.lit(1.0))
    return round_half_even(_raw_score(p, mag, extn), 1)


def score_requests(df: DataFrame, p: str = "probability", days: str = "expected_delay_days",
                   ext: str = "External_Risk_Pressure") -> DataFrame:
    """D3 + D4 over a table of request rows."""
    s = request_score(F.col(p), F.greatest(F.col(days), F.lit(0.0)), F.col(ext))
    return df.withColumn("risk_score", s).withColumn("risk_tier", request_tier(F.col("risk_score")))


def model_agreement(p1: Column, p2: Column) -> Column:
    """Agreement label from the gap between two model probabilities."""
    gap = F.abs(p1 - p2)
    return F.when(gap < 0.15, "Close").when(gap < 0.40, "Some Disagreement").otherwise("High Disagreement")


def needs_review(p1: Column, p2: Column) -> Column:
    return F.abs(p1 - p2) >= 0.40


# Underwriting note texts.
NOTE_HAIRCUT = ("Underwriting note: this shipment profile falls in the High/Severe risk band — consider a "
                "collateral haircut or margin adjustment before extending trade finance against it.")
NOTE_STANDARD = ("Underwriting note: this shipment profile falls in the Low/Medium risk band — standard "
                 "terms are reasonable.")


def underwriting_note(tier: Column) -> Column:
    """High/Severe -> haircut note, else standard terms."""
    return F.when(tier.isin("High", "Severe"), F.lit(NOTE_HAIRCUT)).otherwise(F.lit(NOTE_STANDARD))


def clean_feature_label(name: Column) -> Column:
    """Strip ``num__`` / ``cat__`` prefixes, underscores to spaces."""
    return F.replace(F.replace(F.replace(name, F.lit("num__"), F.lit("")), F.lit("cat__"), F.lit("")),
                     F.lit("_"), F.lit(" "))


# Memo recommendation sentences by tier.
REC_HIGH = ("Recommendation: apply a risk-adjusted collateral haircut or margin before extending trade "
            "finance against this shipment, and consider requiring proof of alternate routing contingency.")
REC_MEDIUM = "Recommendation: standard terms with routine monitoring are likely adequate."
REC_LOW = "Recommendation: standard underwriting terms are appropriate; no additional haircut indicated."
MEMO_DRIVERS = 3


def one_decimal(x: Column) -> Column:
    """``format_string('%.1f', round_half_even(x, 1))``, which is slow, from whole tenths where these are exact."""
    tenths = F.rint(x * F.lit(10.0))
    whole = tenths.cast("bigint")
    plain = F.concat(F.floor(whole / F.lit(10)).cast("string"), F.lit("."), (whole % F.lit(10)).cast("string"))
    return (F.when((x > 0) & (tenths < 1e14), plain).when(x == 0, x.cast("double").cast("string"))
            .otherwise(F.format_string("%.1f", round_half_even(x, 1))))


def underwriting_memo(desc: Column, tier: Column, prob: Column, days: Column, hist_rate_pct: Column,
                      contributions: Column, top_n: int = MEMO_DRIVERS) -> Column:
    """Memo text per row.

    ``contributions`` is an array<struct<feature string, value double>>; the top
    ``top_n`` by absolute value are split into up- and down-drivers.
    ``hist_rate_pct`` is the tier's historical delay rate in percent (from E4).
    """
    ranked = F.sort_array(F.transform(contributions, lambda s: F.struct((-F.abs(s["value"])).alias("k"), s["feature"].alias("feature"),
                                                                        s["value"].alias("value"))))
    top = F.slice(ranked, 1, top_n)
    up = F.transform(F.filter(top, lambda s: s["value"] > 0), lambda s: clean_feature_label(s["feature"]))
    down = F.transform(F.filter(top, lambda s: s["value"] < 0), lambda s: clean_feature_label(s["feature"]))
    rate_txt = F.when(hist_rate_pct.isNull(), F.lit("n/a")).otherwise(F.concat(one_decimal(hist_rate_pct), F.lit("%")))
    null = F.lit("null")
    head = F.concat(F.lit("Shipment ("), F.coalesce(desc, null), F.lit(") is scored in the **"), F.coalesce(F.upper(tier), null),
                    F.lit("** risk tier, with a predicted delay probability of "), one_decimal(prob * 100),
                    F.lit("% and an expected delay of "), one_decimal(days),
                    F.lit(" day(s). Historically, shipments in the "), F.coalesce(tier, null), F.lit(" tier were delayed "), rate_txt, F.lit(" of the time."))
    # no drivers: an empty join is null, and so is its sentence; asking for the size would sort every row's array again
    up_txt = F.concat(F.lit("Risk is primarily driven up by: "), F.nullif(F.array_join(up, ", "), F.lit("")), F.lit("."))
    down_txt = F.concat(F.lit("Risk is partially offset by: "), F.nullif(F.array_join(down, ", "), F.lit("")), F.lit("."))
    rec = F.when(tier.isin("High", "Severe"), F.lit(REC_HIGH)).when(tier == "Medium", F.lit(REC_MEDIUM)) \
        .otherwise(F.lit(REC_LOW))
    return F.concat_ws(" ", head, up_txt, down_txt, rec)
