"""Column functions and small aggregates of the analytics over predictions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(hits: F.Column, total: F.Column) -> tuple[F.Column, F.Column]:
    """The 95 % interval's ends; null for no total, or hits beyond it."""
    p, z2 = hits / total, Z * Z
    middle, spread, scale = p + z2 / (2 * total), Z * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)), 1 + z2 / total
    ok = (total > 0) & (hits >= 0) & (hits <= total)
    return F.when(ok, (middle - spread) / scale), F.when(ok, (middle + spread) / scale)


def score_bin(score: F.Column, bins: int = 10) -> F.Column:
    """Equal-width bins; 1 belongs to the last; null stays null."""
    return F.when(score.isNotNull(), F.least(F.lit(bins - 1), F.floor(score * bins))).cast("int")


def fixed_bin(value: F.Column, edges: tuple[int, ...] = (60, 300, 900, 3600)) -> F.Column:
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")


def histogram(rows: DataFrame, bin_: F.Column, bins: int) -> DataFrame:
    """bin, rows; empty bins are there too. The list of bins is fixed and short."""
    all_ = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return F.broadcast(all_).join(rows.groupBy(bin_.alias("bin")).agg(F.count("*").alias("rows")), "bin", "left").select("bin", F.coalesce("rows", F.lit(0)).alias("rows"))


def margin(candidates: DataFrame, by: str = "key_image", score: str = "score") -> DataFrame:
    """by, top1, top2, margin, candidates: the two best scores."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score)))
    per = candidates.withColumn("place", rank).groupBy(by).agg(F.max(F.when(F.col("place") == 1, F.col(score))).alias("top1"), F.max(F.when(F.col("place") == 2, F.col(score))).alias("top2"), F.count("*").alias("candidates"))
    return per.withColumn("margin", F.col("top1") - F.col("top2"))


def outcome(verified: str = "verified", correct: str = "correct") -> F.Column:
    """correct, wrong, pending or unknown; what isn't known is never wrong."""
    v, c = F.col(verified), F.col(correct)
    return F.when(~v, "pending").when(v & c, "correct").when(v & ~c, "wrong").otherwise("unknown")


def valid_score(score: str = "confidence") -> F.Column:
    c = F.col(score)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & c.between(0, 1), F.lit(False))


def summary(rows: DataFrame, threshold: float) -> DataFrame:
    """confidence, verified, correct -> counts of outcomes; unknown is never wrong, and no score is below a threshold."""
    c = F.col
    count = lambda e, name: F.count_if(e).alias(name)
    on = c("confidence") >= threshold
    return rows.agg(
        F.count("*").alias("total"), count(on, "retained"), count(c("confidence") < threshold, "below"), count(c("confidence").isNull(), "unknown_score"), count(on & c("verified") & (c("correct") == F.lit(True)), "correct"),
        count(on & c("verified") & (c("correct") == F.lit(False)), "wrong"), count(on & ~c("verified"), "pending"), count(on & c("verified") & c("correct").isNull(), "unknown"),
    )


def summarized(rows: DataFrame, by: list[str], denominator: int | None = None) -> DataFrame:
    """Per group of rows (confidence, accepted, verified, correct): counts of acceptance and outcome, coverage of the
    denominator (all rows where none is given), verified share, accuracy and its 95 % interval; shares of nothing are null."""
    out = rows.withColumn("outcome", outcome())
    count = lambda e, name: F.count_if(e).alias(name)
    a = F.col("accepted")
    per = out.groupBy(*by).agg(F.count("*").alias("total"), count(a, "n_accepted"), count(~a, "below_run_threshold"), count(a.isNull(), "acceptance_unknown"), *(count(F.col("outcome") == o, o) for o in ("correct", "wrong", "pending", "unknown")), count(~valid_score(), "unknown_scores"))
    whole = F.lit(denominator) if denominator is not None else F.sum("total").over(Window.partitionBy())  # a row a group
    per = per.withColumn("n_verified", F.col("correct") + F.col("wrong")).withColumn("coverage", F.col("total") / F.nullif(whole, F.lit(0)))
    low, high = wilson(F.col("correct"), F.col("n_verified"))
    return per.withColumns({"verified_share": F.col("n_verified") / F.col("total"), "accuracy": F.col("correct") / F.nullif(F.col("n_verified"), F.lit(0)), "low": F.when(low.isNotNull(), F.greatest(F.lit(0.0), low)), "high": F.when(high.isNotNull(), F.least(F.lit(1.0), high))})


def csv_safe(column: F.Column) -> F.Column:
    """Text that no spreadsheet takes for a formula."""
    text = column.cast("string")
    return F.when(text.rlike(r"^[\s]*[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def decimal_places(atomic: F.Column, places: int = 12) -> F.Column:
    """An integer of atomic units as a decimal text without loss."""
    digits = F.lpad(F.abs(atomic.cast("decimal(38,0)")).cast("string"), places + 1, "0")
    size = F.length(atomic.cast("decimal(38,0)").cast("string"))
    wide = F.when(size > places + 1, F.abs(atomic.cast("decimal(38,0)")).cast("string")).otherwise(digits)
    n = F.length(wide)
    return F.concat(F.when(atomic < 0, "-").otherwise(""), F.substring(wide, F.lit(1), n - places), F.lit("."), F.substring(wide, n - places + 1, F.lit(places)))


def fee_density(fee: str, weight: str) -> F.Column:
    """Fee for each unit of weight with two decimals, by integer division, as text; null where either is unknown or the weight
    is 0, and <0.01 for a fee that rounds to nothing."""
    f, w = F.col(fee).cast("decimal(20,0)"), F.nullif(F.col(weight).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    times = (f * F.lit(100).cast("decimal(3,0)")).cast("decimal(23,0)")
    hundredths = ((times - times % w) / w).cast("decimal(38,0)")  # without its remainder the division is exact
    text = decimal_places(hundredths, 2)
    return F.when(f.isNotNull() & (w > 0), F.when((hundredths == 0) & (f > 0), "<0.01").otherwise(text))


def duration(seconds: F.Column) -> F.Column:
    """Seconds as text: 5.0 s, 42 s, 3m 5s, 2h 1m, 4d 2h; Unknown for null or negative."""
    whole = lambda x: F.floor(x).cast("long").cast("string")
    part = lambda big, small, a, b: F.concat(whole(seconds / big), F.lit(a), F.lit(" "), whole((seconds % big) / small), F.lit(b))
    text = F.when(seconds < 10, F.format_string("%.1f s", seconds.cast("double"))).when(seconds < 60, F.concat(F.floor(seconds + 0.5).cast("long").cast("string"), F.lit(" s"))).when(seconds < 3600, part(60, 1, "m", "s")).when(seconds < 86400, part(3600, 60, "h", "m")).otherwise(part(86400, 3600, "d", "h"))
    return F.when(seconds.isNull() | (seconds < 0) | F.isnan(seconds.cast("double")), "Unknown").otherwise(text)


def origin(url: F.Column) -> F.Column:
    """scheme://host:port of an address, without user, path or query; null for no http address."""
    scheme, host, port = (F.regexp_extract(url, r"^(https?)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]+)(?::([0-9]+))?(?=[/?#]|$)", k) for k in (1, 2, 3))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), F.lower(host), F.when(port != "", F.concat(F.lit(":"), port)).otherwise("")))


def finite_tag(value: F.Column) -> F.Column:
    """nan, +inf or -inf of a value that strict JSON can't hold; null for any other."""
    return F.when(F.isnan(value), "nan").when(value == float("inf"), "+inf").when(value == float("-inf"), "-inf")


def feature_quality(rows: DataFrame) -> DataFrame:
    """rows of a profile (candidates, finite, missing, nonfinite, nonnumeric, distinct, constant) with quality: unavailable,
    incomplete, constant or varying."""
    counts = ("candidates", "finite", "missing", "nonfinite", "nonnumeric")
    bad = sum(((F.col(c).isNull() | (F.col(c) < 0)).cast("int") for c in counts), F.lit(0)) > 0
    invalid = F.col("missing") + F.col("nonfinite") + F.col("nonnumeric")
    odd = F.col("distinct").isNull() | (F.col("distinct") < 1) | (F.col("distinct") > F.col("finite"))
    state = (
        F.when(bad | (F.col("finite") + invalid != F.col("candidates")) | (F.col("finite") == 0), "unavailable").when(invalid > 0, "incomplete").when(odd, "unavailable").when((F.col("distinct") == 1) & F.col("constant"), "constant").when((F.col("distinct") > 1) & ~F.col("constant"), "varying").otherwise("unavailable")
    )
    return rows.withColumn("quality", state)


def find_features(rows: DataFrame, query: str = "", state: str = "all") -> DataFrame:
    """Features whose name, with spaces for underscores, holds the query, and that have the state."""
    name = F.regexp_replace(F.lower("feature"), "_", " ")
    out = rows.where(name.contains(query.strip().lower().replace("_", " ")))
    return out if state == "all" else out.where(F.col("quality") == state)


def folded(column: F.Column) -> F.Column:
    """NFKC, case folded, white space collapsed; the one text function that Spark lacks."""

    @F.pandas_udf("string")
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))

    return fold(column)


def freshness(age: F.Column, interval: int) -> F.Column:
    """recent, stale or clock_mismatch of an age in seconds."""
    return F.when(age < -60, "clock_mismatch").when(age <= max(600, 3 * interval), "recent").otherwise("stale")


def paired_holds() -> F.Column:
    """Of a published comparison (rings, both, first_only, second_only, neither, net, agreement_first, agreement_second): whether
    its cells make up the rings, and the net change and both rates follow from them."""
    c = F.col
    cells = c("both") + c("first_only") + c("second_only") + c("neither")
    rate = lambda only, said: F.abs((c("both") + c(only)) / F.nullif(c("rings"), F.lit(0)) - c(said)) < 1e-10
    return F.coalesce((cells == c("rings")) & (c("net") == c("second_only") - c("first_only")) & rate("first_only", "agreement_first") & rate("second_only", "agreement_second"), F.lit(False))


def baseline_holds() -> F.Column:
    """Of a published baseline (rings, expected, accuracy): whether the accuracy is the expectation over the rings."""
    return F.coalesce(F.abs(F.col("expected") / F.nullif(F.col("rings"), F.lit(0)) - F.col("accuracy")) < 1e-10, F.lit(False))


def archive_state(age: F.Column, interval: int) -> F.Column:
    """current or stale of the seconds since an archive's last success; unknown without one."""
    return F.when(age.isNull() | (age < 0), "unknown").when(age > interval + 3600, "stale").otherwise("current")
