"""The two-muon query: selection, invariant mass, logarithmic histogram, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS, LOW, HIGH = 300, 0.25, 300.0


def invariant_mass(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mass of two particles given as pt, eta, phi and mass; a negative square counts as 0."""

    def momentum(p: dict[str, Column]) -> tuple[Column, Column, Column, Column]:
        x, y, z = p["pt"] * F.cos(p["phi"]), p["pt"] * F.sin(p["phi"]), p["pt"] * F.sinh(p["eta"])
        return F.sqrt(x * x + y * y + z * z + p["mass"] * p["mass"]), x, y, z

    e, x, y, z = (s + t for s, t in zip(momentum(a), momentum(b)))
    return F.sqrt(F.greatest(F.lit(0.0), e * e - x * x - y * y - z * z))


def select_pairs(events: DataFrame) -> DataFrame:
    """Events with two muons of opposite charge, with their mass; muons are arrays."""
    rows = events.where((F.col("n_muon") == 2) & (F.col("muon_charge")[0] != F.col("muon_charge")[1]))
    one = lambda i: {k: F.col(f"muon_{k}")[i].cast("double") for k in ("pt", "eta", "phi", "mass")}
    return rows.withColumn("pair_mass", invariant_mass(one(0), one(1)))


def hard_muons(events: DataFrame) -> DataFrame:
    """The other selection: both muons hard and central."""
    return events.where(F.forall("muon_pt", lambda p: p >= 10) & F.forall("muon_eta", lambda e: F.abs(e) <= 2.4))


def log_bin(value: Column, bins: int = BINS, low: float = LOW, high: float = HIGH) -> Column:
    """0 below, 1..bins inside, bins + 1 from ``high`` on; evenly spaced in the logarithm."""
    return F.when(value < low, 0).when(value >= high, bins + 1).otherwise(F.least(F.lit(bins), F.floor(F.log(value / low) / F.log(F.lit(high / low)) * bins) + 1)).cast("int")


def mass_histogram(df: DataFrame, value: str = "pair_mass", bins: int = BINS, low: float = LOW, high: float = HIGH) -> DataFrame:
    return df.groupBy(log_bin(F.col(value), bins, low, high).alias("bin")).agg(F.count("*").alias("n"))


def linear_histogram(df: DataFrame, value: str, width: float = 1.0, most: int = 200) -> DataFrame:
    """Bins of one width with an overflow bin."""
    return df.groupBy(F.least(F.lit(most), F.floor(F.col(value) / width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def fingerprint(histogram: DataFrame) -> DataFrame:
    """Sum of (bin + 1) * count: equal for equal histograms whatever the order of events."""
    return histogram.agg(F.coalesce(F.sum((F.col("bin") + 1) * F.col("n")), F.lit(0)).alias("fingerprint"))
