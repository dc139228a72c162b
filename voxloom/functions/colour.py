"""Colour spaces and differences as staged columns.

Each step is its own projection, so that shared terms are computed once and the plan
stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_lab(df: DataFrame, rgb: tuple[str, str, str], out: str) -> DataFrame:
    """Adds out_l, out_a, out_b: CIE Lab (D65) of sRGB in [0, 1]."""
    lin = {f"_lin{i}": F.when(F.col(c) > 0.04045, F.pow((F.col(c) + 0.055) / 1.055, F.lit(2.4))).otherwise(F.col(c) / 12.92) for i, c in enumerate(rgb)}
    # fixed values: sRGB primaries and the D65 white point
    m = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    white = (0.95047, 1.0, 1.08883)
    df = df.withColumns(lin)
    df = df.withColumns({f"_xyz{k}": (F.col("_lin0") * row[0] + F.col("_lin1") * row[1] + F.col("_lin2") * row[2]) / w for k, (row, w) in enumerate(zip(m, white, strict=True))})
    df = df.withColumns({f"_f{k}": F.when(F.col(f"_xyz{k}") > 216 / 24389, F.pow(f"_xyz{k}", F.lit(1 / 3))).otherwise((F.col(f"_xyz{k}") * (24389 / 27) + 16) / 116) for k in range(3)})
    f = [F.col(f"_f{k}") for k in range(3)]
    df = df.withColumns({f"{out}_l": f[1] * 116 - 16, f"{out}_a": (f[0] - f[1]) * 500, f"{out}_b": (f[1] - f[2]) * 200})
    return df.drop(*(f"_{n}{k}" for n in ("lin", "xyz", "f") for k in range(3)))


def _hue(b: str, a: str) -> Column:
    return F.when((F.col(a) == 0) & (F.col(b) == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(F.col(b), F.col(a))) + 360, F.lit(360.0)))


def with_ciede2000(df: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """Adds the CIEDE2000 difference of the Lab columns one_* and two_*, by the published formula with unit weights."""
    keep = [*df.columns, out]
    c = F.col
    chroma = lambda a, b: F.sqrt(c(a) * c(a) + c(b) * c(b))
    df = df.withColumn("_m7", F.pow((chroma(f"{one}_a", f"{one}_b") + chroma(f"{two}_a", f"{two}_b")) / 2, F.lit(7.0)))
    df = df.withColumn("_g", (F.lit(1.0) - F.sqrt(c("_m7") / (c("_m7") + 25.0**7))) * 0.5 + 1)
    df = df.withColumns({"_p1": c(f"{one}_a") * c("_g"), "_p2": c(f"{two}_a") * c("_g")})
    df = df.withColumns({"_c1": chroma("_p1", f"{one}_b"), "_c2": chroma("_p2", f"{two}_b"), "_h1": _hue(f"{one}_b", "_p1"), "_h2": _hue(f"{two}_b", "_p2")})
    df = df.withColumns({"_grey": c("_c1") * c("_c2") == 0, "_dh": c("_h2") - c("_h1"), "_sh": c("_h1") + c("_h2"), "_mc": (c("_c1") + c("_c2")) / 2, "_up": F.pow((c(f"{one}_l") + c(f"{two}_l")) / 2 - 50, F.lit(2.0))})
    df = df.withColumns({
        "_turn": F.when(c("_grey"), F.lit(0.0)).when(c("_dh") > 180, c("_dh") - 360).when(c("_dh") < -180, c("_dh") + 360).otherwise(c("_dh")),
        "_mh": F.when(c("_grey"), c("_sh")).when(F.abs("_dh") <= 180, c("_sh") / 2).when(c("_sh") < 360, (c("_sh") + 360) / 2).otherwise((c("_sh") - 360) / 2),
        "_k7": F.pow("_mc", F.lit(7.0)),
    })
    wave = lambda k, s: F.cos(F.radians(c("_mh") * k + s))
    df = df.withColumns({
        "_t": F.lit(1.0) - wave(1, -30) * 0.17 + wave(2, 0) * 0.24 + wave(3, 6) * 0.32 - wave(4, -63) * 0.20,
        "_rt": -F.sin(F.radians(F.exp(-F.pow((c("_mh") - 275) / 25, F.lit(2.0))) * 60)) * F.sqrt(c("_k7") / (c("_k7") + 25.0**7)) * 2,
        "_x": (c(f"{two}_l") - c(f"{one}_l")) / (F.lit(1.0) + c("_up") * 0.015 / F.sqrt(c("_up") + 20)),
        "_y": (c("_c2") - c("_c1")) / (c("_mc") * 0.045 + 1),
    })
    df = df.withColumn("_z", F.sqrt(c("_c1") * c("_c2")) * 2 * F.sin(F.radians(c("_turn") / 2)) / (c("_mc") * c("_t") * 0.015 + 1))
    return df.withColumn(out, F.sqrt(F.greatest(c("_x") * c("_x") + c("_y") * c("_y") + c("_z") * c("_z") + c("_rt") * c("_y") * c("_z"), F.lit(0.0)))).select(*keep)
