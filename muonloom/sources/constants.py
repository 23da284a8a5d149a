"""Detector constants, flux-model parameters, outside measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# --- fixed values: detector ---------------------------------------------------
INFILL_STATIONS = (26, 36, 46, 79, 80, 81)
OM_TANK = {61: "A", 62: "A", 63: "B", 64: "B"}
ARRAY_ALTITUDE = 1946.0
SPEED_OF_LIGHT = 0.299792458  # m / ns
REFERENCE_RADIUS = 60.0

# (x, y) of the twelve infill tanks, A then B of stations 26, 36, 46, 79, 80, 81
INFILL_TANKS = (
    (13.460000038146973, -129.35499572753906), (20.950000762939453, -135.9149932861328),
    (37.435001373291016, -57.36000061035156), (29.18000030517578, -52.80500030517578),
    (71.3499984741211, 66.82499694824219), (67.07500076293945, 75.39500045776367),
    (18.09999942779541, -94.63000106811523), (10.880000114440918, -87.69499969482422),
    (76.42499923706055, -42.47999954223633), (85.64500045776367, -46.0),
    (77.40999984741211, 37.6150016784668), (87.19000244140625, 39.84000015258789),
)

OUTSIDE_BOUNDARY = (
    (-260.61499786, -496.98249817), (361.40750122, -398.25500488), (600.44999695, 144.05749893),
    (365.70500183, 428.20500183), (120.08250237, 397.2124939), (4.49999869e-02, 4.99107498e+02),
    (-356.92499542, 422.79750824), (-550.71749878, -145.46749878),
)

# --- fixed values: simulation -------------------------------------------------
PDG = {"proton": 2212, "helium": 1000020040, "oxygen": 1000080160, "iron": 1000260560}
DATASET_PARTICLE = {
    "9508": "proton", "10410": "proton", "20252": "proton", "10951": "proton",
    "7362": "helium", "11663": "helium", "20253": "helium", "12583": "helium",
    "7364": "oxygen", "12605": "oxygen", "20254": "oxygen", "12584": "oxygen",
    "9614": "iron", "10889": "iron", "20255": "iron", "10954": "iron",
}
# resampling radius in metres by the lower edge of the log-energy decade
RESAMPLE_RADIUS = {4: 200.0, 5: 400.0, 6: 600.0, 7: 800.0}

# --- fixed values: flux models, dN/dlnE = sum a E^-gamma exp(-E / (Z Rcut)) ----
# rows: population, element, a, gamma, Z, Rcut [GV]
H4A = (
    (1, "proton", 7860.0, 1.66, 1, 4e6), (1, "helium", 3550.0, 1.58, 2, 4e6),
    (1, "oxygen", 2200.0, 1.63, 8, 4e6), (1, "silicon", 1430.0, 1.67, 14, 4e6),
    (1, "iron", 2120.0, 1.63, 26, 4e6),
    (2, "proton", 20.0, 1.40, 1, 30e6), (2, "helium", 20.0, 1.40, 2, 30e6),
    (2, "oxygen", 13.4, 1.40, 8, 30e6), (2, "silicon", 13.4, 1.40, 14, 30e6),
    (2, "iron", 13.4, 1.40, 26, 30e6),
    (3, "proton", 200.0, 1.60, 1, 60e9),
)
H3A = H4A[:10] + (
    (3, "proton", 1.7, 1.40, 1, 2e9), (3, "helium", 1.7, 1.40, 2, 2e9),
    (3, "oxygen", 1.14, 1.40, 8, 2e9), (3, "silicon", 1.14, 1.40, 14, 2e9),
    (3, "iron", 1.14, 1.40, 26, 2e9),
)
POLYGONATO = (
    (1, "proton", 11800.0, 1.71, 1, 4.49e6), (1, "helium", 4750.0, 1.64, 2, 4.49e6),
    (1, "oxygen", 3860.0, 1.67, 8, 4.49e6), (1, "silicon", 3120.0, 1.70, 14, 4.49e6),
    (1, "iron", 1080.0, 1.55, 26, 4.49e6),
    (2, "proton", 11.8, 1.40, 1, 30e6), (2, "helium", 11.8, 1.40, 2, 30e6),
    (2, "oxygen", 7.88, 1.40, 8, 30e6), (2, "silicon", 7.88, 1.40, 14, 30e6),
    (2, "iron", 7.88, 1.40, 26, 30e6),
    (3, "proton", 1.7, 1.40, 1, 2e9), (3, "helium", 1.7, 1.40, 2, 2e9),
    (3, "oxygen", 1.14, 1.40, 8, 2e9), (3, "silicon", 1.14, 1.40, 14, 2e9),
    (3, "iron", 1.14, 1.40, 26, 2e9),
)
FLUX_MODELS = {"h4a": H4A, "h3a": H3A, "poly": POLYGONATO}

# --- fixed values: three-year all-particle spectrum, dN/(dlnE dOmega dA dt) -----
THREE_YEAR_LOGE = (
    6.450, 6.525, 6.575, 6.625, 6.675, 6.725, 6.775, 6.825, 6.875, 6.925, 6.975, 7.025, 7.075,
    7.125, 7.175, 7.225, 7.275, 7.325, 7.375, 7.425, 7.475, 7.525, 7.575, 7.625, 7.675, 7.725,
    7.775, 7.825, 7.875, 7.925, 7.975, 8.050, 8.150, 8.250, 8.350, 8.450, 8.550, 8.650, 8.750,
    8.850, 8.950, 9.050,
)
THREE_YEAR_FLUX = (
    4.874876e-07, 3.561436e-07, 2.881542e-07, 2.322555e-07, 1.858161e-07, 1.479502e-07,
    1.171621e-07, 9.287553e-08, 7.305793e-08, 5.719065e-08, 4.479624e-08, 3.483035e-08,
    2.720353e-08, 2.139004e-08, 1.678868e-08, 1.325049e-08, 1.053227e-08, 8.369410e-09,
    6.706060e-09, 5.352161e-09, 4.268105e-09, 3.454297e-09, 2.792893e-09, 2.256138e-09,
    1.776015e-09, 1.401786e-09, 1.157379e-09, 9.151598e-10, 7.561862e-10, 5.815745e-10,
    4.670996e-10, 3.291779e-10, 2.072970e-10, 1.243117e-10, 7.042426e-11, 4.514084e-11,
    2.294802e-11, 1.415630e-11, 7.593821e-12, 4.311962e-12, 2.221199e-12, 9.199803e-13,
)
# HAWC all-particle spectrum in log-energy bins 4.0, 4.1, ... 5.7
HAWC_FLUX = (
    4.7968e-7, 2.6922e-7, 1.5163e-7, 8.4947e-8, 4.7823e-8, 2.6761e-8, 1.4823e-8, 8.1839e-9,
    4.4769e-9, 2.4193e-9, 1.2781e-9, 6.7636e-10, 3.5835e-10, 1.9107e-10, 1.0346e-10, 5.4882e-11,
    2.9284e-11,
)

# --- fixed values: analysis ---------------------------------------------------
def literal_table(spark: SparkSession, rows, names) -> DataFrame:
    """A fixed table as literals of the plan: no Python worker and no file."""
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*cells)))


def flux_parameters(spark: SparkSession) -> DataFrame:
    """The flux models as a table (model, population, element, a, gamma, z, rcut)."""
    rows = [(m, *r) for m, table in FLUX_MODELS.items() for r in table]
    return literal_table(spark, rows,
                         ("model", "population", "element", "a", "gamma", "z", "rcut"))


def outside_spectra(spark: SparkSession) -> DataFrame:
    """Published spectra to compare with (name, log_energy, flux)."""
    rows = [("three_year", e, f) for e, f in zip(THREE_YEAR_LOGE, THREE_YEAR_FLUX)]
    rows += [("hawc", round(4.05 + 0.1 * i, 2), f) for i, f in enumerate(HAWC_FLUX)]
    return literal_table(spark, rows, ("name", "log_energy", "flux"))


def particles(spark: SparkSession) -> DataFrame:
    """Simulation dataset number -> particle and pdg code."""
    rows = [(d, p, PDG[p]) for d, p in DATASET_PARTICLE.items()]
    return literal_table(spark, rows, ("dataset", "particle", "pdg"))
