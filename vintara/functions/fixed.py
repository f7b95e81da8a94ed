"""Fixed values of the method (defaults of every operator option)."""

# Band quantiles, projected-growth classes and the smallest cell that stands alone.
BAND_QUANTILES = (0.10, 0.90)
GROWTH_CLASSES = 5
MIN_CELL = 100
LARGE_ENTITIES = 20
TRIM_QUANTILES = (0.01, 0.99)
OUTLIER_RATIO = 10.0

# Naive forecast: mean of the periods v-5 .. v-2, at least three of the four.
NAIVE_WINDOW = 4
NAIVE_LAG = 2
NAIVE_MIN = 3

# Real-time calibration.
OWN_HISTORY_MIN = 8
BOOTSTRAP_DRAWS = 500
QUANTILE_BOOTSTRAP_DRAWS = 1000

# Archive of revised data: delays in years, thresholds, entities kept for the top list.
REVISION_DELAYS = (1, 2, 5, 10)
GROWTH_REVISION_THRESHOLD = 1.0
LEVEL_REVISION_THRESHOLD = 10.0
TOP_REVISED_ENTITIES = 50
HISTORY_REVISION_THRESHOLD = 5.0
VOLUME_REVISION_THRESHOLD = 2.0

# Long horizon.
DRIFT_WINDOW = 10
DRIFT_SHARE = 0.8
LONG_HORIZON = 25
EXTRAPOLATION_HORIZON = 40
MIN_EDITION_PERIODS = 10
BAND_EXPONENTS = (0.20, 2.00, 0.01)
ALL_GROUPS = "all"

# Population bounds.
SIZE_THRESHOLD = 5000.0
MIN_REVISIONS = 4
MULTIPLIER_EXPONENTS = (-3.00, -0.10, 0.01)

# Joint draws and reference period.
MIN_ENTITIES_PER_DRAW = 100
LOST_WEIGHT_PCT = 0.1
CANDIDATE_PERIODS = 5

# Shock study.
SHOCK_LEVEL_OFFSETS = (0, 1, 2, 4)
ELASTICITIES = (1.0, 1.5)
TREND_PERIODS = 3
ACTIVITY_DELAYS = (1, 4)

# 90th percentile of the standard normal, and the floor of the yearly standard deviation
# of the log level: (0.027 - 0.006) / (2 * 83.5th percentile of the standard normal).
Z90 = 1.2815515655446008
Z835 = 0.974113877059309
ANNUAL_SD_FLOOR = (0.027 - 0.006) / (2 * Z835)

# Rational approximation of the inverse normal distribution by M. J. Wichura (1988), AS 241, fixed values: coefficients of numerator
# and denominator, highest power first, for the middle, the tails and the far tails.
INVERSE_NORMAL = (
    ((2509.0809287301227, 33430.57558358813, 67265.7709270087, 45921.95393154987, 13731.69376550946, 1971.5909503065513, 133.14166789178438, 3.3871328727963665),
     (5226.495278852854, 28729.085735721943, 39307.89580009271, 21213.794301586597, 5394.196021424751, 687.1870074920579, 42.31333070160091, 1.0)),
    ((0.0007745450142783414, 0.022723844989269184, 0.2417807251774506, 1.2704582524523684, 3.6478483247632045, 5.769497221460691, 4.630337846156546, 1.4234371107496835),
     (1.0507500716444169e-09, 0.0005475938084995345, 0.015198666563616457, 0.14810397642748008, 0.6897673349851, 1.6763848301838038, 2.053191626637759, 1.0)),
    ((2.0103343992922881e-07, 2.7115555687434876e-05, 0.0012426609473880784, 0.026532189526576124, 0.29656057182850487, 1.7848265399172913, 5.463784911164114, 6.657904643501103),
     (2.0442631033899397e-15, 1.421511758316446e-07, 1.8463183175100548e-05, 0.0007868691311456133, 0.014875361290850615, 0.1369298809227358, 0.599832206555888, 1.0)),
)

# Codes of the forecast source that differ from the observed source.
CODE_RECODES = {"KOS": "XKX", "WBG": "PSE"}
# Group labels of the fiscal-year sheet.
GROUP_CODES = {"L": "LIC", "LM": "LMC", "UM": "UMC", "H": "HIC"}
# Regions of the observed source mapped to zones of the long-run source.
REGION_ZONES = {
    "NAC": "A2", "LCN": "A9", "ECS": "E_S4", "SSF": "F6", "MEA": "F98", "EAS": "O_S2_S8", "SAS": "S7",
}
WORLD_ZONE = "W"
CENTRAL_LONG_RUN = "BAU1"
