"""Presets: column roles, code sets, thresholds, scenarios and labels as data.

Operators never hard-wire these; pipelines pass them in.  Two presets exist:

* ``COLLISION`` - the road-collision record layout the analysis was written for.
* ``RECORDS`` - the binding to the star-schema test tables (lineitem joined to
  orders, customer and part), used by the registered queries and the bench.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the original analysis for identical results)
# ---------------------------------------------------------------------------

# Special codes kept as their own level when rare-grouping.
DEFAULT_KEEP_LEVELS = ["U", "UU", "Q", "QQ", "N", "NN", "R", "RR", "X", "XX"]
# Codes collapsed into OTHER: the special codes plus RARE.
DEFAULT_SPECIAL_LEVELS = DEFAULT_KEEP_LEVELS + ["RARE"]

# Per-column keep sets for the collision categoricals.
COLLISION_KEEP_LEVELS = {
    "C_WTHR": ["1", "2", "3", "4", "5", "6", "7", "OTHER"],
    "C_RSUR": ["1", "2", "3", "4", "5", "6", "7", "OTHER"],
    "C_RALN": ["1", "2", "3", "4", "5", "6", "OTHER"],
    "C_TRAF": ["01", "02", "03", "04", "06", "08", "18", "OTHER"],
    "P_SAFE": ["01", "02", "09", "12", "13", "OTHER"],
    "P_USER": ["1", "2", "3", "4", "5", "OTHER"],
    "P_SEX": ["F", "M", "OTHER"],
    "V_TYPE": ["01", "05", "06", "07", "08", "09", "11", "14", "17", "OTHER"],
}

# Per-column rare thresholds (strictly fewer rows than this -> grouped).
COLLISION_RARE_THRESHOLDS = {
    "C_WTHR": 100,
    "C_RSUR": 100,
    "C_RALN": 100,
    "C_TRAF": 150,
    "P_SAFE": 100,
    "P_USER": 75,
    "P_SEX": 25,
    "V_TYPE": 125,
}

MIN_COUNT_RARE = 3000
RANDOM_STATE = 42
N_SAMPLE_MAIN = 75000
PERSON_MODEL_SAMPLE_N = 150000
N_BOOTSTRAP_DRAWS = 5000
TEST_SHARE = 0.30
NUMERIC_RAW_COLUMNS = ["P_AGE", "C_MNTH", "C_WDAY", "C_HOUR", "C_VEHS", "V_YEAR", "P_ISEV", "C_SEV"]
VEHICLE_AGE_RANGE = (0.0, 60.0)

RQ1_FEATURES = ["C_WTHR", "C_RSUR", "C_RALN", "C_TRAF", "C_MNTH", "C_WDAY", "C_HOUR", "C_VEHS"]
RQ1_CATEGORICAL = ["C_WTHR", "C_RSUR", "C_RALN", "C_TRAF"]
RQ2_FEATURES = ["P_SAFE", "P_USER", "P_SEX", "V_TYPE", "VEHICLE_AGE", "P_AGE"]
RQ2_CATEGORICAL = ["P_SAFE", "P_USER", "P_SEX", "V_TYPE"]
RQ2_NUMERIC = ["VEHICLE_AGE", "P_AGE"]
COMBINED_FEATURES = RQ1_FEATURES + RQ2_FEATURES
COMBINED_CATEGORICAL = RQ1_CATEGORICAL + RQ2_CATEGORICAL

ORDINAL_RQ1_FEATURES = ["C_WTHR", "C_RSUR", "C_RALN", "C_TRAF", "C_MNTH", "C_WDAY", "C_HOUR", "C_VEHS", "C_YEAR"]
ORDINAL_RQ1_NUMERIC = ["C_MNTH", "C_WDAY", "C_HOUR", "C_VEHS", "C_YEAR"]
ORDINAL_RQ2_FEATURES = ["P_SAFE", "P_USER", "P_SEX", "V_TYPE", "P_AGE", "V_YEAR"]
ORDINAL_RQ2_NUMERIC = ["P_AGE", "V_YEAR"]

DEFAULT_BASELINE_PROFILE = {
    "C_WTHR": "1",
    "C_RSUR": "1",
    "C_RALN": "1",
    "C_TRAF": "01",
    "C_MNTH": 7.0,
    "C_WDAY": 4.0,
    "C_HOUR": 14.0,
    "C_VEHS": 2.0,
    "P_SAFE": "02",
    "P_USER": "1",
    "P_SEX": "F",
    "V_TYPE": "01",
    "VEHICLE_AGE": 7.0,
    "P_AGE": 34.0,
}

# (scenario name, variable, new value); None = keep the baseline value.
COLLISION_SWITCH_SCENARIOS = [
    ("Baseline (traffic signal)", "C_TRAF", None),
    ("Traffic signal removed", "C_TRAF", "18"),
    ("Weather baseline to adverse", "C_WTHR", "2"),
    ("Weather baseline to severe", "C_WTHR", "6"),
    ("Road surface baseline to risky", "C_RSUR", "6"),
    ("Road alignment baseline to risky", "C_RALN", "3"),
    ("Safety baseline to P_SAFE_09", "P_SAFE", "09"),
    ("User baseline to P_USER_5", "P_USER", "5"),
]

COLLISION_RISK_PROFILES = [
    ("Low-risk profile", {"VEHICLE_AGE": 2, "P_AGE": 25}),
    ("Medium-risk profile", {"VEHICLE_AGE": 10, "P_AGE": 45, "C_WTHR": "2", "C_RALN": "3"}),
    ("High-risk profile", {"VEHICLE_AGE": 18, "P_AGE": 70, "C_WTHR": "6", "C_RSUR": "6",
                           "C_RALN": "3", "C_TRAF": "18", "P_SAFE": "09", "P_USER": "5"}),
]

COLLISION_CONTRAST = ("P_SEX", [("Female baseline", "F"), ("Male sensitivity", "M")])

VEHICLE_AGE_GRID = list(range(0, 21))
PERSON_AGE_GRID = list(range(16, 81, 4))

RISK_BANDS = [
    ("Below 0.25", None, 0.25),
    ("0.25 to <0.50", 0.25, 0.50),
    ("0.50 to <0.75", 0.50, 0.75),
    ("0.75 and above", 0.75, None),
]

Z_COEF_INTERVAL = 1.959963984540054   # exact normal quantile, coefficient intervals
Z_PREDICTION_INTERVAL = 1.96          # prediction intervals

VARIABLE_LABELS = {
    "C_WTHR": "Weather",
    "C_RSUR": "Road surface",
    "C_RALN": "Road alignment",
    "C_TRAF": "Traffic control",
    "C_MNTH": "Month",
    "C_WDAY": "Weekday",
    "C_HOUR": "Hour",
    "C_VEHS": "Vehicles involved",
    "P_SAFE": "Safety device",
    "P_USER": "Road user type",
    "P_SEX": "Sex",
    "V_TYPE": "Vehicle type",
    "VEHICLE_AGE": "Vehicle age",
    "P_AGE": "Person age",
}

VALUE_LABELS = {
    "C_WTHR": {
        "1": "Clear and sunny",
        "2": "Cloudy",
        "3": "Raining",
        "4": "Snowing",
        "5": "Freezing rain / sleet / hail",
        "6": "Visibility limitation",
        "7": "Strong wind",
        "Q": "Other weather condition",
        "OTHER": "Other weather condition",
        "U": "Unknown weather condition",
        "X": "No weather data",
    },
    "C_RSUR": {
        "1": "Dry, normal",
        "2": "Wet",
        "3": "Snow",
        "4": "Slush / wet snow",
        "5": "Icy",
        "6": "Sand / gravel / dirt",
        "7": "Muddy",
        "8": "Oil",
        "9": "Flooded",
        "Q": "Other road surface",
        "OTHER": "Other road surface",
        "U": "Unknown road surface",
        "X": "No road-surface data",
    },
    "C_RALN": {
        "1": "Straight and level",
        "2": "Straight with gradient",
        "3": "Curved and level",
        "4": "Curved with gradient",
        "5": "Top of hill or gradient",
        "6": "Bottom of hill or gradient",
        "Q": "Other road alignment",
        "OTHER": "Other road alignment",
        "U": "Unknown road alignment",
        "X": "No road-alignment data",
    },
    "C_TRAF": {
        "1": "Traffic signals fully operational",
        "2": "Traffic signals in flashing mode",
        "3": "Stop sign",
        "4": "Yield sign",
        "5": "Warning sign",
        "6": "Pedestrian crosswalk",
        "7": "Police officer",
        "8": "School guard / flagman",
        "9": "School crossing",
        "10": "Reduced speed zone",
        "11": "No passing zone sign",
        "12": "Markings on the road",
        "13": "School bus stopped with signal lights flashing",
        "14": "School bus stopped with signal lights not flashing",
        "15": "Railway crossing with signals / gates",
        "16": "Railway crossing with signs only",
        "17": "Control device not specified",
        "18": "No control present",
        "QQ": "Other traffic control",
        "OTHER": "Other traffic control",
        "UU": "Unknown traffic control",
        "XX": "No traffic-control data",
    },
    "P_SAFE": {
        "1": "No safety device used",
        "2": "Safety device used",
        "9": "Helmet worn",
        "10": "Reflective clothing worn",
        "11": "Helmet and reflective clothing used",
        "12": "Other safety device",
        "13": "No safety device equipped",
        "NN": "Not applicable",
        "QQ": "Other safety-device code",
        "OTHER": "Other safety-device code",
        "UU": "Unknown safety-device code",
        "XX": "No safety-device data",
    },
    "P_USER": {
        "1": "Motor vehicle driver",
        "2": "Motor vehicle passenger",
        "3": "Pedestrian",
        "4": "Bicyclist",
        "5": "Motorcyclist",
        "U": "Unknown / not stated road user",
        "OTHER": "Other road user type",
    },
    "P_SEX": {
        "F": "Female",
        "M": "Male",
        "N": "Not applicable",
        "U": "Unknown",
        "X": "No sex data",
        "OTHER": "Other / unknown sex",
    },
    "V_TYPE": {
        "1": "Light-duty vehicle",
        "5": "Panel / cargo van",
        "6": "Other truck / van",
        "7": "Unit truck > 4,536 kg",
        "8": "Road tractor",
        "9": "School bus",
        "10": "Smaller school bus",
        "11": "Urban / intercity bus",
        "14": "Motorcycle / moped",
        "16": "Off-road vehicle",
        "17": "Bicycle",
        "18": "Motorhome",
        "19": "Farm equipment",
        "20": "Construction equipment",
        "21": "Fire engine",
        "22": "Snowmobile",
        "23": "Streetcar",
        "NN": "Not applicable vehicle type",
        "QQ": "Other vehicle type",
        "OTHER": "Other vehicle type",
        "UU": "Unknown vehicle type",
        "XX": "No vehicle-type data",
    },
}

TERM_LABEL_OVERRIDES = {
    "const": "Intercept",
    "P_SEX_M": "Male (vs female)",
}

SEX_LABELS = {
    "F": "Female",
    "M": "Male",
}

SCENARIO_VALUE_LABELS = {
    ("C_TRAF", "1"): "Traffic signals fully operational",
    ("C_TRAF", "18"): "Traffic signal removed",
    ("C_WTHR", "2"): "Overcast / cloudy",
    ("C_WTHR", "6"): "Visibility reduced (fog / smoke / dust / drifting snow)",
    ("C_RSUR", "6"): "Sand / gravel / dirt road surface",
    ("C_RALN", "3"): "Curved and level road",
    ("P_SAFE", "9"): "Helmet worn",
    ("P_USER", "5"): "Motorcyclist",
}
BASELINE_SCENARIO_NAME = "Baseline (traffic signal)"
BASELINE_SCENARIO_LABEL = "Baseline (traffic signals fully operational)"

COMPARISON_COLUMNS = ["Model", "Family", "Accuracy", "Balanced_Accuracy", "Macro_F1", "ROC_AUC", "MAE"]
COMPARISON_RENAMES = {"model": "Model", "Model_Name": "Model", "accuracy": "Accuracy",
                      "balanced_accuracy": "Balanced_Accuracy", "macro_f1": "Macro_F1",
                      "roc_auc": "ROC_AUC", "mae": "MAE"}
METRIC_COLUMNS = ["Model", "Threshold", "Accuracy", "Balanced_Accuracy", "Macro_Precision",
                  "Macro_Recall", "Macro_F1", "ROC_AUC", "MAE", "Confusion_Matrix"]

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class HygieneSpec:
    """How categorical hygiene runs for one pipeline."""

    categorical: list[str]
    keep_levels: dict[str, list[str]] = field(default_factory=dict)
    rare_thresholds: dict[str, int] = field(default_factory=dict)
    rare_shares: dict[str, float] = field(default_factory=dict)
    default_threshold: int = MIN_COUNT_RARE
    default_keep: list[str] = field(default_factory=lambda: ["OTHER"])
    special_levels: list[str] = field(default_factory=lambda: list(DEFAULT_SPECIAL_LEVELS))
    other_label: str = "OTHER"


COLLISION = HygieneSpec(
    categorical=COMBINED_CATEGORICAL,
    keep_levels=COLLISION_KEEP_LEVELS,
    rare_thresholds=COLLISION_RARE_THRESHOLDS,
    default_threshold=max(MIN_COUNT_RARE, 5000),
)

# ---------------------------------------------------------------------------
# Test-table binding ("records" = lineitem x orders x customer x part)
# ---------------------------------------------------------------------------

RECORD_KEY_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
RECORD_CATEGORICAL = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment", "p_type", "p_brand"]
RECORD_NUMERIC = ["l_quantity", "l_discount", "p_size", "c_acctbal"]
RECORD_CONTEXT_FEATURES = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment",
                           "l_quantity", "l_discount"]
RECORD_CONTEXT_CATEGORICAL = ["l_returnflag", "l_linestatus", "o_orderpriority", "c_mktsegment"]
RECORD_ITEM_FEATURES = ["p_type", "p_brand", "ship_lag", "p_size", "c_acctbal"]
RECORD_ITEM_CATEGORICAL = ["p_type", "p_brand"]
RECORD_ITEM_IMPUTE = ["ship_lag"]
RECORD_COMBINED_FEATURES = RECORD_CONTEXT_FEATURES + RECORD_ITEM_FEATURES
RECORD_COMBINED_CATEGORICAL = RECORD_CONTEXT_CATEGORICAL + RECORD_ITEM_CATEGORICAL

RECORDS = HygieneSpec(
    categorical=RECORD_COMBINED_CATEGORICAL,
    keep_levels={
        "l_returnflag": ["A", "OTHER"],
        "l_linestatus": ["F", "O", "OTHER"],
        "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "OTHER"],
        "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "OTHER"],
        "p_type": ["ECONOMY", "LARGE", "OTHER"],
        "p_brand": ["Brand#1", "Brand#2", "Brand#3", "OTHER"],
    },
    # share-based thresholds keep the grouping stable across scale factors
    rare_shares={
        "o_orderpriority": 0.21,
        "c_mktsegment": 0.20,
        "p_type": 0.17,
        "p_brand": 0.04,
    },
    default_threshold=100,
)

RECORD_BASELINE_DEFAULTS = {
    "l_returnflag": "A",
    "l_linestatus": "F",
    "o_orderpriority": "1-URGENT",
    "l_quantity": 25.0,
    "p_size": 25.0,
}

RECORD_SWITCH_SCENARIOS = [
    ("Baseline (urgent)", "o_orderpriority", None),
    ("Priority to high", "o_orderpriority", "2-HIGH"),
    ("Priority to medium", "o_orderpriority", "3-MEDIUM"),
    ("Segment to building", "c_mktsegment", "BUILDING"),
    ("Status to open", "l_linestatus", "O"),
    ("Type to large", "p_type", "LARGE"),
]

RECORD_RISK_PROFILES = [
    ("Low-risk profile", {"l_quantity": 5, "p_size": 5}),
    ("Medium-risk profile", {"l_quantity": 25, "p_size": 25, "p_type": "LARGE"}),
    ("High-risk profile", {"l_quantity": 45, "p_size": 45, "p_type": "ECONOMY",
                           "o_orderpriority": "3-MEDIUM", "l_linestatus": "O"}),
]

RECORD_CONTRAST = ("l_linestatus", [("Filled baseline", "F"), ("Open sensitivity", "O")])

RECORD_VARIABLE_LABELS = {
    "l_returnflag": "Return flag",
    "l_linestatus": "Line status",
    "o_orderpriority": "Order priority",
    "o_orderstatus": "Order status",
    "c_mktsegment": "Market segment",
    "p_type": "Part type",
    "p_brand": "Brand",
    "p_size": "Part size",
    "l_quantity": "Quantity",
    "l_discount": "Discount",
    "c_acctbal": "Account balance",
    "ship_lag": "Shipping lag (years)",
}

RECORD_VALUE_LABELS = {
    "l_returnflag": {"A": "Accepted", "N": "Not returned", "R": "Returned", "OTHER": "Other flag"},
    "l_linestatus": {"F": "Filled", "O": "Open", "OTHER": "Other status"},
    "o_orderstatus": {"F": "Fulfilled", "O": "Open", "P": "Partial"},
    "o_orderpriority": {"1-URGENT": "Urgent", "2-HIGH": "High", "3-MEDIUM": "Medium",
                        "4-NOT SPECIFIED": "Not specified", "5-LOW": "Low", "OTHER": "Other priority"},
    "c_mktsegment": {"AUTOMOBILE": "Automobile", "BUILDING": "Building", "FURNITURE": "Furniture",
                     "HOUSEHOLD": "Household", "MACHINERY": "Machinery", "OTHER": "Other segment"},
    "p_type": {"ECONOMY": "Economy", "LARGE": "Large", "MEDIUM": "Medium", "PROMO": "Promotional",
               "SMALL": "Small", "STANDARD": "Standard", "OTHER": "Other type"},
    "p_size": {"1": "Size one", "2": "Size two", "3": "Size three", "10": "Size ten"},
}

RECORD_TERM_OVERRIDES = {"const": "Intercept", "l_linestatus_O": "Open (vs filled)"}

RECORD_SCENARIO_LABELS = {
    ("o_orderpriority", "2-HIGH"): "High priority order",
    ("c_mktsegment", "BUILDING"): "Building segment",
    ("p_type", "LARGE"): "Large part",
}
