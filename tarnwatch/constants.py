"""Fixed values of the domain: published standards, sensor specifications and default thresholds.

Everything here is data that results depend on (index breakpoints, class limits, QC thresholds). No logic.
"""

LAKE_SENSORS = ["temperature", "ph", "turbidity", "dissolved_oxygen"]
READING_COLUMNS = ["station_id", "timestamp", *LAKE_SENSORS]
WEATHER_LAKE = ["air_temperature", "cloud_cover", "rain_mm"]

SLOT_MINUTES = 10
SLOTS_PER_HOUR = 6
SLOTS_PER_DAY = 144

# Physically plausible range per measure, both ends valid.
VALID_RANGES = {
    "temperature": (0.0, 45.0),
    "ph": (0.0, 14.0),
    "turbidity": (0.0, 4000.0),
    "dissolved_oxygen": (0.0, 25.0),
    "bod": (0.0, 500.0),
    "conductivity": (0.0, 20000.0),
    "nitrate": (0.0, 500.0),
}

# Weighted arithmetic WQI (permissible standard, ideal value, optional lower standard).
WQI_STANDARD = {"ph": 8.5, "dissolved_oxygen": 5.0, "turbidity": 5.0, "bod": 5.0, "conductivity": 300.0, "nitrate": 45.0}
WQI_IDEAL = {"ph": 7.0, "dissolved_oxygen": 14.6, "turbidity": 0.0, "bod": 0.0, "conductivity": 0.0, "nitrate": 0.0}
WQI_LOWER_STANDARD = {"ph": 6.5}
WQI_CLASS_BOUNDS = [(25.0, "Excellent"), (50.0, "Good"), (75.0, "Poor"), (100.0, "Very Poor")]
WQI_WORST = "Unsuitable"
WQI_CLASSES = ["Excellent", "Good", "Poor", "Very Poor", "Unsuitable"]

# Lake quality-control thresholds.
QC_PASS, QC_SUSPECT, QC_FAIL, QC_MISSING = 1, 3, 4, 9
RESOLUTION = {"temperature": 0.001, "ph": 0.001, "turbidity": 0.01, "dissolved_oxygen": 0.001}
MIN_SCALE = {"temperature": 0.1, "ph": 0.05, "turbidity": 0.05, "dissolved_oxygen": 0.1}
FLAT_SUSPECT, FLAT_FAIL = 12, 24
SPIKE_SUSPECT, SPIKE_FAIL = 6.0, 12.0
RATE_LIMIT = 8.0
BAND_QUANTILES = (0.001, 0.999)
BAND_MARGIN = 0.1
BAND_MIN_VALUES = 144
SHAPE_FAULTS = ["out_of_range", "flatline", "spike"]
SOFT_FAULTS = ["drift", "inconsistent", "rate_of_change"]

# Detector thresholds.
MAD_TO_STD = 1.4826
RESIDUAL_Z = 5.0
BASELINE_SLOTS = 1008
ANCHOR_SLOTS = 288
EVENT_Z, EVENT_MIN_SENSORS, EVENT_MIN_POINTS = 3.0, 2, 3
ONSET_SLOTS = 18
REVIEW_MIN_POINTS = 2
DRIFT_HOURS, DRIFT_CLIP, DRIFT_CAP, DRIFT_MIN = 48, 4.0, 1.5, 1.0
DRIFT_QUANTILE, DRIFT_CONFIRM_HOURS, DRIFT_CONFIRM_FRACTION = 0.999, 1, 0.5
FOREST_QUANTILE, FOREST_TREES, FOREST_SAMPLE = 0.9995, 200, 256
RAIN_MEMORY_HOURS, AIR_MEMORY_HOURS, CLOUD_MEMORY_HOURS = (6, 36, 120), (24, 96, 240), 3
CV_BLOCK_DAYS, CV_FOLDS = 14, 5
INCIDENT_GAP_MINUTES = 70
ALARM_VERDICTS = ["sensor_fault", "possible_event", "needs_review"]
GRACE_HOURS, AFTERMATH_HOURS = 1, 6

# Labelled fault shapes (size on the working scale).
FAULT_SIZE = {
    "spike": {"temperature": 4.0, "ph": 1.0, "turbidity": 1.5, "dissolved_oxygen": 3.0},
    "offset": {"temperature": 2.0, "ph": 0.5, "turbidity": 0.8, "dissolved_oxygen": 1.5},
    "drift": {"temperature": 1.5, "ph": 0.5, "turbidity": 1.0, "dissolved_oxygen": 2.0},
    "oscillation": {"temperature": 1.0, "ph": 0.3, "turbidity": 0.5, "dissolved_oxygen": 1.0},
}
EVENT_EFFECT = {"turbidity": 1.2, "dissolved_oxygen": -2.5, "ph": 0.4}

# Lake metabolism and soft-sensor window.
PRESSURE_ATM = 0.93
NIGHT_START, NIGHT_END = 21, 5
DAY_START, DAY_END = 6, 19
MIN_NIGHT_STEPS, POOL_NIGHTS, MAX_REAERATION = 6, 14, 0.5
WINDOW_HOURS, WINDOW_COVERAGE, METABOLISM_DAYS, ESTIMATE_HOUR = 24, 0.7, 3, 10
DRY_SPELL_CAP_HOURS, WET_HOUR_MM = 336, 1.0

# CPCB designated best use: class, DO min, BOD max, coliform max, pH low, pH high, not assessed.
CPCB_CLASSES = [
    ("A", 6.0, 2.0, 50.0, 6.5, 8.5, "total coliforms"),
    ("B", 5.0, 3.0, 500.0, 6.5, 8.5, "total coliforms"),
    ("C", 4.0, 3.0, 5000.0, 6.0, 9.0, "total coliforms"),
    ("D", 4.0, None, None, 6.5, 8.5, "free ammonia"),
    ("E", None, None, None, 6.0, 8.5, "conductivity, SAR, boron"),
]
COLIFORM_BANDS = [(50.0, "A (<=50)"), (500.0, "B (<=500)"), (5000.0, "C (<=5000)")]
COLIFORM_WORST = "above C"
TROPHIC_BOUNDS = [(40.0, "oligotrophic"), (50.0, "mesotrophic"), (70.0, "eutrophic")]
TROPHIC_WORST = "hypereutrophic"
LAB_LIMITS = {"bod": (0.0, 500.0), "chlorophyll_a": (0.0, 1000.0), "total_coliform": (0.0, 1e8)}
EXCEEDANCE_LEVELS = {"bod": [2.0, 3.0], "chlorophyll_a": [12.0, 24.0], "total_coliform": [50.0, 500.0, 5000.0]}

# Air stations.
PARTICLES = ["pm1", "pm25", "pm10", "tsp"]
GASES = ["o3", "no2", "co", "so2", "nox", "h2s", "co2", "voc"]
MOLECULAR_WEIGHT = {"o3": 48.00, "no2": 46.01, "co": 28.01, "so2": 64.07, "h2s": 34.08}
MOLAR_VOLUME = 24.45
CEILING = {"o3": 0.4, "no2": 0.1, "co": 20.0, "so2": 10.0, "nox": 0.5, "h2s": 8.0, "co2": 2000.0, "voc": 20.0,
           "pm1": 170.0, "pm25": 2000.0, "pm10": 4500.0, "tsp": 5000.0}
DETECTION_LIMIT = {"o3": 0.001, "no2": 0.001, "co": 0.040, "so2": 0.009, "nox": 0.001, "h2s": 0.012, "co2": 10.0,
                   "voc": 0.010}
STUCK_HOURS, AIR_SPIKE_Z, KAPPA, HUMIDITY_LIMIT = 6, 8.0, 0.4, 95.0
PM_ORDER_ABS, PM_ORDER_SHARE = 5.0, 0.15
INDEX_EDGES = [0, 50, 100, 200, 300, 400, 500]
BREAKPOINTS = {
    "pm10": [0, 50, 100, 250, 350, 430, 510],
    "pm25": [0, 30, 60, 90, 120, 250, 380],
    "no2": [0, 40, 80, 180, 280, 400, 520],
    "o3": [0, 50, 100, 168, 208, 748, 1288],
    "co": [0, 1.0, 2.0, 10.0, 17.0, 34.0, 51.0],
    "so2": [0, 40, 80, 380, 800, 1600, 2400],
}
EIGHT_HOUR = ["o3", "co"]
MIN_HOURS_24, MIN_HOURS_8, MIN_POLLUTANTS = 16, 6, 3
AQI_CATEGORIES = [
    (50, "Good", "Minimal impact"),
    (100, "Satisfactory", "Minor breathing discomfort to sensitive people"),
    (200, "Moderate", "Breathing discomfort to people with lung or heart disease, children and older adults"),
    (300, "Poor", "Breathing discomfort to most people on prolonged exposure"),
    (400, "Very Poor", "Respiratory illness on prolonged exposure"),
    (500, "Severe", "Affects healthy people; serious impact on those with existing disease"),
]
POLLUTANT_NAMES = {"no2": "NO2", "o3": "O3", "co": "CO", "so2": "SO2", "nox": "NOx", "h2s": "H2S", "co2": "CO2",
                   "voc": "VOC", "pm1": "PM1", "pm25": "PM2.5", "pm10": "PM10", "tsp": "TSP"}
AIR_SEVERITY = {"Poor": "medium", "Very Poor": "high", "Severe": "high"}

# Forecasts.
QUANTILES = (0.1, 0.5, 0.9)
LAKE_BUCKETS = [(1, 3), (4, 6), (7, 12), (13, 24), (25, 36), (37, 48)]
AIR_BUCKETS = [(1, 6), (7, 24), (25, 48)]
LAGS_HOURS = [1, 2, 3, 6, 12, 24]
TRAIN_HORIZONS = [1, 2, 3, 4, 6, 9, 12, 15, 18, 24, 30, 36, 42, 48]
AIR_TRAIN_HORIZONS = [1, 2, 3, 6, 9, 12, 18, 24, 30, 36, 42, 48]
MAX_HORIZON = 48
NIGHT_FIRST, NIGHT_LAST, NIGHT_MIN_HOURS, ISSUE_HOUR, NIGHTS_AHEAD = 0, 9, 5, 18, 7
DO_ALERT, ALERT_PROBABILITY, POOR_INDEX = 4.0, 0.5, 200
MIN_CALIBRATION, RECALIBRATE_DAYS, RECALIBRATE_EVERY = 30, 30, 7
MIN_PER_HOUR, AIR_MIN_PER_HOUR = 3, 2
LEAD_GROUPS = [(1, 2), (3, 4), (5, 7)]

# Readiness thresholds (days, samples) and report settings.
READY_DAYS = {"anomaly detector": 88, "forecaster": 150, "air quality": 135}
READY_LAB_SAMPLES, READY_WQI_SAMPLES = 38, 50
WEATHER_COVER_SHARE, DO_CEILING, STALE_HOURS, RECENT_DAYS = 0.95, 25.0, 3, 45
SEVERITY_ORDER = ["high", "medium", "low"]
TIMEZONE = "Asia/Kolkata"
WEATHER_VARIABLES = {
    "temperature_2m": ("air_temperature", 1.0),
    "cloud_cover": ("cloud_cover", 0.01),
    "precipitation": ("rain_mm", 1.0),
    "wind_speed_10m": ("wind_speed", 1.0),
    "relative_humidity_2m": ("relative_humidity", 1.0),
    "boundary_layer_height": ("boundary_layer_height", 1.0),
}
