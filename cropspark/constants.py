"""Fixed values of the domain. They must match the published data exactly, so they are stated as plain text."""

# --- fixed values: price feed -------------------------------------------------------------------------
MAX_PRICE_KG = 200_000
SOURCE_RANK = {"excel": 1, "soap": 2}

MONTH_NAMES_ES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto", "Septiembre",
                  "Octubre", "Noviembre", "Diciembre"]
MONTH_ABBREV_ES = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]

MARKET_ALIAS = {
    "Bogotá, D.C., Corabastos": "Bogotá, Corabastos",
    "Cali, Santa Helena": "Cali, Santa Elena",
    "Pereira, La 41-Impala": "Pereira, La 41",
    "Santa Marta (Magdalena)": "Santa Marta",
    "Ibagué, Plaza La 21": "Ibagué, La 21",
    "Medellín, Central Mayorista de Antioquia": "Medellín, CMA",
    "Popayán, Plaza de mercado del barrio Bolívar": "Popayán, Plaza del barrio Bolívar",
    "Popayán": "Popayán, Plaza del barrio Bolívar",
    "Tunja": "Tunja, Complejo de Servicios del Sur",
}
AGGREGATE_MARKETS = ["Barranquilla", "Valledupar"]
DEPARTMENT_ALIAS = {"BOGOTÁ, D. C.": "Bogotá D.C.", "BOGOTÁ, D.C.": "Bogotá D.C."}
MINOR_WORDS = ["de", "del", "la", "las", "los", "y"]
GROUP_ALIAS = {
    "FRUTAS": "Frutas",
    "VERDURAS Y HORTALIZAS": "Verduras y hortalizas",
    "TUBERCULOS, RAICES Y PLATANOS": "Tubérculos, raíces y plátanos",
    "TUBÉRCULOS, RAÍCES Y PLÁTANOS": "Tubérculos, raíces y plátanos",
}

# --- fixed values: priced product -> crop -------------------------------------------------------------
PRODUCT_TO_CROP = {
    "AGUACATE": "AGUACATE", "AHUYAMA": "AHUYAMA", "ARRACACHA": "ARRACACHA",
    "ARVEJA VERDE EN VAINA": "ARVEJA", "BANANO": "BANANO",
    "CEBOLLA CABEZONA BLANCA": "CEBOLLA DE BULBO", "CEBOLLA JUNCA": "CEBOLLA DE RAMA",
    "COCO": "COCO", "FRIJOL VERDE": "FRIJOL", "GRANADILLA": "GRANADILLA", "GUAYABA": "GUAYABA",
    "HABICHUELA": "HABICHUELA", "LECHUGA BATAVIA": "LECHUGA", "LIMON COMUN": "LIMON", "LIMON TAHITI": "LIMON",
    "LULO": "LULO", "MANDARINA": "MANDARINA", "MANGO TOMMY": "MANGO", "MANZANA ROYAL GALA": "MANZANA",
    "MARACUYA": "MARACUYA", "MORA DE CASTILLA": "MORA", "NARANJA": "NARANJA",
    "PAPA CRIOLLA": "PAPA", "PAPA NEGRA": "PAPA", "PAPAYA MARADOL": "PAPAYA",
    "PEPINO COHOMBRO": "PEPINO COHOMBRO", "PIMENTON": "PIMENTON", "PINA": "PINA",
    "PLATANO GUINEO": "PLATANO", "PLATANO HARTON VERDE": "PLATANO", "REMOLACHA": "REMOLACHA",
    "TOMATE": "TOMATE", "TOMATE DE ARBOL": "TOMATE DE ARBOL", "YUCA": "YUCA", "ZANAHORIA": "ZANAHORIA",
}

# --- fixed values: territory --------------------------------------------------------------------------
NATURAL_REGIONS = ["Andina", "Caribe", "Pacífico", "Orinoquía", "Amazonía"]
DEPARTMENT_REGION = {
    "05": "Andina", "08": "Caribe", "11": "Andina", "13": "Caribe", "15": "Andina", "17": "Andina",
    "18": "Amazonía", "19": "Pacífico", "20": "Caribe", "23": "Caribe", "25": "Andina", "27": "Pacífico",
    "41": "Andina", "44": "Caribe", "47": "Caribe", "50": "Orinoquía", "52": "Pacífico", "54": "Andina",
    "63": "Andina", "66": "Andina", "68": "Andina", "70": "Caribe", "73": "Andina", "76": "Pacífico",
    "81": "Orinoquía", "85": "Orinoquía", "86": "Amazonía", "88": "Caribe", "91": "Amazonía",
    "94": "Amazonía", "95": "Amazonía", "97": "Amazonía", "99": "Orinoquía",
}
TOWN_SYNONYMS = {
    "Santa Fe de Bogota": "11001", "Bogota D.C.": "11001", "Bogota DC": "11001", "Cartagena": "13001",
    "San Jose de Cucuta": "54001", "Cucuta": "54001", "Santiago de Cali": "76001", "Ibague": "73001",
    "El Espinal": "73268",
}
JOIN_RADIUS_KM = 50.0
JOIN_MAX_ALTITUDE_M = 400.0
ALTITUDE_KM_PER_M = 0.1

# --- fixed values: climate ----------------------------------------------------------------------------
SENSOR_RULES = [  # a later rule wins
    ("temperatura|temp", "temperatura_media_c"),
    ("humedad", "humedad_relativa_pct"),
    ("brillo|solar|radiaci", "brillo_solar_horas_dia"),
]
ENSO_EL_NINO, ENSO_LA_NINA, ENSO_NEUTRAL = "El Niño", "La Niña", "Neutral"
ENSO_THRESHOLD = 0.5
MIN_NINO_MONTHS = 5
MIN_CLIMATOLOGY_YEARS = 4
MIN_RAIN_MONTHS = 10
EVENT_DROUGHT = "Sequía severa"
EVENT_EXCESS_RAIN = "Exceso de lluvias"
EVENT_HEAT = "Estrés térmico"
EVENT_PESTS = "Condiciones propicias para plagas (regla)"
EVENT_NONE = "Sin evento crítico"
RISK_LABELS = ["BAJO", "MEDIO", "ALTO"]

# --- fixed values: scenario and advice rules ----------------------------------------------------------
ENSO_YIELD_PCT = {"El Niño": -0.10, "La Niña": 0.06, "Neutral": 0.0}
RAIN_YIELD_PCT = {"Déficit": -0.08, "Exceso": -0.04, "Normal": 0.0}
SUITABILITY_SCORE = {"alta": 3, "moderada": 2, "marginal": 1, "no_apta": 0}
SUITABILITY_DOSE = {"alta": 250, "moderada": 320, "marginal": 400}
DEFAULT_DOSE = 350
DEFICIT_DOSE_STEP = 30
DEFICIT_THRESHOLD = 0.6
SOWING_WINDOWS = {
    "Arroz": ("abril, mayo", "octubre, noviembre"),
    "Maíz": ("marzo, abril", "septiembre, octubre"),
    "Café": ("febrero, marzo", "agosto, septiembre"),
    "Caña": ("enero, febrero", "julio, agosto"),
    "Papa": ("abril, mayo", "octubre, noviembre"),
    "Plátano": ("marzo, abril", "septiembre, octubre"),
    "Aguacate": ("febrero, marzo", "agosto, septiembre"),
}
DEFAULT_WINDOW_CROP = "Maíz"
SOWING_ADJUSTMENT = {
    "El Niño": "Adelanta 2 semanas para evitar déficit hídrico",
    "La Niña": "Atrasa 1-2 semanas y refuerza drenaje",
    "Neutral": "Mantén el calendario tradicional",
}
FERTILISER_WORDS = ["fertilizante", "urea", "dap", "kcl", "sam"]
PESTICIDE_WORDS = ["plaguicida", "herbicida", "fungicida", "insecticida"]

# --- fixed values: report, forecast and monitoring thresholds -----------------------------------------
REPORT_HISTORY_DAYS = 45
REPORT_MAX_PREVIOUS_DAYS = 5
REPORT_ACTIVE_DAYS = 30
REPORT_TOP = 8
OUTLIER_Z = 3.0
OUTLIER_MIN_OBS = 10
OUTLIER_WINDOW = 30
OUTLIER_TOP = 10
MIN_GAP_MARKETS = 3
FORECAST_HORIZON = 10
FORECAST_LAGS = (1, 2, 3, 5, 10, 20)
FORECAST_MIN_OBS = 180
FORECAST_FFILL = 3
FORECAST_LOOKBACK = 750
FORECAST_STRIDE = 2
BACKTEST_FOLDS = 4
BACKTEST_WINDOW = 20
BACKTEST_MAX_AGE_DAYS = 7
MIN_OWN_RESIDUALS = 40
MIN_PRODUCT_HORIZON_ROWS = 100
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.10, 0.05
DEFAULT_BAND = (-0.1, 0.1)
YIELD_FOLDS = 3
YIELD_MIN_TRAIN_YEARS = 3
MIN_CROP_RESIDUALS = 30
ALERT_TEST_MONTHS = 6
MAX_PRICE_DELAY_BDAYS = 3
MAX_STAGE_AGE_DAYS = 10
HOURS_BETWEEN_NOTICES = 12
ANOMALY_TREES = 200
ANOMALY_SHARE = 0.07
ANOMALY_MIN_ROWS = 20
