"""Fixed values that results depend on.

FIXED VALUES -- these must stay exactly as written (labels, cut points, codes, weights).
"""

# Risk classes, ordinal 0..4, and their labels.
RISK_LABELS = ["Sin siniestro", "Riesgo bajo", "Riesgo medio", "Riesgo alto", "Pérdida crítica"]
# Upper bounds (inclusive) of the loss ratio for classes 1, 2 and 3; ratio 0 is class 0,
# anything above the last bound is class 4.
RISK_CUTS = [0.10, 0.40, 0.75]
# Keywords searched, in this order, in the ASCII-folded label (class = position).
RISK_KEYWORDS = ["sin", "bajo", "medio", "alto"]

# Production cycles (Idciclo -> name) and water modes (Idmodalidad -> name).
CYCLES = {1: "Primavera-Verano", 2: "Otoño-Invierno", 3: "Perennes"}
MODES = {1: "Riego", 2: "Temporal"}

# Column groups of a record.
ID_COLUMNS = ["Anio", "Idestado", "Idmunicipio", "Idciclo", "Idmodalidad", "Idcultivo"]
CATEGORY_COLUMNS = ["Nomestado", "Nommunicipio", "Nomcicloproductivo", "Nommodalidad", "Nomcultivo"]
MEASURES = ["Sembrada", "Siniestrada", "Cosechada", "Volumenproduccion", "Rendimiento",
            "Precio", "Valorproduccion"]
STRUCTURAL_NULL_COLUMNS = ["Precio", "Rendimiento", "Valorproduccion", "Volumenproduccion"]

# Pre-harvest features (native categories) and the coded feature set.
FEATURES_SOWING = ["Nomestado", "Nomcicloproductivo", "Nommodalidad", "Nomcultivo",
                   "Sembrada", "Precio"]
CAT_FEATURES = ["Nomestado", "Nomcicloproductivo", "Nommodalidad", "Nomcultivo"]
# Post-harvest columns: known only after the loss happened, refused as model inputs.
POST_HARVEST = ["Siniestrada", "Cosechada", "Volumenproduccion", "Rendimiento",
                "Valorproduccion", "proporcion_siniestro", "nivel_riesgo", "target"]

# Renames applied when yearly files are integrated.
YEAR_FILE_RENAMES = {"Nomcultivo Sin Um": "Nomcultivo", "Preciomediorural": "Precio"}

# Composite model score weights: F2 of the critical class, balanced accuracy,
# quadratic kappa, macro F1.
SCORE_WEIGHTS = {"f2_critica": 0.50, "bal_acc": 0.25, "kappa_cuad": 0.15, "f1_macro": 0.10}

# Climate: source parameter codes -> column names; missing-value sentinel.
CLIMATE_CODES = {"PRECTOTCORR": "precip_mm_dia", "T2M": "temp_media_c", "T2M_MAX": "temp_max_c",
                 "T2M_MIN": "temp_min_c", "RH2M": "humedad_rel_pct", "WS10M": "viento_ms"}
CLIMATE_MISSING = -999.0
CLIMATE_CYCLE_MEASURES = ["precip_mm_mes", "temp_media_c", "temp_max_c", "temp_min_c",
                          "humedad_rel_pct", "viento_ms", "spei_03", "spei_06", "spei_12"]
SPEI_SCALES = (3, 6, 12)
# Mid-month day of year used by the daylight formula, months 1..12.
MID_MONTH_DOY = [15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349]
# Thornthwaite constants.
HEAT_EXP = 1.514
HEAT_A_COEF = (6.75e-7, -7.71e-5, 1.792e-2, 0.49239)
PET_HOT_T = 26.5
PET_HOT_COEF = (-415.85, 32.24, -0.43)
ZSCORE_EPS = 1e-9

# State centroids (Idestado, lat, lon), 32 states.
STATE_CENTROIDS = [
    (1, 21.84, -102.30), (2, 30.10, -115.25), (3, 25.08, -111.66), (4, 19.01, -90.53),
    (5, 27.29, -102.08), (6, 19.12, -103.72), (7, 16.75, -92.64), (8, 28.63, -106.07),
    (9, 19.43, -99.13), (10, 24.44, -104.66), (11, 20.92, -101.22), (12, 17.61, -100.29),
    (13, 20.42, -98.74), (14, 20.59, -103.34), (15, 19.30, -99.67), (16, 19.21, -101.91),
    (17, 18.73, -99.10), (18, 21.75, -104.75), (19, 25.59, -99.99), (20, 17.07, -96.73),
    (21, 18.87, -97.86), (22, 20.81, -100.13), (23, 19.18, -88.48), (24, 22.15, -100.97),
    (25, 24.91, -107.48), (26, 29.42, -110.44), (27, 18.00, -92.92), (28, 24.22, -98.84),
    (29, 19.46, -98.24), (30, 19.38, -96.33), (31, 20.58, -89.13), (32, 23.03, -102.57),
]

# Clustering defaults.
MIN_MUNICIPAL_AREA = 0.1
CLUSTER_FEATURES = ["log_Sembrada_total", "proporcion_siniestro_total", "prop_temporal",
                    "log_Rendimiento_medio", "log_Precio_medio", "log_Diversidad_cultivos"]

# Cluster profile names (short, long), fixed values under the numbers of the original
# profile; CANONICAL_CLUSTERS lists those numbers by ascending loss share, the canonical order.
CANONICAL_CLUSTERS = (2, 1, 0, 3)
CLUSTER_NAMES = {
    0: ("Temporal Gran Escala", "Agricultura de Temporal de Gran Escala"),
    1: ("Agricultura Campesina", "Agricultura Tradicional de Temporal y Subsistencia a Pequeña Escala"),
    2: ("Riego Comercial", "Corredores Agrícolas Comerciales de Riego y Alta Productividad"),
    3: ("Vulnerabilidad Crítica", "Zonas de Siniestralidad Crónica y Vulnerabilidad Climática Crítica"),
}
