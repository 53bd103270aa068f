"""Fixed values of the intensive-care source schema: item codes, limits, word lists and weights.

These are given by the source database and the published scores and must stay as they are.
"""

from __future__ import annotations

# --- suspicion of infection: fixed word lists -------------------------------------------------
ANTIBIOTICS = [
    "adoxa", "ala-tet", "alodox", "amikacin", "amikin", "amoxicillin", "amoxicillin%clavulanate", "clavulanate", "ampicillin",
    "augmentin", "avelox", "avidoxy", "azactam", "azithromycin", "aztreonam", "axetil", "bactocill", "bactrim", "bethkis",
    "biaxin", "bicillin l-a", "cayston", "cefazolin", "cedax", "cefoxitin", "ceftazidime", "cefaclor", "cefadroxil",
    "cefdinir", "cefditoren", "cefepime", "cefotetan", "cefotaxime", "cefpodoxime", "cefprozil", "ceftibuten", "ceftin",
    "cefuroxime", "cephalexin", "chloramphenicol", "cipro", "ciprofloxacin", "claforan", "clarithromycin", "cleocin",
    "clindamycin", "cubicin", "dicloxacillin", "doryx", "doxycycline", "duricef", "dynacin", "ery-tab", "eryped", "eryc",
    "erythrocin", "erythromycin", "factive", "flagyl", "fortaz", "furadantin", "garamycin", "gentamicin", "kanamycin",
    "keflex", "ketek", "levaquin", "levofloxacin", "lincocin", "macrobid", "macrodantin", "maxipime", "mefoxin",
    "metronidazole", "minocin", "minocycline", "monodox", "monurol", "morgidox", "moxatag", "moxifloxacin", "myrac",
    "nafcillin sodium", "nicazel doxy 30", "nitrofurantoin", "noroxin", "ocudox", "ofloxacin", "omnicef", "oracea", "oraxyl",
    "oxacillin", "pc pen vk", "pce dispertab", "panixine", "pediazole", "penicillin", "periostat", "pfizerpen",
    "piperacillin", "tazobactam", "primsol", "proquin", "raniclor", "rifadin", "rifampin", "rocephin", "smz-tmp", "septra",
    "septra ds", "solodyn", "spectracef", "streptomycin sulfate", "sulfadiazine", "sulfamethoxazole", "trimethoprim",
    "sulfatrim", "sulfisoxazole", "suprax", "synercid", "tazicef", "tetracycline", "timentin", "tobi", "tobramycin", "unasyn",
    "vancocin", "vancomycin", "vantin", "vibativ", "vibra-tabs", "vibramycin", "zinacef", "zithromax", "zmax", "zosyn",
    "zyvox",
]
DRUG_TYPES = ["MAIN", "ADDITIVE"]
EXCLUDED_ROUTES = ["OU", "OS", "OD", "AU", "AS", "AD", "TP"]
EXCLUDED_ROUTE_WORDS = ["ear", "eye"]
EXCLUDED_DRUG_WORDS = ["cream", "desensitization", "ophth oint", "gel"]
SEPSIS_DIAGNOSES = ["78552", "99591", "99592"]

# --- mechanical ventilation: fixed item codes and device texts --------------------------------
VENT_TYPE_CODES = {720: "Other/Remarks", 223848: "Other"}  # any text but this one means ventilated
VENT_MODE_CODE = 223849
OXYGEN_DEVICE_CODE = 467
VENTILATOR_TEXT = "Ventilator"
VENT_SETTING_CODES = [
    445, 448, 449, 450, 1340, 1486, 1600, 224687,  # minute volume
    639, 654, 681, 682, 683, 684, 224685, 224684, 224686,  # tidal volume
    218, 436, 535, 444, 459, 224697, 224695, 224696, 224746, 224747,  # inspiratory force
    221, 1, 1211, 1655, 2000, 226873, 224738, 224419, 224750, 227187,  # inspiratory pressure
    543,  # plateau pressure
    5865, 5866, 224707, 224709, 224705, 224706,  # airway pressure release
    60, 437, 505, 506, 686, 220339, 224700,  # end-expiratory pressure
    3459,  # high pressure relief
    501, 502, 503, 224702,  # pressure control
    223, 667, 668, 669, 670, 671, 672,  # volume and pressure control
    224701,  # pressure support
]
# Setting 459 has a meaning above but is not read from the chart.
VENT_UNREAD_CODES = [459]
OXYGEN_DEVICES = {
    226732: [
        "Nasal cannula", "Face tent", "Aerosol-cool", "Trach mask ", "High flow neb", "Non-rebreather", "Venti mask ",
        "Medium conc mask ", "T-piece", "High flow nasal cannula", "Ultrasonic neb", "Vapomist",
    ],
    467: [
        "Cannula", "Nasal Cannula", "Face Tent", "Aerosol-Cool", "Trach Mask", "Hi Flow Neb", "Non-Rebreather",
        "Venti Mask", "Medium Conc Mask", "Vapotherm", "T-Piece", "Hood", "Hut", "TranstrachealCat", "Heated Neb",
        "Ultrasonic Neb",
    ],
}
EXTUBATION_CODE = 640
EXTUBATED_TEXTS = ["Extubated", "Self Extubation"]
SELF_EXTUBATED_TEXT = "Self Extubation"
OTHER_OXYGEN_CODES = [468, 469, 470, 471, 227287, 226732, 223834]
EXTUBATION_PROCEDURES = [227194, 225468, 225477]
SELF_EXTUBATION_PROCEDURE = 225468
VENT_GAP_HOURS = 8

# --- blood gas: fixed item codes, limits and regression weights -------------------------------
GAS_LABELS = {
    50800: "specimen", 50801: "aado2", 50803: "bicarbonate", 50804: "totalco2", 50811: "hemoglobin", 50813: "lactate",
    50815: "o2flow", 50816: "fio2", 50817: "so2", 50818: "pco2", 50820: "ph", 50821: "po2",
}
GAS_LOWER = {50816: 20}
GAS_UPPER = {50816: 100, 50817: 100, 50815: 70, 50821: 800}
SPO2_CODES = [646, 220277]
FIO2_BANDED_CODE = 223835
FIO2_PERCENT_CODES = [3420, 3422]
FIO2_FRACTION_CODE = 190
ARTERIAL_INTERCEPT = -0.02544
ARTERIAL_TERMS = [
    # column, weight, mean, adjustment when missing
    ("po2", 0.04598, None, None),
    ("spo2", -0.15356, 97.49420, 0.13429),
    ("fio2_chart", 0.00621, 51.49550, -0.24958),
    ("hemoglobin", 0.10559, 10.32307, 0.05954),
    ("so2", 0.13251, 93.66539, -0.23172),
    ("pco2", -0.01511, 42.08866, -0.01630),
    ("fio2", 0.01480, 63.97836, -0.31142),
    ("aado2", -0.00200, 442.21186, -0.01328),
    ("bicarbonate", -0.03220, 22.96894, -0.06535),
    ("totalco2", 0.05384, 24.72632, -0.01405),
    ("lactate", 0.08202, 3.06436, 0.06038),
    ("ph", 0.10956, 7.36233, -0.00617),
    ("o2flow", 0.00848, 7.59362, -0.35803),
]
ARTERIAL_CUTOFF = 0.75

# --- circulation: fixed item codes and unit factors -------------------------------------------
LB_TO_KG = 0.45359237
OZ_TO_KG = 0.0283495231
WEIGHT_FACTORS = {762: 1.0, 763: 1.0, 3723: 1.0, 3580: 1.0, 226512: 1.0, 3581: LB_TO_KG, 3582: OZ_TO_KG}
MEAN_PRESSURE_CODES = [456, 52, 6702, 443, 220052, 220181, 225312]
# drug: (codes per unit of weight, codes already per weight)
PRESSOR_CODES_OLD = {
    "norepinephrine": ([30047], [30120]),
    "epinephrine": ([30044], [30119, 30309]),
    "dopamine": ([], [30043, 30307]),
    "dobutamine": ([], [30042, 30306]),
}
PRESSOR_CODES_NEW = {
    "norepinephrine": ([], [221906]),
    "epinephrine": ([], [221289]),
    "dopamine": ([], [221662]),
    "dobutamine": ([], [221653]),
}
REWRITTEN = "Rewritten"
ECHO_CLOCK = r"Date/Time: [\[\]0-9*-]+ at ([0-9:]+)"
ECHO_WEIGHT = r"Weight \(lb\): (.*?)\n"

# --- consciousness: fixed item codes ----------------------------------------------------------
COMA_CODES = {723: "verbal", 223900: "verbal", 454: "motor", 223901: "motor", 184: "eyes", 220739: "eyes"}
COMA_SENTINELS = {723: "1.0 ET/Trach", 223900: "No Response-ETT"}
COMA_NORMAL = {"motor": 6, "verbal": 5, "eyes": 4}
COMA_BEST = 15

# --- kidney, liver and coagulation: fixed item codes and limits -------------------------------
URINE_CODES = [
    40055, 43175, 40069, 40094, 40715, 40473, 40085, 40057, 40056, 40405, 40428, 40086, 40096, 40651,
    226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489,
]
IRRIGANT_IN = 227488
# lab: (code, upper limit, worst value of an hour)
SCORE_LABS = {"platelet": (51265, 10000, "min"), "bilirubin": (50885, 150, "max"), "creatinine": (50912, 150, "max")}

# --- vital signs around the index time: (codes, low, high, high included, low included, name) ---
VITALS = [
    ([220045], 0, 300, 0, 0, "heartrate"),
    ([220179, 220050, 225309], 0, 400, 0, 0, "sysbp"),
    ([8368, 8440, 8441, 8555, 220180, 220051, 225310], 0, 300, 0, 0, "diabp"),
    ([220052, 220181, 225312], 0, 300, 0, 0, "meanbp"),
    ([220210, 224690], 0, 70, 0, 0, "resprate"),
    ([223761, 678], 70, 120, 0, 0, "tempc"),
    ([223762, 676], 10, 50, 0, 0, "tempc"),
    ([646, 220277], 0, 100, 1, 0, "spo2_pulsoxy"),
    ([807, 811, 1529, 3745, 3744, 225664, 220621, 226537], 0, None, 0, 0, "glucose_chart"),
    ([228369, 224842, 220088, 227543], 0, None, 0, 0, "cardiacoutput"),
    ([228374, 227547], 0, None, 0, 0, "sv"),
    ([228375], 0, None, 0, 1, "svi"),
    ([228376, 227546], None, None, 0, 0, "svv"),
    ([228380], None, None, 0, 0, "tfc"),
    ([228381], None, None, 0, 0, "tpr"),
    ([224684], 0, None, 0, 0, "tvset"),
    ([224685], 0, None, 0, 0, "tvobserved"),
    ([224686], 0, None, 0, 0, "tvspontaneous"),
    ([224691], 0, None, 0, 1, "flowrate"),
    ([224695], 0, None, 0, 1, "peakinsppressure"),
    ([224700], 0, None, 0, 1, "totalpeeplevel"),
    ([220218], 0, None, 0, 0, "vitalcapacity"),
    ([223834, 227582], 0, None, 0, 1, "o2flow"),
    ([223835], 0, None, 0, 1, "fio2"),
    ([227444], 0, None, 0, 1, "crp"),
]
# Codes that have a rule but are not read from the chart.
VITALS_UNREAD_CODES = [8368, 8440, 8441, 8555, 678, 676, 646, 807, 811, 1529, 3745, 3744]
FAHRENHEIT_CODES = [223761, 678]
# Named concept without an output column.
VITALS_HIDDEN = "glucose_chart"
VITAL_COLUMNS = ["sysbp", "diabp", "meanbp", "resprate", "heartrate", "spo2_pulsoxy", "tempc"]

# --- laboratory values around the index time: code: (name, upper limit) ------------------------
LABS = {
    50868: ("aniongap", 10000), 50862: ("albumin", 10), 51144: ("bands", 100), 50882: ("bicarbonate", 10000),
    50885: ("bilirubin", 150), 50912: ("creatinine", 150), 50806: ("chloride", 10000), 50902: ("chloride", 10000),
    50809: ("glucose", 10000), 50931: ("glucose", 10000), 50810: ("hematocrit", 100), 51221: ("hematocrit", 100),
    50811: ("hemoglobin", 50), 51222: ("hemoglobin", 50), 50813: ("lactate", 50), 51265: ("platelet", 10000),
    50822: ("potassium", 30), 50971: ("potassium", 30), 51275: ("ptt", 150), 51237: ("inr", 50), 51274: ("pt", 150),
    50824: ("sodium", 200), 50983: ("sodium", 200), 51006: ("bun", 300), 51300: ("wbc", 1000), 51301: ("wbc", 1000),
    50924: ("ferritin", 10000), 50998: ("transferrin", 10000), 50910: ("creatinekinase", 20000), 50911: ("ck_mb", 10000),
    50915: ("d_dimer", 100000), 50963: ("ntprobnp", 100000), 51288: ("sedimentationrate", 5000),
    51214: ("fibrinogen", 10000), 50954: ("ldh", 10000), 50960: ("magnesium", 50), 50808: ("calcium_free", 50),
    50821: ("po2_bloodgas", 1000), 50820: ("ph_bloodgas", 15), 50818: ("pco2_bloodgas", 500), 50817: ("so2_bloodgas", 100),
    51003: ("troponin_t", 100), 51014: ("glucose_csf", 10000), 51024: ("total_protein_joint_fluid", 100),
    51059: ("total_protein_pleural", 100), 51070: ("urine_albumin_creatinine_ratio", 100000), 51128: ("wbc_ascites", 100000),
}
LAB_COLUMNS = [
    "bicarbonate", "creatinine", "chloride", "glucose", "hematocrit", "hemoglobin", "lactate", "platelet", "potassium",
    "ptt", "inr", "pt", "sodium", "bun", "wbc", "magnesium", "ph_bloodgas",
]

# --- cohort and model inputs: fixed rules -----------------------------------------------------
ADULT_OVER_AGE = 14
DATA_SOURCE = "metavision"
MIN_HOURS = 0.5
SERIES_VARIABLES = VITAL_COLUMNS + LAB_COLUMNS
ETHNIC_GROUPS = {
    "black": ["BLACK/AFRICAN AMERICAN", "BLACK/CAPE VERDEAN", "BLACK/AFRICAN", "BLACK/HAITIAN"],
    "white": ["WHITE", "WHITE - RUSSIAN", "WHITE - BRAZILIAN", "PORTUGUESE"],
    "asian": [
        "ASIAN", "ASIAN - VIETNAMESE", "ASIAN - CHINESE", "ASIAN - CAMBODIAN", "ASIAN - ASIAN INDIAN", "ASIAN - OTHER",
        "ASIAN - FILIPINO",
    ],
    "hispanic": [
        "HISPANIC/LATINO - PUERTO RICAN", "HISPANIC OR LATINO", "HISPANIC/LATINO - SALVADORAN",
        "HISPANIC/LATINO - DOMINICAN", "HISPANIC/LATINO - MEXICAN", "HISPANIC/LATINO - GUATEMALAN",
    ],
    "notgiven": ["na", "UNKNOWN/NOT SPECIFIED", "UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"],
    "middle eastern": ["MIDDLE EASTERN"],
    "other": ["NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "OTHER", "MULTI RACE ETHNICITY"],
}
