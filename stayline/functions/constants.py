"""Fixed values.

Everything in this module is a FIXED VALUE that must equal the clinical
definitions the pipelines reproduce (category maps, item lists, score cuts,
comorbidity code groups and weights).  They are data, not logic: operators in
``stayline.operators`` take them as parameters.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: stay and cohort rules
# ---------------------------------------------------------------------------
GAP_TOL_HOURS = 24            # new stay when gap to the previous transfer > 24 h
MIN_ICU_LOS_HOURS = 48        # first stay kept when 48 h <= los <= 14 d
MAX_ICU_LOS_HOURS = 24 * 14
FINAL_MIN_LOS_HOURS = 7 * 24  # cohort finally restricted to los >= 168 h
MIN_AGE = 18
HORIZON_HOURS = 24            # label and score horizon
UNIT_PATTERN = r"ICU\)$|CCU\)$"
UNIT_EXTRACT = r".*\((.*)\)$"

# FIXED VALUES: care units kept as flags
CARE_UNITS = ["CCU", "CVICU", "MICU", "MICU/SICU", "Neuro SICU", "SICU", "TSICU"]

# FIXED VALUES: sex map
SEX_MAP = {"M": "Male", "F": "Female"}

# FIXED VALUES: category consolidation (target -> sources); unlisted values pass
ADMISSION_TYPE_MERGE = {
    "OBSERVATION ADMIT": ["EU OBSERVATION", "DIRECT OBSERVATION", "AMBULATORY OBSERVATION"],
}
ADMISSION_LOCATION_KEEP = ["EMERGENCY ROOM", "PHYSICIAN REFERRAL", "TRANSFER FROM HOSPITAL"]
DISCHARGE_LOCATION_MERGE = {
    "HOME": ["HOME HEALTH CARE"],
    "OTHER": ["OTHER FACILITY", "UNKNOWN", "ASSISTED LIVING", "HEALTHCARE FACILITY", "AGAINST ADVICE"],
}
ETHNICITY_MERGE = {
    "OTHER": ["UNABLE TO OBTAIN", "AMERICAN INDIAN/ALASKA NATIVE", "UNKNOWN"],
}

# FIXED VALUES: one-hot domains of the static table
STATIC_DOMAINS = {
    "gender": ["Female", "Male"],
    "Admission type": ["DIRECT EMER.", "ELECTIVE", "EW EMER.", "OBSERVATION ADMIT",
                       "SURGICAL SAME DAY ADMISSION", "URGENT"],
    "Admission location": ["EMERGENCY ROOM", "OTHER", "PHYSICIAN REFERRAL", "TRANSFER FROM HOSPITAL"],
    "Insurance": ["Medicaid", "Medicare", "Other"],
    "Ethnicity": ["ASIAN", "BLACK/AFRICAN AMERICAN", "HISPANIC/LATINO", "OTHER", "WHITE"],
}

# FIXED VALUES: body size items
HEIGHT_ITEMS = ["226730", "226707"]
WEIGHT_ITEMS = ["224639", "226512"]
MIN_WEIGHT_KG = 25
MIN_HEIGHT_M = 1

# FIXED VALUES: oxygen delivery device map (note the significant trailing spaces)
DEVICE_PREFIX = "O2 Delivery Device: "
DEVICE_MAP = {
    "Endotracheal tube": "O2 Delivery Device: IMV",
    "CPAP mask ": "O2 Delivery Device: NIPPV",
    "Bipap mask ": "O2 Delivery Device: NIPPV",
    "High flow neb": "O2 Delivery Device: HFNC",
    "High flow nasal cannula": "O2 Delivery Device: HFNC",
    "Tracheostomy tube": "O2 Delivery Device: Trach",
    "Trach mask ": "O2 Delivery Device: Trach",
    "Nasal cannula": "O2 Delivery Device: Supplemental Oxygen",
    "Aerosol-cool": "O2 Delivery Device: Supplemental Oxygen",
    "Face tent": "O2 Delivery Device: Supplemental Oxygen",
    "Non-rebreather": "O2 Delivery Device: Supplemental Oxygen",
    "Venti mask ": "O2 Delivery Device: Supplemental Oxygen",
    "Medium conc mask ": "O2 Delivery Device: Supplemental Oxygen",
    "Other": "O2 Delivery Device: Supplemental Oxygen",
    "T-piece": "O2 Delivery Device: Supplemental Oxygen",
    "Oxymizer": "O2 Delivery Device: Supplemental Oxygen",
    "Vapomist": "O2 Delivery Device: Supplemental Oxygen",
    "Ultrasonic neb": "O2 Delivery Device: Supplemental Oxygen",
}
DEVICE_LABEL = "O2 Delivery Device(s)"
DEVICE_LIMIT_ROWS = 14
CODE_STATUS_LABEL = "Code Status"
FULL_CODE = "Full code"
DNR = "DNR / DNI"

# FIXED VALUES: outlier limits
OUTLIER_LO, OUTLIER_HI = 0.01, 0.99
URINE_LO, URINE_HI = 0.10, 0.99

# FIXED VALUES: input items spread over hours
INPUT_LABELS = ["Packed Red Blood Cells", "Fresh Frozen Plasma", "Platelets"]
INPUT_CATEGORIES = {
    "Fluid Crystalloids": "02-Fluids (Crystalloids)",
    "Fluid Colloids": "04-Fluids (Colloids)",
}
# FIXED VALUES: urine output item ids
URINE_ITEMS = ["226559", "226560", "226561", "226584", "226563", "226564",
               "226565", "226567", "226557", "226558", "227488", "227489"]

# FIXED VALUES: hourly panel variables referenced by exact label
V = {
    "hr": "Heart Rate",
    "nisbp": "Non Invasive Blood Pressure systolic",
    "asbp": "Arterial Blood Pressure systolic",
    "nidbp": "Non Invasive Blood Pressure diastolic",
    "adbp": "Arterial Blood Pressure diastolic",
    "bun": "BUN",
    "cr": "Creatinine (serum)",
    "cvp": "Central Venous Pressure",
    "pao2": "Arterial O2 pressure",
    "fio2": "Inspired O2 Fraction",
    "flow": "Flow Rate (L/min)",
    "spo2": "O2 saturation pulseoxymetry",
    "bili": "Total Bilirubin",
    "inr": "INR",
}
PAO2_DEFAULT = 100
FIO2_ROOM_AIR = 21
FIO2_CAP = 100
FIO2_PER_LPM = 3

# FIXED VALUES: organ scores 0-4 (input, comparison, cuts for 1, 2, 3, 4)
SCORES = [
    ("SOFA Respiratory", "SpO2 FiO2 Ratio", "<=", [400, 300, 200, 100]),
    ("SOFA Cardiovascular", "PAR", ">", [10, 15, 20, 30]),
    ("SOFA Neurological", "GCS Total", "<", [15, 13, 10, 6]),
    ("SOFA Hepatic", "Total Bilirubin", ">=", [1.2, 2.0, 6.0, 12.0]),
    ("SOFA Hematologic", "INR", ">=", [1.1, 1.25, 1.5, 2.5]),
    ("SOFA Renal", "Creatinine (serum)", ">=", [1.2, 2.0, 3.5, 5.0]),
]

# FIXED VALUES: loss weights (primary, auxiliary, imputation)
LOSS_WEIGHTS = (1.0, 1.0, 0.1)

# FIXED VALUES: calibration bin edges are i * 0.1 for i in 0..10 (float products)
CALIBRATION_BINS = 10

# ---------------------------------------------------------------------------
# FIXED VALUES: comorbidity groups (Elixhauser) with the Moore 2017 weight and
# the ICD-10 and ICD-9 tokens.  Token grammar: exact code, ``x`` suffix = any
# continuation, ``lo-hi`` = range on the code prefix.
# ---------------------------------------------------------------------------
COMORBIDITY_GROUPS = [
    {"group": "Congestive heart failure", "moore17": 9,
     "icd10": ["I09.9", "I11.0", "I13.0", "I13.2", "I25.5", "I42.0", "I42.5-I42.9", "I43.x", "I50.x", "P29.0"],
     "icd9": ["398.91", "402.01", "402.11", "402.91", "404.01", "404.03", "404.11", "404.13", "404.91",
                "404.93", "425.4-425.9", "428.x"]},
    {"group": "Cardiac arrhythmias", "moore17": 0,
     "icd10": ["I44.1-I44.3", "I45.6", "I45.9", "I47.x-I49.x", "R00.0", "R00.1", "R00.8", "T82.1", "Z45.0",
                "Z95.0"],
     "icd9": ["426.0", "426.13", "426.7", "426.9", "426.10", "426.12", "427.0-427.4", "427.6-427.9", "785.0",
                "996.01", "996.04", "V45.0", "V53.3"]},
    {"group": "Valvular disease", "moore17": 0,
     "icd10": ["A52.0", "I05.x-I08.x", "I09.1", "I09.8", "I34.x-I39.x", "Q23.0-Q23.3", "Z95.2-Z95.4"],
     "icd9": ["093.2", "394.x-397.x", "424.x", "746.3-746.6", "V42.2", "V43.3"]},
    {"group": "Pulmonary circulation disorders", "moore17": 6,
     "icd10": ["I26.x", "I27.x", "I28.0", "I28.8", "I28.9"],
     "icd9": ["415.0", "415.1", "416.x", "417.0", "417.8", "417.9"]},
    {"group": "Peripheral vascular disorders", "moore17": 3,
     "icd10": ["I70.x", "I71.x", "I73.1", "I73.8", "I73.9", "I77.1", "I79.0", "I79.2", "K55.1", "K55.8",
                "K55.9", "Z95.8", "Z95.9"],
     "icd9": ["093.0", "437.3", "440.x", "441.x", "443.1-443.9", "447.1", "557.1", "557.9", "V43.4"]},
    {"group": "Hypertension, (complicated and uncomplicated)", "moore17": -1,
     "icd10": ["I10.x", "I11.x-I13.x", "I15.x"],
     "icd9": ["401.x", "402.x-405.x"]},
    {"group": "Paralysis", "moore17": 5,
     "icd10": ["G04.1", "G11.4", "G80.1", "G80.2", "G81.x", "G82.x", "G83.0-G83.4", "G83.9"],
     "icd9": ["334.1", "342.x", "343.x", "344.0-344.6", "344.9"]},
    {"group": "Other neurological disorders", "moore17": 5,
     "icd10": ["G10.x-G13.x", "G20.x-G22.x", "G25.4", "G25.5", "G31.2", "G31.8", "G31.9", "G32.x",
                "G35.x-G37.x", "G40.x", "G41.x", "G93.1", "G93.4", "R47.0", "R56.x"],
     "icd9": ["331.9", "332.0", "332.1", "333.4", "333.5", "333.92", "334.x-335.x", "336.2", "340.x", "341.x",
                "345.x", "348.1", "348.3", "780.3", "784.3"]},
    {"group": "Chronic pulmonary disease", "moore17": 3,
     "icd10": ["I27.8", "I27.9", "J40.x-J47.x", "J60.x-J67.x", "J68.4", "J70.1", "J70.3"],
     "icd9": ["416.8", "416.9", "490.x -505.x", "506.4", "508.1", "508.8"]},
    {"group": "Diabetes, uncomplicated", "moore17": 0,
     "icd10": ["E10.0", "E10.1", "E10.9", "E11.0", "E11.1", "E11.9", "E12.0", "E12.1", "E12.9", "E13.0",
                "E13.1", "E13.9", "E14.0", "E14.1", "E14.9"],
     "icd9": ["250.0-250.3"]},
    {"group": "Diabetes, complicated", "moore17": -3,
     "icd10": ["E10.2-E10.8", "E11.2-E11.8", "E12.2-E12.8", "E13.2-E13.8", "E14.2-E14.8"],
     "icd9": ["250.4-250.9"]},
    {"group": "Hypothyroidism", "moore17": 0,
     "icd10": ["E00.x-E03.x", "E89.0"],
     "icd9": ["240.9", "243.x", "244.x", "246.1", "246.8"]},
    {"group": "Renal failure", "moore17": 6,
     "icd10": ["I12.0", "I13.1", "N18.x", "N19.x", "N25.0", "Z49.0-Z49.2", "Z94.0", "Z99.2"],
     "icd9": ["403.01", "403.11", "403.91", "404.02", "404.03", "404.12", "404.13", "404.92", "404.93",
                "585.x", "586.x", "588.0", "V42.0", "V45.1", "V56.x"]},
    {"group": "Liver disease", "moore17": 4,
     "icd10": ["B18.x", "I85.x", "I86.4", "I98.2", "K70.x", "K71.1", "K71.3-K71.5", "K71.7", "K72.x-K74.x",
                "K76.0", "K76.2-K76.9", "Z94.4"],
     "icd9": ["070.22", "070.23", "070.32", "070.33", "070.44", "070.54", "070.6", "070.9", "456.0-456.2",
                "570.x", "571.x", "572.2-572.8", "573.3", "573.4", "573.8", "573.9", "V42.7"]},
    {"group": "Peptic ulcer disease excluding bleeding", "moore17": 0,
     "icd10": ["K25.7", "K25.9", "K26.7", "K26.9", "K27.7", "K27.9", "K28.7", "K28.9"],
     "icd9": ["531.7", "531.9", "532.7", "532.9", "533.7", "533.9", "534.7", "534.9"]},
    {"group": "AIDS/HIV", "moore17": 0,
     "icd10": ["B20.x-B22.x", "B24.x"],
     "icd9": ["042.x-044.x"]},
    {"group": "Lymphoma", "moore17": 6,
     "icd10": ["C81.x-C85.x", "C88.x", "C96.x", "C90.0", "C90.2"],
     "icd9": ["200.x-202.x", "203.0", "238.6"]},
    {"group": "Metastatic cancer", "moore17": 14,
     "icd10": ["C77.x-C80.x"],
     "icd9": ["196.x-199.x"]},
    {"group": "Solid tumor without metastasis", "moore17": 7,
     "icd10": ["C00.x-C26.x", "C30.x-C34.x", "C37.x-C41.x", "C43.x", "C45.x-C58.x", "C60.x-C76.x", "C97.x"],
     "icd9": ["140.x-172.x", "174.x-195.x"]},
    {"group": "Rheumatoid arthritis/collagen vascular diseases", "moore17": 0,
     "icd10": ["L94.0", "L94.1", "L94.3", "M05.x", "M06.x", "M08.x", "M12.0", "M12.3", "M30.x", "M31.0-M31.3",
                "M32.x-M35.x", "M45.x", "M46.1", "M46.8", "M46.9"],
     "icd9": ["446.x", "701.0", "710.0-710.4", "710.8", "710.9", "711.2", "714.x", "719.3", "720.x", "725.x",
                "728.5", "728.89", "729.30"]},
    {"group": "Coagulopathy", "moore17": 11,
     "icd10": ["D65-D68.x", "D69.1", "D69.3-D69.6"],
     "icd9": ["286.x", "287.1", "287.3-287.5"]},
    {"group": "Obesity", "moore17": -5,
     "icd10": ["E66.x"],
     "icd9": ["278.0"]},
    {"group": "Weight loss", "moore17": 9,
     "icd10": ["E40.x-E46.x", "R63.4", "R64"],
     "icd9": ["260.x-263.x", "783.2", "799.4"]},
    {"group": "Fluid and electrolyte disorders", "moore17": 11,
     "icd10": ["E22.2", "E86.x", "E87.x"],
     "icd9": ["253.6", "276.x"]},
    {"group": "Blood loss anemia", "moore17": -3,
     "icd10": ["D50.0"],
     "icd9": ["280.0"]},
    {"group": "Deficiency anemia", "moore17": -2,
     "icd10": ["D50.8", "D50.9", "D51.x-D53.x"],
     "icd9": ["280.1-280.9", "281.x"]},
    {"group": "Alcohol abuse", "moore17": -1,
     "icd10": ["F10", "E52", "G62.1", "I42.6", "K29.2", "K70.0", "K70.3", "K70.9", "T51.x", "Z50.2", "Z71.4",
                "Z72.1"],
     "icd9": ["265.2", "291.1-291.3", "291.5-291.9", "303.0", "303.9", "305.0", "357.5", "425.5", "535.3",
                "571.0-571.3", "980.x", "V11.3"]},
    {"group": "Drug abuse", "moore17": -7,
     "icd10": ["F11.x-F16.x", "F18.x", "F19.x", "Z71.5", "Z72.2"],
     "icd9": ["292.x", "304.x", "305.2-305.9", "V65.42"]},
    {"group": "Psychoses", "moore17": -5,
     "icd10": ["F20.x", "F22.x-F25.x", "F28.x", "F29.x", "F30.2", "F31.2", "F31.5"],
     "icd9": ["293.8", "295.x", "296.04", "296.14", "296.44", "296.54", "297.x", "298.x"]},
    {"group": "Depression", "moore17": -5,
     "icd10": ["F20.4", "F31.3-F31.5", "F32.x", "F33.x", "F34.1", "F41.2", "F43.2"],
     "icd9": ["296.2", "296.3", "296.5", "300.4", "309.x", "311"]},
]

PRIOR_PREFIX = "(Prior Elixhauser) "
PRIOR_SCORE = "(Prior Elixhauser) Moore17"
