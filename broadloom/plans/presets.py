"""Fixed values of the marketing-lead tables: thresholds, limits, name rules and bins.

Rule tables with organisation-specific values are not listed here; read them as ``(var, val, bin)``
files and pass them to :func:`broadloom.operators.binning.bin_by_table`.
"""

from __future__ import annotations

from broadloom.operators.binning import KEEP, BinRule

# --- fixed values: thresholds and limits ---
STRENGTH = 0.85
STRICT_SIGNED = 0.99
NAMES_PER_LINE = 15
CHUNK_SIZE = 200
CHUNK_RUNS = 11
FINAL_RUNS = 20
FILTERED_RUNS = 15
BEST_PER_TARGET = 150
RESAMPLE_FOLDS = 5
RESAMPLE_REPEATS = 5
SUBSET_SIZES_CODES = (1, 5, 25)
SUBSET_SIZES_ALL = (1, 5, 10, 25, 50)
TRAIN_SHARE = 0.8
SEED = 12345
LEVELS_TRENDS = 4
LEVELS_PREPARED = 10
BLANK_CODE = "     "

# --- fixed values: field types by name, the first match wins ---
TAXONOMY = (
    ("contains", "INDIV_SUM_I", "PIPE INDIV"),
    ("contains", "COMP_SUM_C", "PIPE COMP"),
    ("starts", "INTR_", "INTR"),
    ("starts", "PAG_", "WEB"),
    ("starts", "PG", "WEB"),
    ("contains", "_OFFER_", "OFFER"),
    ("starts", "CHN_", "CHANNEL"),
    ("starts", "BJ_", "BJ"),
    ("starts", "UT10", "LAST TOUCH"),
    ("starts", "COMP_INST", "COMP INST"),
)
TAXONOMY_WITH_YIELDS = (
    ("contains", "INDIV_SUM_I", "PIPE INDIV"),
    ("contains", "INDIV_YIELD_I", "PIPE INDIV"),
    ("contains", "COMP_SUM_C", "PIPE COMP"),
    ("contains", "COMP_YIELD_C", "PIPE COMP"),
    *TAXONOMY[2:],
)

# --- fixed values: bins of the general-purpose fields ---
COMP_REV_SEG = BinRule(
    "COMP_REV_SEG",
    {
        "[0,5M)": [
            "A: 0", "B: $1 to $2.4k", "C: $2.5k to $4.9k", "D: $5k to $9.9k", "E: $10k to $19.9k",
            "F: $20k to $49.9k", "G: $50k to $99.9k", "H: $100k to $499.9k", "I: $500k to $999.9k",
            "J: $1mm to $4.9mm",
        ],
        "[100M,inf)": ["O: $100mm+"],
        "[5M, 100M)": ["K: $5mm to $9.9mm", "L: $10mm to $24.9mm", "M: $25mm to $49.9mm", "N: $50mm to $99.9mm"],
    },
)
EMP_CNT_SEG = BinRule(
    "EMP_CNT_SEG",
    {
        "[0,100)": ["A: 0", "B: 1 to 99"],
        "[100,5k)": ["C: 100 to 999", "D: 1k to 4.9k"],
        "[50k,inf)": ["G: 50k to 99.9k"],
        "[5k,50k)": ["E: 5k to 9.9k", "F: 10k to 49.9k"],
        "BIN_A": ["H: 100k to 249.9k", "I: 250k+"],
    },
)
INDUSTRY = BinRule(
    "INDUSTRY",
    {
        "BIN_A": [
            "Energy & Utilities", "Banking", "Government, Central/Federal", "Government, State/Provincial/Local",
            "Consumer Products", "Insurance", "Travel & Transportation",
        ],
        "BIN_B": [
            "Chemicals & Petroleum", "Aerospace & Defense", "Automotive", "Life Sciences", "Financial Markets", "Retail",
        ],
        "BIN_C": [
            "Industrial Products", "Telecommunications", "Healthcare", "Electronics", "Media & Entertainment",
            "Wholesale Distribution & Services",
        ],
        "BIN_D": ["Computer Services", "Professional Services", "Exclusions", "Education"],
    },
)
INDUSTRY_SECOND = BinRule(
    "INDUSTRY",
    {
        "BIN_CGHJ": ["Media & Entertainment", "Professional Services", "Wholesale Distribution & Services"],
        "BIN_FIN": ["Consumer Products", "Insurance", "Retail"],
        "BIN_LOW": ["Education", "Exclusions", "Unknown"],
        "BIN_NCA": ["Banking", "Energy & Utilities", "Government, Central/Federal", "Government, State/Provincial/Local"],
        "BIN_WAT": ["Healthcare", "Life Sciences"],
    },
    missing="BIN_OTHER",
    other="BIN_OTHER",
)
JOB_FUNCTION = BinRule(
    "JOB_FUNCTION",
    {
        "BIN_A": [
            "Transport & Travel Professions", "Information Tech Professions", "Govt & Civil Svc Professions",
            "Retail/Wholesale and Services",
        ],
        "BIN_B": [
            "Finance/Insurance Professions", "Distribution/Storage/Logistics", "Business Admin/Operations/Svcs",
        ],
        "BIN_C": [
            "Sales and Marketing Professions", "Processing/Manufac/Engineering", "Life/Physical/Social Sciences",
            "Health Discipline Professions", "Executive Professions", "Unknown", "Legal Professions",
        ],
        "BIN_D": ["Other", "Educational Professions"],
    },
)
MARKET_INTERACTION = BinRule(
    "MARKET_INTERACTION",
    {
        "EMSG": ["EMSG"],
        "RESP": [
            "DISPLAY", "EARNED", "FACE-TO-FACE EVENT", "OTHER", "OWNED SOCIAL", "SEARCH", "CONTENT SYNDICATION",
            "PAID SOCIAL", "PRE-EVENT REGISTRATION / CONFIRMATION", "WEBCAST", "AFFILIATE", "DIGITAL OTHER",
            "LANDING PAGE",
        ],
    },
)
CHANNEL_NAME = BinRule(
    "CHANNEL_NAME", {"DIGITAL INBOUND": ["Digital Inbound"], "EVENT": ["Event"]}, missing="NULL", other="OTHER"
)
CHANNEL_TYPE = BinRule(
    "CHANNEL_TYPE",
    {
        "CONT SYND": ["Content Syndication"],
        "EMAIL": ["Email"],
        "EPEOS": ["External-OB Telemarketing", "External-Purchased"],
        "F2F OTH": ["Other", "Face to Face"],
        "VR LP HYB": ["Hybrid", "Virtual", "Landing Page"],
    },
    missing="EPEOS",
    other="F2F OTH",
)
PARENT_ASSET_BUYERS_JOURNEY = BinRule(
    "PARENT_ASSET_BUYERS_JOURNEY", {"BUY ADOPT ADVOCATE": ["Adopt", "Buy", "Advocate"]}, missing="NULL", other=KEEP
)
# fields whose bins come from a rule file: (field, missing, other, values that count as missing)
FROM_RULE_FILE = (
    BinRule("BUS_AREA_NAME", missing="UNKNOWN", other="NULL"),
    BinRule("UT_LVL_30_CD_INTENT_NEW", missing="UNKNOWN", other="OTHER", blanks=(BLANK_CODE,)),
    BinRule("UT_LVL_20_CD_INTENT_NEW", missing="UNKNOWN", other="OTHER", blanks=(BLANK_CODE,)),
    BinRule("UT_LVL_15_CD_INTENT_NEW", missing="UNKNOWN", other="OTHER"),
    BinRule("PROGRAM_NAME", missing="NULL", other="OTHER"),
)
