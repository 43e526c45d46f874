"""Word lists, patterns, ranges and limits the results depend on.

Everything here is data. The patterns are written in the common regex subset; ``functions.text.java``
turns them into the dialect Spark's engine needs. Nothing in this module is logic.
"""

# ---- fixed values: limits ---------------------------------------------------------------------
PARAGRAPH_PACK_CHARS = 1000      # packer target size
SPLIT_MAX_CHARS = 1500           # splitter window
SPLIT_OVERLAP = 200              # characters shared by neighbouring pieces
FINAL_K = 5                      # answers kept after fusion
RRF_K = 60                       # rank fusion constant
BOOST_FETCH = 3                  # candidates fetched by an intent boost
BOOST_KEEP = 2                   # candidates a boost puts in front
EVAL_POOL = 10                   # candidates per question in evaluation
POSTFILTER_FACTOR = 3            # over-fetch before the lexical subsystem filter
DOCUMENT_CHARS = 8000            # stored body length
HEADING_CHARS = 400              # stored heading length
CONTEXT_CHARS = 2000             # body length inside a context block
PAGE_EXCERPT_CHARS = 600         # page text given to the captioner
CITATION_HEADING_CHARS = 55      # heading length shown in a citation
CITATION_KEY_CHARS = 40          # heading length that identifies a citation
TEXT_PAGE_CHARS = 50             # a page with more characters counts as a text page
OCR_WARN_SHARE = 0.3             # share of image-only pages that triggers the warning
IMAGE_MIN_BYTES = 5000
IMAGE_MIN_PIXELS = 60
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# ---- fixed values: separators the splitter tries, in order ------------------------------------
SPLIT_SEPARATORS = [". ", ".\n", "\n\n", "\n", " "]

# ---- fixed values: subsystem keywords for stored text, first match wins -------------------------
SUBSYSTEM_KEYWORDS = [
    ("OBC", r"\bOBC\b"),
    ("AOCS", r"\bAOCS\b"),
    ("DTG", r"\bDTG\b|\bGYRO\b|\bCSA\b"),
    ("SENSOR", r"\bSTAR SENSOR\b"),
    ("WHEEL", r"\bWHEEL\b|\bWDE\b|\bSUSPENSION\b"),
    ("MECHANISM", r"\bMECHANISM\b|\bHGA\b|\bSPDM\b|\bMCE\b|\bVELC COVER\b|\bSOLEX COVER\b"),
    ("PROPULSION", r"\bPROPULSION\b|\bLATCH VALVE\b|\bTHRUSTER\b|\bFUEL\b|\bOXIDISER\b"),
    ("POWER", r"\bFPGA\b|\bBATTERY\b|\bTCR\b|\bDC-DC\b"),
    ("TTC_XBAND", r"\bTTC\b|\bX-BAND\b|\bTRANSPONDER\b|\bTWTA\b|\bXBS\b"),
    ("PAYLOAD", r"\bPAPA\b|\bASPEX\b|\bSOLEXS\b|\bHELIOS\b|\bSUIT\b|\bVELC\b|\bMAGNETOMETER\b"),
    ("ODHS", r"\bODHS\b|\bSSR\b|\bDFU\b|\bBDH\b"),
]

# ---- fixed values: procedure-number ranges, inclusive, first match wins -------------------------
SUBSYSTEM_RANGES = [
    (5000, 5099, "AOCS"),
    (5200, 5299, "OBC"),
    (5400, 5499, "SENSOR"),
    (5551, 5560, "WHEEL"),
    (5601, 5620, "DTG"),
    (5650, 5665, "PROPULSION"),
    (5700, 5730, "POWER"),
    (5950, 5980, "MECHANISM"),
    (6000, 6050, "TTC_XBAND"),
    (6100, 6250, "PAYLOAD"),
    (6220, 6240, "ODHS"),
]

# ---- fixed values: subsystem keywords for questions, first match wins ---------------------------
QUESTION_KEYWORDS = [
    ("OBC", r"\bOBC\b"),
    ("AOCS", r"\bAOCS\b"),
    ("PAYLOAD", r"\bpayload\b|\bPAPA\b|\bASPEX\b|\bVELC\b|\bHELIOS\b|\bSOLEXS\b"),
    ("POWER", r"\bpower\b|\bbattery\b|\bFPGA\b|\bDC.DC\b"),
    ("DTG", r"\bDTG\b|\bgyro\b|\bCSA\b"),
    ("MECHANISM", r"\bHGA\b|\bmechanism\b|\bmotor\b|\bSPDM\b|\bMCE\b"),
    ("PROPULSION", r"\bthruster\b|\bpropulsion\b|\blatch valve\b|\bfuel\b"),
    ("TTC_XBAND", r"\bTTC\b|\bX.band\b|\btransponder\b|\breceiver\b|\bTWTA\b"),
    ("WHEEL", r"\bwheel\b|\bWDE\b|\bsuspension\b"),
    ("SENSOR", r"\bstar sensor\b"),
    ("ODHS", r"\bODHS\b|\bSSR\b|\bDFU\b"),
]

# ---- fixed values: command-id prefixes ----------------------------------------------------------
CID_PREFIXES = {
    "OBCS": "OBC",
    "OBCD": "OBC",
    "OBCA": "OBC",
    "DTGS": "DTG",
    "WDEA": "WHEEL",
    "PWRS": "POWER",
    "MECS": "MECHANISM",
    "TTCS": "TTC_XBAND",
    "PROS": "PROPULSION",
    "AOCS": "AOCS",
    "PLDA": "PAYLOAD",
    "ODHS": "ODHS",
    "SENS": "SENSOR",
}

# ---- fixed values: index labels, including one misspelling found in sources ---------------------
INDEX_LABELS = {
    "OBC": "OBC",
    "SENSOR": "SENSOR",
    "POWER": "POWER",
    "TTC&XBAND": "TTC_XBAND",
    "TTCXBAND": "TTC_XBAND",
    "DTG": "DTG",
    "WHEEL": "WHEEL",
    "MECHANISM": "MECHANISM",
    "PROPULSION": "PROPULSION",
    "AOCS": "AOCS",
    "PAYLOAD": "PAYLOAD",
    "PAYLAOD": "PAYLOAD",
    "ODHS": "ODHS",
}

# ---- fixed values: patterns over stored text ----------------------------------------------------
PROCEDURE_NUMBER = r"\b([56]\d{3})\b"
INDEX_ROW = r"(\d{1,3})\s*\.\s+([56]\d{3})\s+([A-Z][A-Z&]{1,})"
BODY_PROBE = r"\b[A-Z]+\s*-?\s*[56]\d{3}\s*:\s*.+"
BLOCK_HEADER = r"\b([A-Z]+)\s*-?\s*([56]\d{3})\s*:\s*(.+)"
BLOCK_END = "END OF PROCEDURE"
NUMBERED_HEADING = r"^\s*(\d+(?:\.\d+)*)\s+([A-Z][A-Z0-9\s\-/(),]{5,})$"
PROCEDURE_SIGNALS_ANY_CASE = [
    r"\bPROCEDURE\s*:",
    r"\bEND OF PROCEDURE\b",
    r"\bAPPLICABILITY\s*:",
]
PROCEDURE_SIGNALS = [
    r"\b[56]\d{3}\s*:",
    r"\b[56]\d{3}0\d{2}\b",
]
NOTE_SIGNAL = r"\bNOTES?\s*:"
LOG_ROW = (
    r"^\s{0,2}(\d{4})\s*\|\s*"
    r"([\w\-]+|-{4,})\s*\|\s*"
    r"([A-Z][A-Z0-9]{2,6}\d+|-{4,})\s*\|\s*"
    r"([^\|]{10,50}?)\s*\|\s*"
    r"(\d{4} \d{2} \d{2} \d{2}:\d{2}:\d{2}:\d{3})\s*\|"
    r"(.*?)\s*\|\s*"
    r"(.*?)\s*\|\s*"
    r"(\d{3,6})\s*\|\s*"
    r"(\w+)\s*\|\s*"
    r"(\w+)\s*\|\s*"
    r"(\w+)\s*\|"
)
CAPTION_PREFIXES = [
    r"^Image\s+Caption\s*:?\s*",
    r"^Caption\s*:?\s*",
    r"^Figure\s+\d+[.:]\s*",
    r"^Fig\.\s*\d+[.:]\s*",
]
COMPOUND_TOKEN = r"[a-z0-9]+(?:[/\.][a-z0-9]+)+"
STANDARD_TOKEN = r"[a-z0-9_\-]+"
PAGE_IMAGE_NAME = r"^(.+?)_p(\d+)_img(\d+)$"
LOOSE_IMAGE_NAME = r"^(.+?)_img(\d+)$"

# ---- fixed values: patterns over questions ------------------------------------------------------
QUESTION_DATE = r"\b(20\d{2})[-/\s](0[1-9]|1[0-2])[-/\s](0[1-9]|[12]\d|3[01])\b"
LOG_QUESTION_EXACT = [r"\b[A-Z]{3,5}\d{3,4}\b", r"\bTCH\b"]
LOG_QUESTION_ANY_CASE = [
    r"\buplink(ed|s|ing)?\b",
    r"\b(?:tele)?command\s+(?:history|log)\b",
    r"\borbit\s+\d+\b",
]
IMAGE_INTENT = (
    r"\b(diagram|figure|flow[\s-]?chart|flowchart|block\s+diagram|schematic|"
    r"image|picture|illustration|drawing|screenshot|chart|plot|graph)\b"
)
PROCEDURE_INTENT = (
    r"\b(fcp|procedure|how\s+to|steps?|switch\w*|power\w*|turn\w*|"
    r"enabl\w*|disabl\w*|reset|select\w*|activat\w*|deactivat\w*)\b"
)

# ---- fixed values: image kinds -------------------------------------------------------------------
VECTOR_IMAGE_TYPES = ["wmf", "emf"]
RASTER_IMAGE_TYPES = ["jpg", "jpeg", "png"]

# ---- fixed values: subsystem choices offered by the query surfaces --------------------------------
SUBSYSTEM_CHOICES = ["OBC", "AOCS", "PAYLOAD", "POWER", "DTG", "MECHANISM",
                     "PROPULSION", "TTC_XBAND", "WHEEL", "SENSOR", "ODHS"]
