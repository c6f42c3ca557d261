"""Fixed values. Results are only comparable when these stay exactly as they are."""

# Engines, their request order and default weights.
DEFAULT_WEIGHTS = {"cdk": 0.5, "cascade": 0.3, "orca": 0.2}

# Enumerations accepted in a request.
NUCLEI = ("1H", "13C")
MODES = ("individual", "consensus")
CONFORMER_STRATEGIES = ("fast", "goat")
STATUSES = ("ok", "pending", "error")
REQUEST_KEYS = ("smiles", "engines", "mode", "nucleus", "conformer_strategy", "weights")

# Size limits.
MAX_STRING_LENGTH = 256
MAX_HEAVY_ATOMS = 64
MAX_TOTAL_ATOMS = 192

# Atomic number and symbol observed by each nucleus.
NUCLEUS_ATOMIC_NUMBER = {"1H": 1, "13C": 6}
NUCLEUS_SYMBOL = {"1H": "H", "13C": "C"}

# Fixed value: gas constant in kcal/(mol K) times 298.15 K.
RT_KCAL = 0.001987 * 298.15

# Multiplicity by number of neighbouring protons, and the coupling given to sp3 centres.
MULTIPLICITY_BY_NEIGHBORS = {0: "s", 1: "d", 2: "t", 3: "q", 4: "quint", 5: "sext", 6: "sept"}
SP3_COUPLING_HZ = 7.0

# Long names of the multiplicity labels.
MULTIPLICITY_NAMES = {
    "s": "singlet",
    "d": "doublet",
    "t": "triplet",
    "q": "quartet",
    "quint": "quintet",
    "sext": "sextet",
    "sept": "septet",
    "m": "multiplet",
}

# Relative line heights of each multiplet.
MULTIPLET_PATTERNS = {
    "s": [1],
    "d": [1, 1],
    "t": [1, 2, 1],
    "q": [1, 3, 3, 1],
    "quint": [1, 4, 6, 4, 1],
    "sext": [1, 5, 10, 10, 5, 1],
    "sept": [1, 6, 15, 20, 15, 6, 1],
    "m": [1, 2, 3, 2, 1],
}

# Signal grouping, line spacing and line height.
GROUP_TOLERANCE_1H_PPM = 0.14
DEFAULT_COUPLING_HZ = 7.0
SPECTROMETER_MHZ = 400.0
FALLBACK_SPACING_PPM = 0.016
LINE_BASE_HEIGHT = 0.8
LINE_HEIGHT_STEP = 0.12
LINE_HEIGHT_MAX_EXTRA = 0.45
ZERO_COUPLING_EPSILON = 2.220446049250313e-16

# Integral curve.
INTEGRAL_BASELINE = 0.08
INTEGRAL_AMPLITUDE = 0.28
INTEGRAL_SHOULDER_PPM = 0.14

# Spectrum domain (ppm), frequency (MHz), line width (ppm) and number of points per nucleus.
DOMAIN_PPM = {"1H": (0.0, 12.0), "13C": (0.0, 220.0), "15N": (-50.0, 450.0), "19F": (-260.0, 80.0), "31P": (-80.0, 280.0)}
FREQUENCY_MHZ = {"1H": 400.13, "13C": 100.61, "15N": 40.56, "19F": 376.5, "31P": 161.98}
LINE_WIDTH_PPM = {"1H": 0.004, "13C": 0.05, "15N": 0.18, "19F": 0.02, "31P": 0.05}
SPECTRUM_POINTS = {"1H": 32768, "13C": 8192, "15N": 8192, "19F": 8192, "31P": 8192}
OTHER_DOMAIN_PPM = (0.0, 200.0)
OTHER_FREQUENCY_MHZ = 100.0
OTHER_LINE_WIDTH_PPM = 0.12
OTHER_SPECTRUM_POINTS = 4096
DOMAIN_MARGIN_1H_PPM = 0.9
DOMAIN_MARGIN_OTHER_PPM = 8.0
STD_BROADENING = 0.35

# Peak matching tolerances and highlight widths (ppm) per nucleus.
MATCH_TOLERANCE_PPM = {"1H": 0.09, "13C": 1.1, "15N": 2.0, "19F": 1.2, "31P": 1.2}
HIGHLIGHT_HALF_WIDTH_PPM = {"1H": 0.03, "13C": 0.45, "15N": 0.8, "19F": 0.45, "31P": 0.45}
OTHER_MATCH_TOLERANCE_PPM = 1.0
OTHER_HALF_WIDTH_PPM = 0.5
HIGHLIGHT_PAD_1H_PPM = 0.018
HIGHLIGHT_PAD_OTHER_FACTOR = 0.85
CENTER_DISTANCE_FACTOR = 0.85
BOUNDARY_DISTANCE_FACTOR = 3.0
# Floor of the tolerance and share of the highlight span, first 1H then other nuclei.
TOLERANCE_FLOOR_PPM = (0.03, 0.18)
TOLERANCE_SPAN_FACTOR = (0.85, 1.2)

# Radial basis expansion of a distance.
RBF_MU = 0.0
RBF_DELTA = 0.1
RBF_SIZE = 256

# Calculation log marker and line patterns.
LOG_FINISHED_MARKER = "ORCA TERMINATED NORMALLY"
LOG_HEADER_PATTERN = r"^\s*Nucleus\s*:?\s*(\d+)\s*([A-Z][a-z]?)\s*:?\s*$"
LOG_VALUE_PATTERN = r"^\s*(?:Total\s+)?[Ii]sotropic\s+shielding\s*[:=]\s*(-?\d+\.\d+)"
LOG_TABLE_ROW_PATTERN = r"^\s*(\d+)\s+([A-Z][a-z]?)\s+(-?\d+\.\d+)\s+(-?\d+\.\d+)\s*$"
LOG_TABLE_TITLES = ("CHEMICAL SHIELDING", "CHEMICAL SHIFT")

# Calculation input formats.
DECK_COORDINATE_FORMAT = "  %-2s  %14.8f  %14.8f  %14.8f"
DECK_SHIELDING_TITLE = "! %s %s NMR TightSCF"
DECK_SEARCH_TITLE = "! XTB2 GOAT"

# Allowed characters of a structure string and what counts as an atom letter per nucleus.
STRING_ALPHABET_PATTERN = r"^[A-Za-z0-9@+\-\[\]\(\)=#$\/\\.%:*]+$"
BRACKET_GROUP_PATTERN = r"\[[^\]]*\]"
ATOM_LETTER_PATTERNS = {"1H": "(?i)[CNOFPS]", "13C": "[Cc]", "15N": "[Nn]", "19F": "F", "31P": "P"}
PROTONS_PER_HEAVY_ATOM = 1.5
TOKEN_ESTIMATE_RANGE = {"1H": (2, 40), "13C": (1, 40), "15N": (1, None), "19F": (1, None), "31P": (1, None)}
TOKEN_ESTIMATE_OTHER = 5

# Message texts.
MESSAGE_ENGINE_FAILED = "%s prediction failed. Reference ID: %s"
MESSAGE_ENGINE_PENDING = "%s engine not yet wired up."
MESSAGE_DROPPED = "Dropped %d invalid engine assignment(s)."
MESSAGE_STRING_EMPTY = "SMILES is empty"
MESSAGE_STRING_TOO_LONG = "SMILES is too long (max 256 characters)"
MESSAGE_STRING_CHARACTERS = "Invalid characters in SMILES"
MESSAGE_STRING_PARENTHESES = "Unbalanced parentheses"
MESSAGE_TOO_MANY_HEAVY = "Molecule is too large (%d heavy atoms; max %d)"
MESSAGE_TOO_MANY_ATOMS = "Molecule is too large after adding hydrogens (%d atoms; max %d)"

# Fixed value: message for a target atom without a shielding (engine, atom, element).
MESSAGE_SHIELDING_MISSING = "%s did not emit an isotropic shielding for atom %d (%s)"
# Own text: no reference for a method.
MESSAGE_REFERENCE_MISSING = "No complete reference shieldings for %s / %s"

# Fixed value: delay of the debounce in milliseconds.
DEBOUNCE_MILLISECONDS = 300
