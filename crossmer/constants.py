"""Fixed values shared by every module.

All numbers here are published biochemical tables or screening defaults; they
must stay exactly as they are for results to be comparable between engines.
"""

from __future__ import annotations

# --- alphabets (fixed values) ------------------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
MATRIX_ORDER = "ARNDCQEGHILKMFPSTWYV"

# --- BLOSUM62 (fixed values): lower triangle, rows and columns in MATRIX_ORDER.
# The matrix is symmetric, so the upper half follows by mirroring.
BLOSUM62_LOWER = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""


def blosum62() -> dict[str, int]:
    """Residue pair (two letters) -> substitution score, both orders."""
    scores: dict[str, int] = {}
    for row in BLOSUM62_LOWER.split("\n"):
        if row.strip():
            letter, *values = row.split()
            for other, value in zip(MATRIX_ORDER, values):
                scores[letter + other] = scores[other + letter] = int(value)
    return scores


# --- alignment defaults (fixed values) ---------------------------------------
GAP_OPEN = 10      # cost of the first gap position
GAP_EXTEND = 1     # cost of every further position
UNKNOWN_SCORE = -4         # non-standard residue, pairwise alignment
UNKNOWN_SCORE_BATCH = 0    # non-standard residue, all-vs-all screen
MIN_RUN = 6                # contiguous identical run that counts as a hit

# --- Karlin-Altschul parameters for BLOSUM62 (fixed values) ------------------
# (existence, extension) -> (lambda, K, H); existence = gap_open - gap_extend
KARLIN_ALTSCHUL = {
    (11, 1): (0.267, 0.041, 0.140),
    (10, 1): (0.262, 0.040, 0.140),
    (9, 1): (0.253, 0.038, 0.130),
    (8, 1): (0.244, 0.035, 0.120),
    (7, 1): (0.230, 0.032, 0.100),
    (11, 2): (0.199, 0.040, 0.110),
    (10, 2): (0.186, 0.035, 0.090),
    (9, 2): (0.170, 0.028, 0.070),
    (12, 1): (0.270, 0.042, 0.140),
    (13, 1): (0.272, 0.042, 0.140),
}

# --- physicochemical scales (fixed values) -----------------------------------
# Kyte-Doolittle hydropathy times ten, so that window sums stay exact integers
HYDROPATHY_X10 = {
    "A": 18, "R": -45, "N": -35, "D": -35, "C": 25, "Q": -35, "E": -35,
    "G": -4, "H": -32, "I": 45, "L": 38, "K": -39, "M": 19, "F": 28,
    "P": -16, "S": -8, "T": -7, "W": -9, "Y": -13, "V": 42,
}
# net charge at neutral pH times ten
CHARGE_X10 = {"K": 10, "R": 10, "D": -10, "E": -10, "H": 1}
HYDROPHOBIC = "ACFILMVWY"
PROFILE_WINDOW = 5

PKA_N_TERMINUS = 8.0
PKA_C_TERMINUS = 3.1
PKA_POSITIVE = {"H": 6.04, "K": 10.54, "R": 12.48}
PKA_NEGATIVE = {"D": 3.9, "E": 4.07, "C": 8.14, "Y": 10.46}
NEUTRAL_PI = 7.0
PI_STEPS = 50
PH_MAX = 14.0

COMPOSITE_WEIGHTS = {
    "binary": 0.40, "hydrophobicity": 0.20, "charge": 0.20, "pi": 0.10, "aligned": 0.10,
}
PI_SPAN = 7.0
COMPOSITE_HIT = 0.55

# --- reduced alphabet, 11 groups (fixed values) ------------------------------
REDUCED_GROUPS = {
    "h": "ILVM", "a": "A", "r": "FWY", "s": "ST", "d": "DE", "n": "NQ",
    "b": "KR", "i": "H", "c": "C", "g": "G", "p": "P",
}
REDUCED_K = 5
REDUCED_MIN_CHAIN = 2
RESCUE_MEAN = 3.0
RESCUE_MIN_REGION = 5
OUT_OF_RANGE_MEAN = -999.0

# --- k-mer filter defaults (fixed values) ------------------------------------
KMER_K = 6
JACCARD_THRESHOLD = 0.04
CHAIN_K = 4
CHAIN_MIN = 3

# --- tag search (fixed values) -----------------------------------------------
TAG_WINDOW = 60
TAG_MIN_SCORE = 20

# --- loader (fixed values) ---------------------------------------------------
ID_COLUMNS = ("id", "antigen_id", "name", "accession", "gene", "protein_id", "entry")
SEQUENCE_COLUMNS = (
    "sequence", "seq", "aa_sequence", "protein_sequence", "peptide", "amino_acid_sequence",
)
DELIMITERS = (",", ";", "\t")
FASTA_SUFFIXES = (".fasta", ".fa", ".faa", ".fas", ".fna")
MIN_SEQUENCE_LENGTH = 8

# --- screening defaults (fixed values) ---------------------------------------
MAX_EVALUE = 0.01
EXPORT_MAX_EVALUE = 10.0
MIN_ALIGNED = 8
DEFAULT_DB_SIZE = 1_000_000
LOOKUP_TOP_N = 50
CLI_TOP_N = 25
# significance tiers: upper bound (exclusive) -> label, in ascending order
SIGNIFICANCE_TIERS = (
    (1e-10, "very high"), (1e-4, "strong"), (1e-1, "moderate"), (1.0, "weak"),
)
SIGNIFICANCE_NONE = "not significant"
