"""Fixed values that must equal the reference's for identical results."""

# --- fixed values -----------------------------------------------------------
# The 20 standard residues, in this order (token ids follow it).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
# Special tokens, in id order after the residues: pad, mask, unknown, sep, cls.
PAD, MASK, UNK, SEP, CLS = "$", ".", "?", "|", "*"
SPECIALS = [PAD, MASK, UNK, SEP, CLS]
# Gap symbol used for padding pair sequences and as the optional first token.
GAP = "-"
# Label value that marks a position as not scored.
IGNORE_INDEX = -100
# Structure tags and their default masking rates (coil, helix, strand).
STRUCTURE_RATES = {"C": 0.4, "H": 0.15, "E": 0.15}
# -----------------------------------------------------------------------------

# The steps that bring an allele name to HLA-X*NN:NN, in order.
ALLELE_STEPS = (
    (r"^([ABC])(\d{2})(\d{2})\z", "HLA-$1*$2:$3"),
    (r"^([ABC]\*\d{2}:\d{2})", "HLA-$1"),
    (r"(?s)^(HLA-[ABC]\*\d{2}:\d{2}).*\z", "$1"),
    (r"^HLA-([ABC])(\d{2})(\d{2})\z", "HLA-$1*$2:$3"),
)
