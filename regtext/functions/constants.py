"""Fixed values that must equal the original pipeline's for matching results.

Everything here is data (word lists, patterns, ids), kept together and in natural order.
"""

# --- fixed values: English stopword list (NLTK "english" corpus, 179 words, corpus order) ---
NLTK_ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
]

# --- fixed values: negation / contraction words kept by the keyword normaliser (T1) ---
KEEP_T1 = [
    "aren", "aren't", "ain", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "don", "don't",
    "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "nor", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# --- fixed values: words kept by the report cleaner (T2): T1's list plus no / not ---
KEEP_T2 = [
    "aren", "aren't", "ain", "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "don", "don't",
    "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "mightn", "mightn't",
    "mustn", "mustn't", "needn", "needn't", "no", "nor", "not", "shan", "shan't", "shouldn",
    "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# --- fixed values: extra stopwords of the non-diagnostic filter (T3) ---
EXTRA_STOP_T3 = [
    "mr", "dr", "md", "surgeon", "asst", "assistant", "physician", "result:",
    "impression:", "overall", "ne", "oh", "mrn", "cleveland", "ohio", "canton", "clinic",
]

# --- fixed values: unit tokens ---
UNITS_T1 = ["cm", "cc", "beat", "m2", "l", "gm", "s", "min", "mmol", "hg", "mm", "ml", "sq", "m", "sec", "ms",
            "cc/m2", "gm/m2"]
UNITS_T2 = ["cm", "cc", "beat", "m2", "l", "gm", "s", "min", "mmol", "hg", "mm", "ml", "sq", "m", "sec", "ms"]
UNITS_T3 = ["cm", "cc", "beat", "m2", "l", "gm", "s", "min", "mmol", "hg", "mm", "mc", "ml", "sq", "m", "sec",
            "ms", "mhg"]

# --- fixed values: quantity tokens and quantity phrases ---
QUANTS = ["edv", "edvi", "esv", "esvi", "svi", "lvef", "lvmi", "rvef", "ef", "sv", "co", "ci", "ce"]
QUANT_PHRASES = [
    "stroke volume", "cardiac index", "lv mass", "cardiac output", "forward volume",
    "reverse volume", "net forward volume", "aortic regurgitant fraction",
    "quantitative mitral regurgitant volume", "quantitative mitral regurgitant fraction",
]

# --- fixed values: report fragments removed by the report cleaner (T2) ---
REPORT_FRAGMENTS_T2 = ["result:", "impression:", "overall"]

# --- fixed values: ASCII punctuation (Python string.punctuation) ---
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- fixed values: measurement units (T4), the alternation spelled out in pattern order ---
MEASUREMENT_UNITS = [
    "cm", "m", "cc", "bpm", "beat", "m2", "l", "gm", "oz", "mcg", "mg", "cg", "g", "s", "min", "mmolhg",
    "molhg", "mmHg", "mm", "mHg", "ml", "sq", "degree", "degrees", "hour", "hours", "time", "times",
    "tablet", "tablets", "lb", "kg", "%",
]

# --- fixed values: month names (T5) ---
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december"]

# --- fixed values: contractions the word tokenizer splits (T1) ---
TOKENIZER_SPLITS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]

# --- fixed values: history headers (T12), non-capturing ---
HISTORY_HEADER_PATTERN = (
    r"(?:PMHx?|Hx|PSH|HPI|(?:History of )?Present Illness|history of|IMPRESSION|Problem List|"
    r"Active Major Problems|Comorbidities|Principal Diagnosis|PAST (?:MEDICAL|SURGICAL) HISTORY)(?:\s*:)?"
)

# --- fixed values: procedure section start words (T13), literal spaces ---
PROCEDURE_PRIMARY_STARTS = (
    r"(?:OPERATIVE|SURGERY/)?PROCEDURE:?|OPERATIVE REPORT:?|DESCRIPTION OF PROCEDURE:?|"
    r"PROCEDURE (?:IN )?DETAILS?:?|OPERATIONS?:?|(?:Operative|Surgery/)?Procedure:|Operative Report:|"
    r"Description (?:Of|of) Procedure:|Procedure (?:In |in )?Details?:|Operations?:"
)
PROCEDURE_SECONDARY_STARTS = (
    r"NAME OF OPERATION:?|OPERATIVE (?:FINDINGS|INDICATIONS):?|FINDINGS AND TECHNIQUE:?|PROCEDURE TYPE:?|"
    r"Name (?:Of|of) Operation:|Operative (?:Findings|Indications):|Findings (?:And|and) Technique:|"
    r"Procedure (?:T|t)ype:"
)
PROCEDURE_END = r"(?i)\b\w+:|\*+|#:"

# --- fixed values: multi-report marker (T14) ---
PROCEDURE_AFTER_MARKER = r"(?i)procedure:|\s+operative report:?\s+"

# --- fixed values: sections removed from a report (T15) ---
SECTIONS_TO_REMOVE = ["MEDICAL CENTER", "DATE", "CC", "PRIMARY CARE", "DT", "DD", "SURGEON"]

# --- fixed values: label spellings (P9) ---
POSITIVE_SPELLINGS = ["yes", "Yes", "YES"]
NEGATIVE_SPELLINGS = ["no", "No", "NO", "null", "Null", "NULL", "None"]

# --- fixed values: label prefixes of a registry, and labels ignored by the prevalence filter (A10) ---
LABEL_PREFIXES = ["SP_", "HX_", "CB_", "Preop_"]
IGNORED_LABELS = [
    "SP_PV_Repair", "SP_Valve_Sparing_Root_remodeling_Yacoub", "SP_Valve_Sparing_Root_Reconstruction_Florida",
    "SP_AV_Ring_Annuloplasty", "SP_AV_Leaflet_Free_Edge_Reinforcement", "SP_AV_Leaflet_Pericardial_Patch",
    "SP_AV_Division_of_Fused_Leaflet_Raphe", "SP_AV_Repair_of_Periprosthetic_Leak", "SP_AV_Implant_Type_Autograft_Ross",
    "SP_MV_Implant_Type_Other", "SP_MV_Chords_Preserved_Type", "SP_Transmyocardial_Laser_Revascularization",
    "SP_Trauma_Repair", "SP_Subaortic_Stenosis_Resection", "SP_TV_Explant", "CB_Gastroepiploic_Inf_Epigastric_Graft_To_LAD",
    "CB_Gastroepiploic_Inf_Epigastric_Graft_To_Diagonal", "CB_Gastroepiploic_Inf_Epigastric_Graft_To_LCX",
    "CB_Other_Conduit_Procedure_To_RCA", "CB_Other_Conduit_Procedure_To_LAD", "CB_Other_Conduit_Procedure_To_Diagonal",
    "CB_Other_Conduit_Procedure_To_LCX", "SP_MV_Transcatheter_Replacement", "SP_MV_Leaflet_Clip",
    "SP_Cath_Based_Assist_Device_Used", "SP_MV_Native_Pannus_Thrombus_Removal", "SP_MV_Prosthetic_Valve_Repair",
    "SP_AV_Exploration", "SP_MV_Exploration", "SP_PV_Exploration", "SP_TV_Exploration", "Preop_Lab_Hematocrit",
    "HX_TV_Replacement", "Cardiac_Symptoms_on_Admission", "Preop_Resuscitation",
]

# --- fixed values: token ids of the sequence packer (K1-K3) ---
UNK_ID, PAD_ID, START_ID, END_ID = 0, 1, 2, 3
FIRST_VOCAB_ID = 4
MAX_SEQ_LEN = 512

# --- fixed values: defaults of the pipeline ---
SPLIT_SEED = 42
RARE_CUT = 0.03
LOSS_WEIGHT_BOUNDS = (0.05, 0.95)
CONFIDENCE = 0.95
VALIDATION_SHARE = 0.15


def stopwords(keep: list[str] | None = None, extra: list[str] | None = None) -> list[str]:
    """NLTK English stopwords minus ``keep`` plus ``extra`` (order preserved, no duplicates)."""
    drop = set(keep or [])
    out = [w for w in NLTK_ENGLISH_STOPWORDS if w not in drop]
    for w in extra or []:
        if w not in out:
            out.append(w)
    return out
