"""Fixed values of the concept operators: defaults that callers may replace."""

# --- fixed values: semantic types by group, in natural order ---
SEMANTIC_GROUPS: dict[str, tuple[str, ...]] = {
    "Drug or Procedure": (
        "Pharmacologic Substance", "Clinical Drug", "Therapeutic or Preventive Procedure", "Organic Chemical",
    ),
    "Genetics & Molecular": (
        "Gene or Genome", "Genetic Function", "Amino Acid, Peptide, or Protein", "Enzyme",
        "Cell or Molecular Dysfunction",
    ),
    "Diagnostics & Lab": (
        "Diagnostic Procedure", "Laboratory Procedure", "Laboratory or Test Result",
    ),
    "Symptoms & Conditions": (
        "Disease or Syndrome", "Sign or Symptom", "Finding", "Pathologic Function", "Neoplastic Process",
        "Mental or Behavioral Dysfunction", "Congenital Abnormality", "Anatomical Abnormality",
    ),
}

TARGET_TYPES: tuple[str, ...] = tuple(t for types in SEMANTIC_GROUPS.values() for t in types)

# --- fixed values: types kept for symptom concepts ---
SYMPTOM_TYPES: tuple[str, ...] = (
    "Anatomical Abnormality", "Daily or Recreational Activity", "Disease or Syndrome", "Finding",
    "Laboratory or Test Result", "Mental or Behavioral Dysfunction", "Neoplastic Process",
    "Pathologic Function", "Sign or Symptom",
)

# --- fixed values: source vocabularies of the terminology table ---
TERMINOLOGIES: tuple[str, ...] = (
    "SNOMEDCT_US", "RXNORM", "LNC", "OMIM", "ICD9CM", "ICD10CM", "HPO", "ORPHANET", "MSH", "GO",
)

# --- fixed values: note contexts that do not describe the patient now ---
EXCLUDED_CONTEXTS: tuple[str, ...] = ("FAMILY", "NEGATED_EXISTENCE", "HISTORICAL", "HYPOTHETICAL")

# --- fixed values: concept names too unspecific to keep ---
BLOCKED_NAMES: tuple[str, ...] = (
    "Asymptomatic (finding)", "Complication", "No Complication", "No breathlessness", "Rest",
    "Physical findings", "Reduced", "Abnormal", "Disease", "Severe (severity modifier)", "Progressive cGVHD",
    "Symptoms", "Moderate", "Allergy Severity - Severe", "Death (finding)", "No Shortness of Breath",
    "No sputum", "Increased (finding)", "Discomfort", "Progressive Disease", "No Weight Loss",
    "Oral Manifestations", "No fatigue", "Reinfection", "No respiratory symptoms", "Swelling", "Exacerbation",
    "Intensity and Distress 5", "Disease Progression", "Disability", "Worse", "Impaired exercise tolerance",
    "Dry skin", "Symptom mild", "Mental disorders", "Ache", "Oral Complication", "Present",
    "irPD (Immune-Related Response Criteria)", "Fasting", "Infection", "Communicable Diseases",
    "Medical Condition", "Sexual intercourse - finding", "Exercise", "METHOD:*", "SYSTEM:*", "SCALE:*",
    "Household composition", "Living", "Activity (animal life circumstance)", "Cause of Death",
    "Collapse (finding)", "Complaint (finding)", "Enlargement (morphologic abnormality)", "Hospitalization 1",
    "Hospitalization 2", "Hospitalization 3", "Sign or Symptom", "Low Grade Prostatic Intraepithelial Neoplasia",
    "Physical activity", "Low Grade Cervical Squamous Intraepithelial Neoplasia", "Neoplasm Metastasis",
    "Fluid overload", "Finding of pH", "Past history of",
)

# --- fixed values: (note type, note title) pairs used by the top-1 evaluation ---
NOTE_PAIRS: tuple[tuple[str, str], ...] = (
    ("Outpatient note", "Progress Notes"), ("Inpatient note", "Progress Notes"),
    ("Inpatient note", "Assessment & Plan Note"), ("Outpatient note", "Assessment & Plan Note"),
    ("Inpatient note", "Subjective & Objective"), ("Admission note", "H&P"),
    ("Discharge summary", "Discharge Summary"), ("Emergency department note", "ED Provider Notes"),
    ("Outpatient note", "Clinic Note"),
)

# --- fixed values: site categories of cited hosts ---
SITE_CATEGORIES: dict[str, tuple[str, ...]] = {
    "Government / Official Databases": (
        "nih.gov", "ncbi.nlm.nih.gov", "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "medlineplus.gov",
        "www.ncbi.nlm.nih.gov",
    ),
    "Rare Disease Databases": ("rarediseases.org", "orpha.net", "www.orpha.net"),
    "Clinical Medical Reference": (
        "medscape.com", "emedicine.medscape.com", "clevelandclinic.org", "my.clevelandclinic.org",
        "mayoclinic.org",
    ),
    "Academic Journals / Research": (
        "onlinelibrary.wiley.com", "mdpi.com", "researchgate.net", "sciencedirect.com", "www.sciencedirect.com",
    ),
    "General Encyclopedia": ("wikipedia.org", "en.wikipedia.org"),
    "Media Platforms": ("youtube.com",),
}
