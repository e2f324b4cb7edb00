"""Parameters of screening: lexicons, weights, thresholds, portfolio, labels. All are values, none is read from a clock or a global."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Terms of all lexicons together, see :mod:`gazette.operators.lexicon`.
TERMS = 250_000
#: INN stems that mark antineoplastic names.
STEMS = ("tinib", "ciclib", "parib", "zomib", "lisib", "rafenib", "metinib", "degib", "denib", "tecan", "rubicin", "platin", "taxel", "citabine", "vedotin", "mertansine", "govitecan")

#: A small start; a deployment loads its own terms with :func:`lexicons_from`.
LEXICONS: dict[str, tuple[str, ...]] = {
    "pharma": ("medicine", "medicines", "drug", "drugs", "pharmaceutical", "vaccine", "antibiotic", "injection", "vial", "ampoule", "tablet", "capsule", "syrup", "infusion", "inhaler", "insulin", "api", "أدوية", "دواء"),
    "non_pharma": ("construction", "furniture", "catering", "vehicles", "printing", "cleaning services", "stationery", "أثاث"),
    "device": ("catheter", "glove", "gloves", "stent", "ventilator", "suture", "monitor", "surgical mask"),
    "onc_context": ("oncology", "cancer", "chemotherapy", "antineoplastic", "cytotoxic", "tumour", "tumor", "الأورام", "سرطان"),
    "onc_indication": ("leukaemia", "leukemia", "lymphoma", "myeloma", "melanoma", "sarcoma", "glioblastoma", "breast cancer", "all", "aml", "cml"),
    "onc_molecule": ("carboplatin", "fluorouracil", "anastrozole", "azacitidine", "busulfan", "lenalidomide", "letrozole", "mitomycin", "carmustine", "methotrexate", "tamoxifen", "imatinib"),
    "onc_mab": ("trastuzumab", "pembrolizumab", "nivolumab", "rituximab", "bevacizumab", "daratumumab"),
    "onc_supportive": ("ondansetron", "granisetron", "filgrastim", "leucovorin", "mesna"),
    "commodity": ("paracetamol", "ibuprofen", "normal saline", "dextrose", "vitamin c"),
}
#: Areas in the order in which ties are decided.
AREAS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Hematology", ("haemophilia", "factor viii", "anticoagulant", "heparin", "iron sucrose")),
    ("Immunology", ("adalimumab", "infliximab", "tacrolimus", "immunoglobulin")),
    ("Rare Disease", ("enzyme replacement", "gaucher", "fabry", "macitentan")),
    ("Neurology", ("epilepsy", "valproate", "levetiracetam", "multiple sclerosis")),
    ("Cardiology", ("atorvastatin", "amlodipine", "bisoprolol", "hypertension")),
    ("Endocrinology", ("insulin", "metformin", "levothyroxine", "diabetes")),
    ("Infectious Disease", ("amoxicillin", "vancomycin", "antiviral", "meropenem", "tb", "سل")),
    ("Respiratory", ("salbutamol", "budesonide", "asthma", "copd")),
    ("Gastroenterology", ("omeprazole", "pantoprazole", "lactulose", "ulcerative colitis", "loperamide")),
    ("Psychiatry", ("olanzapine", "risperidone", "sertraline", "schizophrenia", "depression")),
    ("Pain & Anaesthesia", ("morphine", "fentanyl", "propofol", "lidocaine", "analgesic", "anaesthetic")),
    ("Dermatology", ("psoriasis", "eczema", "isotretinoin", "hydrocortisone cream")),
    ("Clinical Nutrition", ("parenteral nutrition", "enteral feed", "amino acids infusion", "lipid emulsion")),
    ("Allergy", ("cetirizine", "loratadine", "antihistamine", "allergen")),
    ("Ophthalmology", ("glaucoma", "latanoprost", "timolol", "eye drops")),
)


@dataclass(frozen=True)
class ScreenParams:
    lexicons: dict[str, tuple[str, ...]] = field(default_factory=lambda: LEXICONS)
    areas: tuple[tuple[str, tuple[str, ...]], ...] = AREAS
    stems: tuple[str, ...] = STEMS
    oncology_threshold: float = 0.45
    review_floor: float = 0.22
    review_unclassified: bool = True
    review_devices: bool = False
    portfolio: tuple[str, ...] = ("fluorouracil", "anastrozole", "azacitidine", "busulfan", "carboplatin", "lenalidomide", "letrozole", "mitomycin", "carmustine", "macitentan")
    specialty: tuple[str, ...] = ("Hematology", "Rare Disease", "Immunology")
    #: Weights of the priority score and its cut-offs.
    weights: dict[str, float] = field(default_factory=lambda: {"oncology": 50, "portfolio": 35, "specialty": 22, "value": 20, "commodity": -18, "device": -12})
    high: float = 45
    medium: float = 15
    high_value: float = 100_000
    code_labels: dict[str, str] = field(default_factory=lambda: {"ON": "Oncology", "TB": "Tuberculosis", "IN": "Infectious Disease", "SP": "Specialty", "NU": "Nutrition"})
    #: Similarity of titles at which two notices are one, or might be; bonus for equal deadlines; least similarity of authorities.
    same: float = 0.88
    maybe: float = 0.72
    deadline_bonus: float = 0.06
    authority: float = 0.6


def lexicons_from(table: DataFrame) -> tuple[dict[str, tuple[str, ...]], tuple[tuple[str, tuple[str, ...]], ...]]:
    """Lexicons and areas from a table (lexicon, area_rank, area, term); rows of lexicon ``area`` belong to areas.

    All terms go to every worker, so their number is bounded: ``TERMS``, a quarter of a million.
    """
    rows = table.select("lexicon", "area_rank", "area", "term").limit(TERMS + 1).collect()
    if len(rows) > TERMS:
        raise ValueError(f"more than {TERMS} terms: a worker can't hold them")
    lexicons: dict[str, list[str]] = {}
    areas: dict[tuple[int, str], list[str]] = {}
    for r in rows:
        if r.lexicon == "area":
            areas.setdefault((r.area_rank, r.area), []).append(r.term)
        else:
            lexicons.setdefault(r.lexicon, []).append(r.term)
    return {k: tuple(v) for k, v in lexicons.items()}, tuple((k[1], tuple(v)) for k, v in sorted(areas.items()))
