"""Fixed values that results must agree on: names, labels, weights and word lists of the decision domain."""

from __future__ import annotations

#: Codes of respondent states and their names (fixed values).
COUNTRIES = {
    "ALB": "Albania", "AND": "Andorra", "ARM": "Armenia", "AUT": "Austria", "AZE": "Azerbaijan", "BEL": "Belgium",
    "BIH": "Bosnia and Herzegovina", "BGR": "Bulgaria", "HRV": "Croatia", "CYP": "Cyprus", "CZE": "Czech Republic",
    "DNK": "Denmark", "EST": "Estonia", "FIN": "Finland", "FRA": "France", "GEO": "Georgia", "DEU": "Germany",
    "GRC": "Greece", "HUN": "Hungary", "ISL": "Iceland", "IRL": "Ireland", "ITA": "Italy", "LVA": "Latvia",
    "LIE": "Liechtenstein", "LTU": "Lithuania", "LUX": "Luxembourg", "MLT": "Malta", "MDA": "Moldova", "MCO": "Monaco",
    "MNE": "Montenegro", "NLD": "Netherlands", "MKD": "North Macedonia", "NOR": "Norway", "POL": "Poland",
    "PRT": "Portugal", "ROU": "Romania", "RUS": "Russia", "SMR": "San Marino", "SRB": "Serbia", "SVK": "Slovakia",
    "SVN": "Slovenia", "ESP": "Spain", "SWE": "Sweden", "CHE": "Switzerland", "TUR": "Turkey", "UKR": "Ukraine",
    "GBR": "United Kingdom",
}
#: Other spellings under which a state is found.
COUNTRY_ALIASES = {"Türkiye": "TUR", "Czechia": "CZE"}

#: Sections in reading order with their labels (fixed values).
SECTION_LABELS = {
    "header": "Header",
    "introduction": "Introduction",
    "facts_background": "Facts (Background)",
    "facts_proceedings": "Facts (Proceedings)",
    "legal_framework": "Legal Framework",
    "legal_context": "Legal Context",
    "admissibility": "Admissibility",
    "merits": "Merits",
    "just_satisfaction": "Just Satisfaction",
    "article_46": "Article 46 (Execution)",
    "operative_part": "Operative Part",
    "separate_opinion": "Separate Opinion",
    "appendix": "Appendix",
}
SECTION_ORDER = [s for s in SECTION_LABELS if s != "header"]
#: Weights of a hit by section; others count 1 (fixed values).
SECTION_WEIGHTS = {"merits": 1.3, "admissibility": 1.2, "legal_framework": 1.1, "legal_context": 1.1, "facts_background": 1.0, "facts_proceedings": 1.0, "appendix": 0.8}
KEY_CASE_BOOST = GRAND_CHAMBER_BOOST = 1.1

#: Outcome buckets in their fixed order, with labels (fixed values).
OUTCOMES = {"violation_only": "Violation only", "non_violation_only": "Non-violation only", "both": "Both", "neither": "Neither"}
CHAMBERS = ["GRANDCHAMBER", "CHAMBER", "OTHER"]

#: What a conclusion says about inadmissibility: text to look for, and its label, in order (fixed values).
GROUNDS = [
    ("manifestly ill-founded", "Manifestly ill-founded"),
    ("ratione materiae", "Ratione materiae"),
    ("ratione personae", "Ratione personae"),
    ("ratione temporis", "Ratione temporis"),
    ("ratione loci", "Ratione loci"),
    ("non-exhaustion", "Non-exhaustion of domestic remedies"),
    ("exhaustion of domestic remedies", "Exhaustion of domestic remedies"),
    ("six-month", "Six-month rule"),
    ("four-month", "Four-month rule"),
    ("no significant disadvantage", "No significant disadvantage"),
]
OTHER_GROUND = "Other / unspecified"

#: Words that say nothing about a text (fixed values).
STOPWORDS = [
    "the", "of", "and", "to", "in", "a", "that", "is", "was", "for", "it", "on", "with", "as", "by", "at", "an", "be", "this", "which", "or", "from", "had",
    "has", "have", "its", "not", "but", "are", "were", "been", "also", "they", "their", "would", "could", "should", "may", "can", "will", "shall", "any", "all",
    "each", "other", "such", "than", "more", "if", "there", "these", "those", "his", "her", "who", "him", "them", "did", "about", "between", "through", "after",
    "before", "under", "over", "into", "only", "see", "cited", "above", "paragraph", "paragraphs", "article", "articles", "no", "nos", "ibid", "v", "court",
    "applicant", "government", "case", "convention",
]

#: Query prefixes (fixed values).
PREFIXES = ["case", "ecli", "hudoc", "article", "state", "body", "judge", "keyword"]

MAX_HITS, PAGE_SIZE, SAMPLE_SIZE, MIN_LABELLED = 5000, 20, 30, 6
#: Default thresholds of the classification methods (fixed values).
THRESHOLDS = {"tfidf_centroid": 0.22, "char_ngram_centroid": 0.18, "keyword_overlap": 0.20}
SCHEMA_VERSION, PARSER_VERSION = "assize-v1", "1.0.0"
