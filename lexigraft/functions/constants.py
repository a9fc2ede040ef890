"""Constant tables: small, read-only relations that joins broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Annotation types of each corpus, their vocabulary, class and whether they are mapped to the target.
ENTITY_TYPES = [
    ("BioRED", "ChemicalEntity", "MeSH", "chemical", True),
    ("BioRED", "DiseaseOrPhenotypicFeature", "MeSH", "disease", True),
    ("BioRED", "GeneOrGeneProduct", "NCBI Gene", "gene", False),
    ("BioRED", "SequenceVariant", "dbSNP", "variant", False),
    ("BioRED", "OrganismTaxon", "NCBI Taxonomy", "species", False),
    ("BioRED", "CellLine", "Cellosaurus", "cell_line", False),
    ("BC5CDR", "Chemical", "MeSH", "chemical", True),
    ("BC5CDR", "Disease", "MeSH", "disease", True),
    ("NCBI_Disease", "DiseaseClass", "MeSH", "disease", True),
    ("NCBI_Disease", "SpecificDisease", "MeSH", "disease", True),
    ("NCBI_Disease", "Modifier", "MeSH", "disease", True),
    ("NCBI_Disease", "CompositeMention", "MeSH", "disease", True),
    ("NLM-Chem", "Chemical", "MeSH", "chemical", True),
]

# Other names of annotation types, and the registered type and class they stand for.
TYPE_SYNONYMS = {
    "Gene": ("GeneOrGeneProduct", "gene"),
    "Species": ("OrganismTaxon", "species"),
    "CellLine": ("CellLine", "cell_line"),
    "Mutation": ("SequenceVariant", "variant"),
}

# Corpus, source relation, classes of subject and object, target relation, its tier and probability.
RELATION_MAPPINGS = [
    ("BC5CDR", "CID", "chemical", "disease", "causes", 2, 0.6),
    ("BC5CDR", "CID", "chemical", "disease", "causative-agent", 1, 0.3),
    ("BC5CDR", "CID", "chemical", "disease", "associated-with", 2, 0.1),
    ("BioRED", "Association", "chemical", "disease", "associated-with", 2, 0.8),
    ("BioRED", "Association", "chemical", "disease", "causative-agent", 1, 0.2),
    ("BioRED", "Association", "chemical", "gene", "associated-with", 2, 1.0),
    ("BioRED", "Association", "gene", "disease", "associated-with", 2, 0.7),
    ("BioRED", "Association", "gene", "disease", "causative-agent", 1, 0.3),
    ("BioRED", "Association", "variant", "disease", "associated-with", 2, 0.7),
    ("BioRED", "Association", "variant", "disease", "causative-agent", 1, 0.3),
    ("BioRED", "Association", "variant", "gene", "associated-with", 2, 1.0),
    ("BioRED", "Association", "gene", "gene", "associated-with", 2, 1.0),
    ("BioRED", "Association", "chemical", "chemical", "associated-with", 2, 1.0),
    ("BioRED", "Association", "chemical", "species", "associated-with", 2, 1.0),
    ("BioRED", "Association", "chemical", "cell_line", "associated-with", 2, 1.0),
    ("BioRED", "Association", "gene", "cell_line", "associated-with", 2, 1.0),
    ("BioRED", "Association", "disease", "cell_line", "associated-with", 2, 1.0),
    ("BioRED", "Association", "gene", "species", "associated-with", 2, 1.0),
    ("BioRED", "Positive_Correlation", "chemical", "disease", "causes", 2, 0.6),
    ("BioRED", "Positive_Correlation", "chemical", "disease", "causative-agent", 1, 0.3),
    ("BioRED", "Positive_Correlation", "chemical", "disease", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "chemical", "gene", "associated-with", 2, 0.6),
    ("BioRED", "Positive_Correlation", "chemical", "gene", "causes", 2, 0.4),
    ("BioRED", "Positive_Correlation", "gene", "disease", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "gene", "disease", "causative-agent", 1, 0.4),
    ("BioRED", "Positive_Correlation", "gene", "disease", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "variant", "disease", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "variant", "disease", "causative-agent", 1, 0.4),
    ("BioRED", "Positive_Correlation", "variant", "disease", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "variant", "gene", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "variant", "gene", "associated-with", 2, 0.5),
    ("BioRED", "Positive_Correlation", "gene", "gene", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "gene", "gene", "associated-with", 2, 0.5),
    ("BioRED", "Positive_Correlation", "chemical", "chemical", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "chemical", "chemical", "associated-with", 2, 0.5),
    ("BioRED", "Positive_Correlation", "disease", "disease", "associated-with", 2, 0.7),
    ("BioRED", "Positive_Correlation", "disease", "disease", "causes", 2, 0.3),
    ("BioRED", "Negative_Correlation", "chemical", "disease", "treats", 2, 0.7),
    ("BioRED", "Negative_Correlation", "chemical", "disease", "associated-with", 2, 0.2),
    ("BioRED", "Negative_Correlation", "chemical", "disease", "due-to", 1, 0.1),
    ("BioRED", "Negative_Correlation", "chemical", "gene", "associated-with", 2, 0.6),
    ("BioRED", "Negative_Correlation", "chemical", "gene", "interacts-with", 2, 0.4),
    ("BioRED", "Negative_Correlation", "gene", "disease", "associated-with", 2, 0.7),
    ("BioRED", "Negative_Correlation", "gene", "disease", "causes", 2, 0.3),
    ("BioRED", "Negative_Correlation", "variant", "disease", "associated-with", 2, 0.8),
    ("BioRED", "Negative_Correlation", "variant", "disease", "causes", 2, 0.2),
    ("BioRED", "Negative_Correlation", "variant", "gene", "associated-with", 2, 0.7),
    ("BioRED", "Negative_Correlation", "variant", "gene", "interacts-with", 2, 0.3),
    ("BioRED", "Negative_Correlation", "gene", "gene", "associated-with", 2, 0.6),
    ("BioRED", "Negative_Correlation", "gene", "gene", "interacts-with", 2, 0.4),
    ("BioRED", "Negative_Correlation", "chemical", "chemical", "associated-with", 2, 0.6),
    ("BioRED", "Negative_Correlation", "chemical", "chemical", "interacts-with", 2, 0.4),
    ("BioRED", "Negative_Correlation", "disease", "disease", "associated-with", 2, 1.0),
    ("BioRED", "Bind", "chemical", "gene", "interacts-with", 2, 1.0),
    ("BioRED", "Bind", "chemical", "chemical", "interacts-with", 2, 1.0),
    ("BioRED", "Bind", "gene", "gene", "interacts-with", 2, 1.0),
    ("BioRED", "Bind", "variant", "gene", "interacts-with", 2, 1.0),
    ("BioRED", "Bind", "chemical", "variant", "interacts-with", 2, 1.0),
    ("BioRED", "Cotreatment", "chemical", "chemical", "co-treats", 2, 1.0),
    ("BioRED", "Drug_Interaction", "chemical", "chemical", "interacts-with", 2, 1.0),
    ("BioRED", "Conversion", "chemical", "chemical", "converts-to", 2, 1.0),
    ("BioRED", "Conversion", "chemical", "gene", "converts-to", 2, 1.0),
    ("BioRED", "Comparison", "chemical", "chemical", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "gene", "gene", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "chemical", "disease", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "gene", "disease", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "variant", "disease", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "chemical", "gene", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "variant", "gene", "compared-with", 2, 1.0),
    ("BioRED", "Comparison", "disease", "disease", "compared-with", 2, 1.0),
    ("BioRED", "Association", "chemical", "variant", "associated-with", 2, 1.0),
    ("BioRED", "Association", "disease", "chemical", "associated-with", 2, 0.8),
    ("BioRED", "Association", "disease", "chemical", "causative-agent", 1, 0.2),
    ("BioRED", "Association", "disease", "gene", "associated-with", 2, 0.7),
    ("BioRED", "Association", "disease", "gene", "causative-agent", 1, 0.3),
    ("BioRED", "Association", "disease", "variant", "associated-with", 2, 0.7),
    ("BioRED", "Association", "disease", "variant", "causative-agent", 1, 0.3),
    ("BioRED", "Association", "gene", "chemical", "associated-with", 2, 1.0),
    ("BioRED", "Association", "variant", "chemical", "associated-with", 2, 1.0),
    ("BioRED", "Association", "variant", "variant", "associated-with", 2, 1.0),
    ("BioRED", "Positive_Correlation", "chemical", "variant", "associated-with", 2, 0.6),
    ("BioRED", "Positive_Correlation", "chemical", "variant", "causes", 2, 0.4),
    ("BioRED", "Positive_Correlation", "disease", "chemical", "causes", 2, 0.6),
    ("BioRED", "Positive_Correlation", "disease", "chemical", "causative-agent", 1, 0.3),
    ("BioRED", "Positive_Correlation", "disease", "chemical", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "disease", "gene", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "disease", "gene", "causative-agent", 1, 0.4),
    ("BioRED", "Positive_Correlation", "disease", "gene", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "disease", "variant", "causes", 2, 0.5),
    ("BioRED", "Positive_Correlation", "disease", "variant", "causative-agent", 1, 0.4),
    ("BioRED", "Positive_Correlation", "disease", "variant", "associated-with", 2, 0.1),
    ("BioRED", "Positive_Correlation", "gene", "chemical", "associated-with", 2, 0.6),
    ("BioRED", "Positive_Correlation", "gene", "chemical", "causes", 2, 0.4),
    ("BioRED", "Positive_Correlation", "variant", "chemical", "associated-with", 2, 0.6),
    ("BioRED", "Positive_Correlation", "variant", "chemical", "causes", 2, 0.4),
    ("BioRED", "Negative_Correlation", "chemical", "variant", "associated-with", 2, 0.6),
    ("BioRED", "Negative_Correlation", "chemical", "variant", "interacts-with", 2, 0.4),
    ("BioRED", "Negative_Correlation", "disease", "chemical", "treats", 2, 0.7),
    ("BioRED", "Negative_Correlation", "disease", "chemical", "associated-with", 2, 0.2),
    ("BioRED", "Negative_Correlation", "disease", "chemical", "due-to", 1, 0.1),
    ("BioRED", "Negative_Correlation", "disease", "gene", "associated-with", 2, 0.7),
    ("BioRED", "Negative_Correlation", "disease", "gene", "causes", 2, 0.3),
    ("BioRED", "Negative_Correlation", "gene", "chemical", "associated-with", 2, 0.6),
    ("BioRED", "Negative_Correlation", "gene", "chemical", "interacts-with", 2, 0.4),
    ("BioRED", "Negative_Correlation", "variant", "chemical", "associated-with", 2, 0.7),
    ("BioRED", "Negative_Correlation", "variant", "chemical", "interacts-with", 2, 0.3),
    ("BioRED", "Bind", "gene", "chemical", "interacts-with", 2, 1.0),
    ("BioRED", "Cotreatment", "gene", "chemical", "co-treats", 2, 1.0),
]

# Semantic types and the top concept that stands for each.
TYPE_ROOTS = [
    ("Disease or Syndrome", "64572001", "Disease"),
    ("Pathologic Function", "64572001", "Disease"),
    ("Mental or Behavioral Dysfunction", "74732009", "Mental disorder"),
    ("Neoplastic Process", "108369006", "Neoplasm"),
    ("Sign or Symptom", "404684003", "Clinical finding"),
    ("Finding", "404684003", "Clinical finding"),
    ("Anatomical Abnormality", "49755003", "Morphologically abnormal structure"),
    ("Congenital Abnormality", "66091009", "Congenital disease"),
    ("Acquired Abnormality", "49755003", "Morphologically abnormal structure"),
    ("Injury or Poisoning", "417746004", "Traumatic injury"),
    ("Cell or Molecular Dysfunction", "404684003", "Clinical finding"),
    ("Pharmacologic Substance", "373873005", "Pharmaceutical / biologic product"),
    ("Antibiotic", "373873005", "Pharmaceutical / biologic product"),
    ("Clinical Drug", "373873005", "Pharmaceutical / biologic product"),
    ("Organic Chemical", "105590001", "Substance"),
    ("Inorganic Chemical", "105590001", "Substance"),
    ("Chemical", "105590001", "Substance"),
    ("Chemical Viewed Functionally", "105590001", "Substance"),
    ("Chemical Viewed Structurally", "105590001", "Substance"),
    ("Hormone", "105590001", "Substance"),
    ("Enzyme", "105590001", "Substance"),
    ("Nucleic Acid, Nucleoside, or Nucleotide", "105590001", "Substance"),
    ("Element, Ion, or Isotope", "105590001", "Substance"),
    ("Vitamin", "105590001", "Substance"),
    ("Steroid", "105590001", "Substance"),
    ("Lipid", "105590001", "Substance"),
    ("Carbohydrate", "105590001", "Substance"),
    ("Amino Acid, Peptide, or Protein", "105590001", "Substance"),
    ("Biomedical or Dental Material", "105590001", "Substance"),
    ("Indicator, Reagent, or Diagnostic Aid", "105590001", "Substance"),
    ("Hazardous or Poisonous Substance", "105590001", "Substance"),
    ("Immunologic Factor", "105590001", "Substance"),
    ("Receptor", "105590001", "Substance"),
    ("Neuroreactive Substance or Biogenic Amine", "105590001", "Substance"),
    ("Body Substance", "105590001", "Substance"),
]

# Confidences of the four tiers, their threshold, ranks of term types.
CURATED_CONFIDENCE, SHARED_CONFIDENCE, FALLBACK_CONFIDENCE, HIGH_CONFIDENCE = 0.95, 0.90, 0.40, 0.80
HOP_CONFIDENCE = {"SY": 0.70, "RQ": 0.68, "RB": 0.65, "RN": 0.55}
TERM_RANK = {"PT": 0, "FN": 1, "SY": 2, "PTGB": 3}
OTHER_RANK = 99

# Relations of both tiers, attribute concepts of the first, anchors of classes and scopes, rule texts.
TIER1_ATTRIBUTES = {"causative-agent": "246075003", "finding-site": "363698007", "associated-morphology": "116676008", "due-to": "42752001", "after": "255234002"}
TIER2_RELATIONS = ("treats", "causes", "associated-with", "interacts-with", "co-treats", "converts-to", "compared-with")
CLASS_ANCHORS = {"disease": ("404684003", "64572001"), "chemical": ("105590001", "373873005")}
SCOPE_ANCHORS = {"finding": "404684003", "substance": "105590001", "product": "373873005", "event": "272379006", "procedure": "71388002"}
SYNTHETIC_ATTRIBUTES = {"246075003": "causative-agent", "42752001": "due-to", "255234002": "after"}
RULE_STRENGTH = {"723597001": "Mandatory CM rule", "723598006": "Optional CM rule"}
CONTENT_TYPE = {
    "723596005": "All SNOMED CT content",
    "723593002": "Precoordinated content only",
    "723594008": "Postcoordinated content only",
    "723595009": "New precoordinated content only",
}
IS_A, ROOT, FULL_NAME, SYNONYM = "116680003", "138875005", "900000000000003001", "900000000000013009"

# Relation names of the bulk source and their label; any other is associated-with; all are of tier 2.
BULK_RELATIONS = {"treat": "treats", "cotreat": "co-treats", "cause": "causes"}
DEFAULT_RELATION, DEFAULT_TIER = "associated-with", 2

# Limits and weights of the later steps.
INACTIVE_FACTOR, NEIGHBOURS, TEMPERATURE = 0.5, 30, 0.05
SYNTHETIC_CONFIDENCE, LEAST_CAUSATIVE = 0.65, 3000
SAMPLE_SIZE, COVERAGE, FOOTPRINT_CONFIDENCE, LEAST_SCORE, SILVER_CONFIDENCE = 25_000, 3, 0.8, 0.7, 0.4
BULK_WEIGHT, BULK_DOCUMENTS, BULK_PMIDS = 0.4, 500_000, 2_000_000
BOOST, APPENDED = 2.0, 0.5
NEGATIVE_RATIO, MAX_PAIRS = 2.0, 64
TOP_TYPES, TOP_CONCEPTS, TOP_RELATIONS, SCORE_SCALE = 2, 10, 3, 1000
SENTINELS = ("", "-", "-1")
CLASSES = ("cell_line", "chemical", "disease", "gene", "species", "variant")


def relation_labels() -> list[str]:
    """The labels of a relation classifier: every target relation in order, then none."""
    return [*sorted({*TIER1_ATTRIBUTES, *TIER2_RELATIONS}), "no-relation"]


def bio_labels() -> list[str]:
    return ["O", *(f"{p}-{c}" for c in CLASSES for p in "BI")]


def scope(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITY_TYPES, "corpus string, entity_type string, vocabulary string, semantic_class string, in_scope boolean")


def relation_table(spark: SparkSession) -> DataFrame:
    schema = "corpus string, source_relation_type string, subject_class string, object_class string, target_relation string, tier int, probability double, ord int"
    return spark.createDataFrame([(*row, place) for place, row in enumerate(RELATION_MAPPINGS)], schema)


def type_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TYPE_ROOTS, "sty string, target_id string, term string")
