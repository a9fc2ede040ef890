"""Schemas of the tables and nested documents that the operators exchange."""

ENTITY = (
    "struct<id: string, span_start: int, span_end: int, surface_text: string, entity_type: string, semantic_class: string, "
    "original_code: string, mapped_id: string, mapping_confidence: double, target_active: boolean, out_of_scope: boolean, "
    "extra: struct<source_extra: string, silver: boolean, source: string>>"
)
CANDIDATE = "struct<target_relation: string, tier: int, probability: double>"
RELATION = (
    "struct<subject_idx: int, object_idx: int, source_relation_type: string, target_relation: string, tier: int, "
    "target_probability: double, novelty: string, extra: struct<subject_class: string, object_class: string, "
    f"default_used: boolean, target_candidates: array<{CANDIDATE}>, attribute_id: string, silver: boolean, source_score: double, source_relation: string>>"
)
DOCUMENT = (
    "pmid string, corpus string, split string, title string, abstract string, text string, "
    f"entities array<{ENTITY}>, relations array<{RELATION}>, schema_version string"
)
SCHEMA_VERSION = "2.1.0"

#: What every reader of annotated text gives, before documents are assembled.
RAW_DOCUMENT = (
    "pmid string, title string, abstract string, "
    "entities array<struct<start: int, end: int, mention: string, entity_type: string, code: string, extra: string>>, "
    "relations array<struct<relation_type: string, subject: string, object: string, novelty: string, score: double>>"
)

#: `ord` is anything that orders rows: readers give struct<file: string, block: bigint, row: bigint>.
ATOMS = "cui string, sab string, tty string, code string, str string, ord bigint"
RELS = "cui1 string, rel string, cui2 string, rela string, sab string, ord bigint"
TYPES = "cui string, sty string, ord bigint"
CURATED = "mapset string, from_code string, to_code string, rel string, ord bigint"

#: Columns of the pipe-separated vocabulary files.
RRF = {
    "MRCONSO": "cui lat ts lui stt sui ispref aui saui scui sdui sab tty code str srl suppress cvf".split(),
    "MRREL": "cui1 aui1 stype1 rel cui2 aui2 stype2 rela rui srui sab sl rg dir suppress cvf".split(),
    "MRSTY": "cui tui stn sty atui cvf".split(),
    "MRDEF": "cui aui atui satui sab def suppress cvf".split(),
    "MRMAP": (
        "mapsetcui mapsetsab mapsubsetid maprank mapid mapsid fromid fromsid fromexpr fromtype fromrule fromres rel rela "
        "toid tosid toexpr totype torule tores maprule mapres maptype mapatn mapatv cvf"
    ).split(),
}
