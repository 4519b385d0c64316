"""Queries of the operators of this package and their SQL twins."""

from litscreen.llm import (
    chat,
    clustering,
    decontamination,
    exact_dedup,
    licenses,
    line_dedup,
    near_dedup,
    packing,
    quality,
    ranked_search,
    sentence_pieces,
    sharding,
    url_filter,
)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_licenses": licenses.op2_licenses,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_chat": chat.op9_chat,
    "op10_packing": packing.op10_packing,
    "op11_pieces": sentence_pieces.op11_pieces,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_clusters": clustering.op13_clusters,
}
ORACLES = {
    "op2_licenses": licenses.ORACLE_SQL,
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op7_near_dedup": near_dedup.ORACLE_SQL,
    "op8_decontamination": decontamination.ORACLE_SQL,
    "op9_chat": chat.ORACLE_SQL,
    "op12_ranked_search": ranked_search.ORACLE_SQL,
    "op13_clusters": clustering.ORACLE_SQL,
}
