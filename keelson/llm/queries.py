"""The dealt operators' queries, by registered name, and the SQL of those that SQL can express."""

from __future__ import annotations

from keelson.llm import chat, filter_audit, knn_join, recompression, warc
from keelson.llm.decontam import op3_bmw_decontamination
from keelson.llm.langid import op5_byte_cnn_langid
from keelson.llm.logbilinear import op11_logbilinear_scores
from keelson.llm.packing import op4_conflict_best_fit
from keelson.llm.pii import op8_contextual_pii
from keelson.llm.runs import op13_periodic_runs
from keelson.llm.sharding import op9_jump_consistent_sharding
from keelson.llm.simhash import op7_simhash_tiles

QUERIES = {
    "op1_warc_chunk_table": warc.op1_warc_chunk_table,
    "op2_snapshot_collapse": chat.op2_snapshot_collapse,
    "op3_bmw_decontamination": op3_bmw_decontamination,
    "op4_conflict_best_fit": op4_conflict_best_fit,
    "op5_byte_cnn_langid": op5_byte_cnn_langid,
    "op6_recompression_dedup": recompression.op6_recompression_dedup,
    "op7_simhash_tiles": op7_simhash_tiles,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_jump_consistent_sharding": op9_jump_consistent_sharding,
    "op10_voronoi_knn": knn_join.op10_voronoi_knn,
    "op11_logbilinear_scores": op11_logbilinear_scores,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_chunk_table": warc.SQL,
    "op2_snapshot_collapse": chat.SQL,
    "op6_recompression_dedup": recompression.SQL,
    "op10_voronoi_knn": knn_join.SQL,
    "op12_filter_audit": filter_audit.SQL,
}
