"""Queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from soripark.llm import class_ngram, graph_index, jaccard_join, language_id, metric_tree, mixing, periodic_runs, piece_encoding, quality_trees, ranked_search, substring_dedup, template_extraction, url_filters

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_metric_tree": metric_tree.op2,
    "op3_graph_search": graph_index.op3,
    "op4_mixing": mixing.op4,
    "op5_class_ngram": class_ngram.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_url_filters": url_filters.op7,
    "op8_html_text": template_extraction.op8,
    "op9_jaccard_join": jaccard_join.op9,
    "op10_pieces": piece_encoding.op10,
    "op11_periodic_runs": periodic_runs.op11,
    "op12_ranked_search": ranked_search.op12,
    "op13_quality_trees": quality_trees.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op2_metric_tree": metric_tree.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op12_ranked_search": ranked_search.OP12_SQL,
}
