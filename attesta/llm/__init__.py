"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .bpe import op9_bpe_round_trip
from .embeddings import OP1_SQL, op1_embedding_near_dedup
from .kneser_ney import op3_language_model_scores
from .licenses import op6_license_scan
from .neighbours import op10_nearest_neighbours
from .packing import op4_best_fit_packing
from .quality import op7_quality_classifier
from .ranking import OP12_SQL, op12_ranked_search
from .secrets import op5_secret_scan
from .simhash import op2_simhash_near_dedup
from .toxicity import op13_toxicity
from .variants import OP11_SQL, op11_spelling_variants
from .warc import OP8_SQL, op8_warc_round_trip

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_simhash_near_dedup,
        op3_language_model_scores,
        op4_best_fit_packing,
        op5_secret_scan,
        op6_license_scan,
        op7_quality_classifier,
        op8_warc_round_trip,
        op9_bpe_round_trip,
        op10_nearest_neighbours,
        op11_spelling_variants,
        op12_ranked_search,
        op13_toxicity,
    )
}

#: DuckDB SQL of the queries that SQL can express over whole tables.
ORACLE_SQL = {"op1_embedding_near_dedup": OP1_SQL, "op8_warc_round_trip": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_ranked_search": OP12_SQL}
