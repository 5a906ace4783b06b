"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .decontaminate import op5_decontamination
from .embeddings import op4_embedding_range_join
from .langid import op3_language_id
from .lm import op7_deleted_interpolation
from .mixing import op10_mix_hash_threshold
from .negatives import OP11_SQL, op11_hard_negatives
from .passages import OP12_SQL, op12_substring_dedup
from .periodic import op13_periodic_runs
from .pii import op2_pii_weak_supervision
from .secrets import op1_secret_guess_cost
from .simhash import op6_simhash_covering
from .urls import op8_url_gbt
from .warc import op9_warc_writer

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_guess_cost, op2_pii_weak_supervision, op3_language_id, op4_embedding_range_join, op5_decontamination,
        op6_simhash_covering, op7_deleted_interpolation, op8_url_gbt, op9_warc_writer, op10_mix_hash_threshold,
        op11_hard_negatives, op12_substring_dedup, op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_substring_dedup": OP12_SQL}
