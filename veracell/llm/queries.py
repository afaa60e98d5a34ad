"""Queries of this folder for ``__spark_entry__``: one a text operator."""

from __future__ import annotations

from .chat import op9_role_repair
from .decontaminate import op6_fm_decontaminate
from .pair_bpe import op8_pair_index_bpe
from .pii import op2_semi_crf_pii
from .quality import ABLATIONS_SQL, OP4_SQL, ledger_ablations, op4_rule_ledger
from .secrets import op10_entropy_secrets
from .simhash import op5_simhash_popcount
from .suffix_dedup import op3_suffix_dedup
from .token_counts import op7_whole_token_counts
from .token_files import op1_seekable_token_files

QUERIES = {f.__name__: f for f in (
    op1_seekable_token_files, op2_semi_crf_pii, op3_suffix_dedup, op4_rule_ledger, op5_simhash_popcount, op6_fm_decontaminate, op7_whole_token_counts,
    op8_pair_index_bpe, op9_role_repair, op10_entropy_secrets, ledger_ablations)}

#: DuckDB SQL of those that SQL can express.
ORACLE: dict[str, str] = {"op4_rule_ledger": OP4_SQL, "ledger_ablations": ABLATIONS_SQL}
