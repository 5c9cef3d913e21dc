"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from .decontamination import op1_block_max_wand
from .hard_negatives import OP12_SQL, op12_vantage_points
from .jaccard_join import op11_token_combinations
from .language_model import op3_pitman_yor
from .lines import op8_line_crf
from .neardup import op4_odd_sketch
from .packing import op5_pack
from .periodic import op13_lyndon_runs
from .planes import op10_bit_planes
from .quality import op6_nearest_vote
from .secrets import OP9_SQL, op9_entropy_secrets
from .tokencount import op2_separator_scan
from .toxicity import op7_noisy_or

QUERIES = {f.__name__: f for f in (op1_block_max_wand, op2_separator_scan, op3_pitman_yor, op4_odd_sketch, op5_pack, op6_nearest_vote, op7_noisy_or, op8_line_crf, op9_entropy_secrets, op10_bit_planes, op11_token_combinations, op12_vantage_points, op13_lyndon_runs)}
ORACLES: dict[str, str] = {"op9_entropy_secrets": OP9_SQL, "op12_vantage_points": OP12_SQL}
