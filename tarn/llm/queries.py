"""The queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from tarn.llm.attribution import op8_attribution
from tarn.llm.chosen_path import OP3_SQL, op3_near_duplicates
from tarn.llm.chunks import op9_media
from tarn.llm.grace import OP4_SQL, op4_exact_dedup
from tarn.llm.packing import op10_packing
from tarn.llm.periodic import OP12_SQL, op12_periodic_runs
from tarn.llm.pieces import op2_pieces
from tarn.llm.secrets import op7_secrets
from tarn.llm.shards import OP5_SQL, op5_shards
from tarn.llm.spelling import OP11_SQL, op11_spelling
from tarn.llm.toxicity import op6_toxicity
from tarn.llm.warc import OP1_SQL, op1_warc
from tarn.llm.wavelet import op13_wavelet

QUERIES = {f.__name__: f for f in (op1_warc, op2_pieces, op3_near_duplicates, op4_exact_dedup, op5_shards, op6_toxicity, op7_secrets, op8_attribution, op9_media, op10_packing, op11_spelling, op12_periodic_runs, op13_wavelet)}

SQL = {"op1_warc": OP1_SQL, "op3_near_duplicates": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op5_shards": OP5_SQL, "op11_spelling": OP11_SQL, "op12_periodic_runs": OP12_SQL}
