"""The queries of this package and, where SQL expresses them, their SQL."""

from __future__ import annotations

from . import pii, secrets
from .decontamination import OP9_SQL, op9_benchmark_decontamination
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .linededup import OP10_SQL, op10_line_dedup
from .minhash import OP8_SQL, op8_minhash_near_dedup
from .packing import op1_best_fit_packing
from .pii import op7_pii
from .repeats import OP3_SQL, op3_suffix_array_dedup
from .secrets import op4_secret_scan
from .sharding import OP2_SQL, op2_sharding
from .toxicity import op5_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sharding": op2_sharding,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_toxicity": op5_toxicity,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_pii": op7_pii,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_line_dedup": op10_line_dedup,
    "base_secret_spans": secrets.base_secret_spans,
    "base_pii_spans": pii.base_pii_spans,
}
ORACLES = {
    "op2_sharding": OP2_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "base_secret_spans": secrets.BASE_SQL,
    "base_pii_spans": pii.BASE_SQL,
}
