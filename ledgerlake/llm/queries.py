"""The queries of this subpackage and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from .bpe import op2_byte_bpe
from .decontaminate import OP13_SQL, op13_decontaminate
from .fingerprint import op8_fingerprint
from .knn import OP4_SQL, op4_topk
from .langid import op9_langid
from .line_dedup import OP1_SQL, op1_line_dedup
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_dup import op6_near_dup
from .packing import op7_packing
from .pii import op3_pii
from .search import OP12_SQL, op12_ranked_search
from .toxicity import op5_toxicity
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_pii": op3_pii,
    "op4_topk": op4_topk,
    "op5_toxicity": op5_toxicity,
    "op6_near_dup": op6_near_dup,
    "op7_packing": op7_packing,
    "op8_fingerprint": op8_fingerprint,
    "op9_langid": op9_langid,
    "op10_warc": op10_warc,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_decontaminate": op13_decontaminate,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op4_topk": OP4_SQL,
    "op10_warc": OP10_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_decontaminate": OP13_SQL,
}
