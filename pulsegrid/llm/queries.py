"""Registered corpus queries and, where SQL can express them, their SQL answers."""

from __future__ import annotations

from pulsegrid.llm.exact_dedup import OP9_SQL, op9_exact_dedup
from pulsegrid.llm.fingerprints import op7_fingerprints
from pulsegrid.llm.lines import OP3_SQL, op3_lines
from pulsegrid.llm.maxent import op1_maxent
from pulsegrid.llm.merkle import OP13_SQL, op13_merkle
from pulsegrid.llm.minhash import OP4_SQL, op4_minhash
from pulsegrid.llm.mixing import op8_mixing
from pulsegrid.llm.negatives import OP12_SQL, op12_negatives
from pulsegrid.llm.packing import op2_packing
from pulsegrid.llm.quality import op5_quality
from pulsegrid.llm.sharding import op6_sharding
from pulsegrid.llm.urls import op10_url_filters
from pulsegrid.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_maxent": op1_maxent,
    "op2_packing": op2_packing,
    "op3_lines": op3_lines,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filters": op10_url_filters,
    "op11_warc": op11_warc,
    "op12_negatives": op12_negatives,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op3_lines": OP3_SQL,
    "op4_minhash": OP4_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_warc": OP11_SQL,
    "op12_negatives": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
