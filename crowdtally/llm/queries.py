"""The operators' queries, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from . import (byte_bpe, decontaminate, fill_middle, language, neighbours, packing, pii, shard,
               simhash, source_audit, token_counts, token_files, toxicity)

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_token_counts": token_counts.query,
    "op3_neighbours": neighbours.query,
    "op4_shard": shard.query,
    "op5_token_files": token_files.query,
    "op6_decontaminate": decontaminate.query,
    "op7_language": language.query,
    "op8_pii": pii.query,
    "op9_byte_bpe": byte_bpe.query,
    "op10_simhash": simhash.query,
    "op11_fill_middle": fill_middle.query,
    "op12_packing": packing.query,
    "op13_source_audit": source_audit.query,
}

#: The others have none: trained models, tokenizers, hashes that SQL lacks (XXH64, CRC-32),
#: or an approximate result.  Their tests compare with brute force.
ORACLES = {"op6_decontaminate": decontaminate.ORACLE, "op11_fill_middle": fill_middle.ORACLE,
           "op13_source_audit": source_audit.ORACLE}
