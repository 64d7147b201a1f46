"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from slotwise.llm import oracles
from slotwise.llm.decontaminate import op8_decontamination
from slotwise.llm.embedding_dedup import op7_embedding_dedup
from slotwise.llm.fill_middle import op12_fill_in_middle
from slotwise.llm.fingerprints import op11_document_fingerprints
from slotwise.llm.licenses import op6_license_scan
from slotwise.llm.line_dedup import op1_line_dedup
from slotwise.llm.merkle import op13_merkle_manifest
from slotwise.llm.minhash import op2_minhash
from slotwise.llm.mixing import op10_mixing
from slotwise.llm.quality import op4_quality_classifier
from slotwise.llm.secrets import op5_secret_scan
from slotwise.llm.token_output import op3_token_output
from slotwise.llm.toxicity import op9_toxicity


def queries():
    own = (op1_line_dedup, op2_minhash, op3_token_output, op4_quality_classifier, op5_secret_scan, op6_license_scan, op7_embedding_dedup, op8_decontamination, op9_toxicity, op10_mixing, op11_document_fingerprints, op12_fill_in_middle, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql():
    return {
        "op1_line_dedup": oracles.LINE_DEDUP, "op2_minhash": oracles.NEAR_DUPLICATES, "op7_embedding_dedup": oracles.EMBEDDING_DUPLICATES, "op8_decontamination": oracles.DECONTAMINATION,
        "op12_fill_in_middle": oracles.FILL_IN_MIDDLE, "op13_merkle_manifest": oracles.MERKLE,
    }
