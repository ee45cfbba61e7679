"""The queries of this subpackage and their SQL equivalents, where SQL can express them."""

from __future__ import annotations

from . import bpe, chaining, decontaminate, language, licenses, minhash, pfor, sampling, suffix, warc

QUERIES = {
    "op3_language_id": language.op3_language_id,
    "language_id_pages": language.language_id_pages,
    "op4_fingerprints": sampling.op4_fingerprints,
    "op8_license_scan": licenses.op8_license_scan,
    "op5_substring_dedup": chaining.op5_substring_dedup,
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op7_near_dedup": minhash.op7_near_dedup,
    "op10_warc": warc.op10_warc,
    "op2_bpe": bpe.op2_bpe,
    "op9_token_files": pfor.op9_token_files,
    "op6_decontaminate": decontaminate.op6_decontaminate,
}
ORACLES = {
    "op10_warc": warc.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
}
