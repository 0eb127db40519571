"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, embed_dedup, exact_dedup, hard_negatives, html_extract, langid, license_scan, line_dedup, merkle, minhash, packing, sharding, suffix_dedup


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_license": license_scan.op2_license,
        "op3_suffix": suffix_dedup.op3_suffix,
        "op4_minhash": minhash.op4_minhash,
        "op5_bpe": bpe.op5_bpe,
        "op6_langid": langid.op6_langid,
        "op7_embedding": embed_dedup.op7_embedding,
        "op8_sharding": sharding.op8_sharding,
        "op9_html": html_extract.op9_html,
        "op10_packing": packing.op10_packing,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op3_suffix": suffix_dedup.SQL, "op4_minhash": minhash.SQL, "op7_embedding": embed_dedup.SQL, "op11_line_dedup": line_dedup.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_merkle": merkle.SQL}
