"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from sparkloom.llm import ann, bpe, langid, licenses, media, packing, resample, secrets, simhash, token_binary, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op5_packing": packing.op5_packing,
        "op6_secrets": secrets.op6_secrets,
        "op8_bpe": bpe.op8_bpe,
        "op1_simhash": simhash.op1_simhash,
        "op3_language": langid.op3_language,
        "op7_media": media.op7_media,
        "op10_nearest": ann.op10_nearest,
        "op4_licenses": licenses.op4_licenses,
        "op9_toxicity": toxicity.op9_toxicity,
        "op2_token_binary": token_binary.op2_token_binary,
        "op11_warc": warc.op11_warc,
        "op12_resample": resample.op12_resample,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_warc": warc.OP11_SQL, "op12_resample": resample.OP12_SQL}
