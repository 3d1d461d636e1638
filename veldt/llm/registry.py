"""The queries of this subpackage and their SQL, as __spark_entry__ adds them."""

from veldt.llm import chat_format, decontaminate, minhash, mixing, quality, repeats, secrets, simhash, token_counts, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_mixing": mixing.op2_mixing,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op3_quality": quality.op3_quality,
    "op4_repeats": repeats.op4_repeats,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_minhash": minhash.op8_minhash,
    "op9_secrets": secrets.op9_secrets,
    "op10_simhash": simhash.op10_simhash,
}

SQL = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op5_decontamination": decontaminate.OP5_SQL,
}
