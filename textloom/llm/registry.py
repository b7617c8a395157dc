"""The queries of this subpackage by name, and the SQL that gives the same rows."""

from textloom.llm import byte_cnn, chat_format, co_training, decontaminate, html_extract, lattice_dedup, mixing, ngram_jaccard, pii, sharding

QUERIES = {
    "op1_html_density": html_extract.query,
    "op2_lattice_dedup": lattice_dedup.query,
    "op3_byte_cnn": byte_cnn.query,
    "op4_co_training": co_training.query,
    "op5_sharding": sharding.query,
    "op6_decontamination": decontaminate.query,
    "op7_chat_collapse": chat_format.query,
    "op8_poisson_mixing": mixing.query,
    "op9_pii": pii.query,
    "op10_ngram_jaccard": ngram_jaccard.query,
}
ORACLE = {
    "op6_decontamination": decontaminate.ORACLE,
    "op7_chat_collapse": chat_format.ORACLE,
    "op8_poisson_mixing": mixing.ORACLE,
}
