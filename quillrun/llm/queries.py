"""The registered queries of this package and their SQL."""

from quillrun.llm.decontaminate import OP7_SQL, op7_benchmark_decontamination
from quillrun.llm.editsketch import op8_edit_fingerprints
from quillrun.llm.merkle import OP13_SQL, op13_merkle_manifest
from quillrun.llm.mixing import OP3_SQL, op3_mixing
from quillrun.llm.pii import op10_personal_data
from quillrun.llm.quality import op9_quality
from quillrun.llm.secrets import OP5_SQL, op5_secret_scan
from quillrun.llm.seedextend import OP12_SQL, op12_seed_extend_dedup
from quillrun.llm.simhash import op2_simhash_near_dedup
from quillrun.llm.suffixes import OP4_SQL, op4_suffix_dedup
from quillrun.llm.toxicity import op1_toxicity
from quillrun.llm.urlfilter import op6_url_filter
from quillrun.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_edit_fingerprints": op8_edit_fingerprints,
    "op9_quality": op9_quality,
    "op10_personal_data": op10_personal_data,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_seed_extend_dedup": op12_seed_extend_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL = {
    "op3_mixing": OP3_SQL,
    "op4_suffix_dedup": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op12_seed_extend_dedup": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
