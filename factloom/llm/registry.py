"""The queries of this package, for ``__spark_entry__``."""

from __future__ import annotations

from factloom.llm import licences, merkle, phrases, secrets, substrings
from factloom.llm.decontamination import op9_simhash_decontamination
from factloom.llm.licences import op6_licence_digests
from factloom.llm.media import op7_media_columns
from factloom.llm.merkle import op13_merkle_manifest
from factloom.llm.near_dups import op4_tensored_minhash
from factloom.llm.packing import op10_best_fit_packing
from factloom.llm.phrases import op12_phrase_collocations
from factloom.llm.quality import op8_attention_quality
from factloom.llm.secrets import op3_secret_scan
from factloom.llm.sharding import op2_hash_tree_shards
from factloom.llm.substrings import op11_substring_automata
from factloom.llm.token_files import op1_token_files
from factloom.llm.url_filter import op5_host_reputation

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_hash_tree_shards": op2_hash_tree_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_tensored_minhash": op4_tensored_minhash,
    "op5_host_reputation": op5_host_reputation,
    "op6_licence_digests": op6_licence_digests,
    "op7_media_columns": op7_media_columns,
    "op8_attention_quality": op8_attention_quality,
    "op9_simhash_decontamination": op9_simhash_decontamination,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_substring_automata": op11_substring_automata,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The others lie beyond SQL: tokenizers, 64-bit hashes, learned weights, images.
ORACLES: dict[str, str] = {"op3_secret_scan": secrets.ORACLE, "op6_licence_digests": licences.ORACLE, "op11_substring_automata": substrings.ORACLE, "op12_phrase_collocations": phrases.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
