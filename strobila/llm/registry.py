"""The queries of this subpackage, by name."""

from __future__ import annotations

from strobila.llm import embedding_dedup, suffix_dedup
from strobila.llm.decontaminate import op9_decontamination
from strobila.llm.embedding_dedup import op6_embedding_neardup
from strobila.llm.langid import op4_language_id
from strobila.llm.quality import op2_quality_classifier
from strobila.llm.sentencepiece_fst import op3_sentencepiece
from strobila.llm.shard import op1_sharding
from strobila.llm.simhash import op5_simhash_neardup
from strobila.llm.suffix_dedup import op7_suffix_array_dedup
from strobila.llm.token_file import op10_token_file
from strobila.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_language_id": op4_language_id,
    "op5_simhash_neardup": op5_simhash_neardup,
    "op6_embedding_neardup": op6_embedding_neardup,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_token_file": op10_token_file,
}
#: No SQL states the others: hashes that SQL does not have, trained models, tokenizers, random draws. All of them are
#: tested against plain Python.
ORACLE_SQL: dict[str, str] = {"op6_embedding_neardup": embedding_dedup.SQL, "op7_suffix_array_dedup": suffix_dedup.SQL}
