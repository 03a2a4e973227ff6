"""The driver's queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.bpe import op8_bpe_round_trip
from loomline.llm.brown import op10_brown_scores
from loomline.llm.chat_format import op12_chat_formatting
from loomline.llm.chat_format import oracle as chat_oracle
from loomline.llm.conversation_repair import op11_conversation_repair
from loomline.llm.html_extract import op9_html_extraction
from loomline.llm.licenses import op6_license_scan
from loomline.llm.licenses import oracle as license_oracle
from loomline.llm.packing import op4_packing
from loomline.llm.prefix_trie import op13_prefix_trie
from loomline.llm.prefix_trie import oracle as trie_oracle
from loomline.llm.quality import op7_quality_rules
from loomline.llm.simhash import op1_simhash_near_dedup
from loomline.llm.sketch import op5_document_fingerprints
from loomline.llm.substring import op2_substring_dedup
from loomline.llm.toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_document_fingerprints": op5_document_fingerprints,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_html_extraction": op9_html_extraction,
    "op10_brown_scores": op10_brown_scores,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op6_license_scan": license_oracle(), "op12_chat_formatting": chat_oracle(), "op13_prefix_trie": trie_oracle()}
