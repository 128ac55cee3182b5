"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from wavetable.llm import host_rules, jaccard, mixture, suffixes
from wavetable.llm.bpe import op5_byte_bpe
from wavetable.llm.gear import op3_chunk_dedup
from wavetable.llm.host_rules import op2_host_rules
from wavetable.llm.jaccard import op7_jaccard
from wavetable.llm.media import op8_media_clips
from wavetable.llm.mixture import op10_mixture
from wavetable.llm.nbsvm import op4_quality
from wavetable.llm.shards import op1_training_order
from wavetable.llm.suffixes import op9_suffix_dedup
from wavetable.llm.token_counts import op6_token_counts


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_training_order, op2_host_rules, op3_chunk_dedup, op4_quality, op5_byte_bpe, op6_token_counts, op7_jaccard, op8_media_clips, op9_suffix_dedup, op10_mixture)}


def oracle_sql() -> dict[str, str]:
    return {"op2_host_rules": host_rules.SQL, "op7_jaccard": jaccard.SQL, "op9_suffix_dedup": suffixes.SQL, "op10_mixture": mixture.SQL}
