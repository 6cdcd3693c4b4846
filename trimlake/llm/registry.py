"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trimlake.llm.ann import op1_one_bit_ann
from trimlake.llm.bpe import op8_trie_bpe
from trimlake.llm.langid import op7_ftrl_langid
from trimlake.llm.mixing import op5_entropy_mix
from trimlake.llm.near_dups import op3_order_minhash
from trimlake.llm.pii import op2_pii_spans
from trimlake.llm.pll import op9_masked_pll
from trimlake.llm.quality import op6_compression_bands
from trimlake.llm.token_counts import op4_token_counts
from trimlake.llm.wavelet import op10_wavelet_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_one_bit_ann, op2_pii_spans, op3_order_minhash, op4_token_counts, op5_entropy_mix, op6_compression_bands, op7_ftrl_langid, op8_trie_bpe, op9_masked_pll, op10_wavelet_shards)
    }


def oracle_sql() -> dict[str, str]:
    """None: digests of tokenizers, checksums, compression, hashing and training are beyond SQL; tests hold these queries against brute force."""
    return {}
