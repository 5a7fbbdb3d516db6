"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixlake.llm.chat import OP2_SQL, op2_chat
from helixlake.llm.chunks import op3_bpe
from helixlake.llm.contamination import OP1_SQL, op1_contamination
from helixlake.llm.katz import op6_katz
from helixlake.llm.langid import op12_language
from helixlake.llm.licenses import op5_licenses
from helixlake.llm.minhash import op10_minhash
from helixlake.llm.pii import op4_pii
from helixlake.llm.quality import op8_quality
from helixlake.llm.tokenids import op7_token_ids
from helixlake.llm.toxicity import op9_toxicity
from helixlake.llm.trie import OP11_SQL, op11_prefix_trie
from helixlake.llm.vector_codes import OP13_SQL, op13_vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_contamination": op1_contamination,
        "op2_chat": op2_chat,
        "op3_bpe": op3_bpe,
        "op4_pii": op4_pii,
        "op5_licenses": op5_licenses,
        "op6_katz": op6_katz,
        "op7_token_ids": op7_token_ids,
        "op8_quality": op8_quality,
        "op9_toxicity": op9_toxicity,
        "op10_minhash": op10_minhash,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_language": op12_language,
        "op13_vector_codes": op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_contamination": OP1_SQL, "op2_chat": OP2_SQL, "op11_prefix_trie": OP11_SQL, "op13_vector_codes": OP13_SQL}
