"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.bytebpe import op7_bytebpe
from leafmill.llm.lattice import op8_lattice
from leafmill.llm.mixing import OP4_SQL, op4_mix
from leafmill.llm.near import op10_near
from leafmill.llm.quality import op5_quality
from leafmill.llm.secrets import op2_secrets
from leafmill.llm.tokencount import op6_tokencount
from leafmill.llm.toxicity import op9_toxicity
from leafmill.llm.warc import OP1_SQL, op1_warc
from leafmill.llm.webpstore import op3_webp

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_secrets": op2_secrets,
    "op3_webp": op3_webp,
    "op4_mix": op4_mix,
    "op5_quality": op5_quality,
    "op6_tokencount": op6_tokencount,
    "op7_bytebpe": op7_bytebpe,
    "op8_lattice": op8_lattice,
    "op9_toxicity": op9_toxicity,
    "op10_near": op10_near,
}

ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op4_mix": OP4_SQL,
}
