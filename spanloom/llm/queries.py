"""The queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.decontaminate import OP3_SQL, op3_decontaminate
from spanloom.llm.jaccard import OP1_SQL, op1_jaccard
from spanloom.llm.lines import OP7_SQL, op7_line_dedup
from spanloom.llm.packing import op10_packing
from spanloom.llm.quality import op8_quality
from spanloom.llm.secrets import OP5_SQL, op5_secrets
from spanloom.llm.suffixes import OP4_SQL, op4_suffix_dedup
from spanloom.llm.toxicity import op6_toxicity
from spanloom.llm.url_filter import OP2_SQL, op2_url_filter
from spanloom.llm.winnow import op9_winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_jaccard, op2_url_filter, op3_decontaminate, op4_suffix_dedup, op5_secrets, op6_toxicity, op7_line_dedup, op8_quality, op9_winnowing, op10_packing)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_suffix_dedup": OP4_SQL, "op5_secrets": OP5_SQL, "op7_line_dedup": OP7_SQL}
