"""The queries of the operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_byte_bpe
from .exact_dedup import OP9_SQL, op9_exact_mph
from .line_dedup import op4_line_winnow
from .maxent_lm import op10_maxent_lm
from .mixture import op7_mixture
from .near_dedup import OP6_SQL, op6_odd_minhash
from .order_minhash import op3_order_minhash
from .quality_crf import op2_quality_crf
from .url_rules import OP8_SQL, op8_url_rules
from .warc import op5_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_byte_bpe": op1_byte_bpe, "op2_quality_crf": op2_quality_crf, "op10_maxent_lm": op10_maxent_lm, "op3_order_minhash": op3_order_minhash, "op4_line_winnow": op4_line_winnow, "op5_warc": op5_warc, "op6_odd_minhash": op6_odd_minhash, "op7_mixture": op7_mixture, "op8_url_rules": op8_url_rules, "op9_exact_mph": op9_exact_mph}


def oracle_sql() -> dict[str, str]:
    return {"op6_odd_minhash": OP6_SQL, "op8_url_rules": OP8_SQL, "op9_exact_mph": OP9_SQL}
