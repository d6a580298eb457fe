"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .collocations import SQL11, op11
from .decontaminate import op9
from .fill_middle import SQL13, op13
from .idstore import op2
from .license_scan import SQL4, op4
from .lm_score import op1
from .near_dedup import SQL7, op7
from .packing import op3
from .site_style import op10
from .substring_dedup import SQL6, op6
from .topk import SQL8, op8
from .toxicity import op5
from .url_rules import SQL12, op12


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_lm_score": op1, "op2_id_files": op2, "op3_packing": op3, "op4_license_scan": op4, "op5_toxicity": op5, "op6_substring_dedup": op6, "op7_near_dedup": op7, "op8_exact_topk": op8, "op9_decontamination": op9, "op10_main_text": op10, "op11_collocations": op11, "op12_url_rules": op12, "op13_fill_middle": op13}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": SQL4, "op6_substring_dedup": SQL6, "op7_near_dedup": SQL7, "op8_exact_topk": SQL8, "op11_collocations": SQL11, "op12_url_rules": SQL12, "op13_fill_middle": SQL13}
