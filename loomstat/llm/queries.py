"""Registered queries of this subpackage: ``QUERIES`` name -> (spark, sf_dir) -> DataFrame, ``ORACLE`` name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomstat.llm.additive import op11_quality_classifier
from loomstat.llm.chat import OP2_SQL, op2_chat_format
from loomstat.llm.decontam import op3_decontaminate
from loomstat.llm.divergence import OP13_SQL, op13_source_divergence
from loomstat.llm.hyperlang import op10_language_id
from loomstat.llm.licenses import OP1_SQL, op1_license_scan
from loomstat.llm.mixing import op4_soft_mixing
from loomstat.llm.neardup import op5_near_duplicates
from loomstat.llm.pii import op7_pii_crf
from loomstat.llm.quality import op6_quality_rules
from loomstat.llm.survival import OP12_SQL, op12_filter_audit
from loomstat.llm.urls import op8_url_filter
from loomstat.llm.wavelet import op9_wavelet_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_soft_mixing": op4_soft_mixing,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_quality_rules": op6_quality_rules,
    "op7_pii_crf": op7_pii_crf,
    "op8_url_filter": op8_url_filter,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_language_id": op10_language_id,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_filter_audit": op12_filter_audit,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE: dict[str, str] = {"op1_license_scan": OP1_SQL, "op2_chat_format": OP2_SQL,
                          "op12_filter_audit": OP12_SQL, "op13_source_divergence": OP13_SQL}
