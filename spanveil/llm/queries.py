"""The queries of this subpackage by name, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.chat import OP1_SQL, op1_chat_format
from spanveil.llm.decontaminate import OP10_SQL, op10_decontamination
from spanveil.llm.extract import op7_html_extract
from spanveil.llm.licenses import op4_license_scan
from spanveil.llm.mixing import op8_source_mix
from spanveil.llm.neighbours import op3_nearest_neighbours
from spanveil.llm.simhash import op9_simhash_neardup
from spanveil.llm.substrings import OP2_SQL, op2_substring_dedup
from spanveil.llm.tokenfiles import op5_token_files
from spanveil.llm.toxicity import op6_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_license_scan": op4_license_scan,
    "op5_token_files": op5_token_files,
    "op6_toxicity": op6_toxicity,
    "op7_html_extract": op7_html_extract,
    "op8_source_mix": op8_source_mix,
    "op9_simhash_neardup": op9_simhash_neardup,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op10_decontamination": OP10_SQL,
}
