"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procura.llm.ann import op8_ann
from procura.llm.centroids import OP11_SQL, op11_centroids
from procura.llm.chat_format import OP4_SQL, op4_chat_format
from procura.llm.collocations import OP12_SQL, op12_collocations
from procura.llm.decontamination import OP5_SQL, op5_decontamination
from procura.llm.html_extract import op6_html_extract
from procura.llm.language_id import op3_language_id
from procura.llm.mixing import op9_mixing
from procura.llm.secret_scan import op10_secret_scan
from procura.llm.sharding import op2_sharding
from procura.llm.simhash import op7_simhash
from procura.llm.substring_dedup import op1_substring_dedup
from procura.llm.url_filter import op13_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_sharding": op2_sharding,
        "op3_language_id": op3_language_id,
        "op4_chat_format": op4_chat_format,
        "op5_decontamination": op5_decontamination,
        "op6_html_extract": op6_html_extract,
        "op7_simhash": op7_simhash,
        "op8_ann": op8_ann,
        "op9_mixing": op9_mixing,
        "op10_secret_scan": op10_secret_scan,
        "op11_centroids": op11_centroids,
        "op12_collocations": op12_collocations,
        "op13_url_filter": op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4_SQL, "op5_decontamination": OP5_SQL, "op11_centroids": OP11_SQL, "op12_collocations": OP12_SQL}
