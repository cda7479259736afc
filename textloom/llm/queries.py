"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from textloom.llm import align, decontaminate, language_id, near_dedup, packing, quality, repetition, sharding, spelling, token_stream, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_token_stream": token_stream.query,
        "op2_language_id": language_id.query,
        "op3_packing": packing.query,
        "op4_decontaminate": decontaminate.query,
        "op5_quality": quality.query,
        "op6_url_filter": url_filter.query,
        "op7_toxicity": toxicity.query,
        "op8_repetition": repetition.query,
        "op9_near_dedup": near_dedup.query,
        "op10_warc": warc.query,
        "op11_sharding": sharding.query,
        "op12_alignment": align.query,
        "op13_spelling": spelling.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_repetition": repetition.SQL, "op10_warc": warc.SQL, "op11_sharding": sharding.SQL, "op13_spelling": spelling.SQL}
