"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graintable.llm import conversations, lexical, urls
from graintable.llm.conversations import op11_conversation_repair
from graintable.llm.decontaminate import op10_decontamination
from graintable.llm.language import op8_language
from graintable.llm.lexical import op13_lexical_search
from graintable.llm.line_dedup import op4_line_dedup
from graintable.llm.neighbours import op6_neighbours
from graintable.llm.pieces import op7_sentencepiece
from graintable.llm.quality import op2_quality
from graintable.llm.rans import op1_token_ids
from graintable.llm.secrets import op3_secrets
from graintable.llm.simhash import op9_simhash
from graintable.llm.toxicity import op5_toxicity
from graintable.llm.urls import op12_url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline of the repository's top folder, over documents."""
    import corpus_pipeline  # it stands beside this package and uses it

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_quality": op2_quality,
        "op3_secrets": op3_secrets,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_neighbours": op6_neighbours,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_language": op8_language,
        "op9_simhash": op9_simhash,
        "op10_decontamination": op10_decontamination,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_url_filter": op12_url_filter,
        "op13_lexical_search": op13_lexical_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_conversation_repair": conversations.SQL, "op12_url_filter": urls.SQL, "op13_lexical_search": lexical.SQL}
