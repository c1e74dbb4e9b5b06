"""The queries of this subpackage and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontam, jaccard, licenses, lm, mixing, packing, pii, quality, warc
from graphloom.llm.htmltext import op7_html_extraction



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``corpus_pipeline.py`` at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_license_scans": licenses.op1_license_scans,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_mixing": mixing.op4_mixing,
    "op5_decontamination": decontam.op5_decontamination,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_token_packing": packing.op10_token_packing,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {}
