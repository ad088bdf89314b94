"""Operators for training-data pipelines. Nothing else in the library imports this package."""


def queries():
    import corpus_pipeline
    from sluice.llm import (benchmark_decontamination, chat_formatting, line_dedup, lm_scoring, packing, quality_rules, sharding,
                            simhash_dedup, toxicity, url_filters)

    return {
        "op1_url_filters": url_filters.op1, "op2_toxicity": toxicity.op2, "op3_decontamination": benchmark_decontamination.op3,
        "op4_sharding": sharding.op4, "op5_packing": packing.op5, "op6_line_dedup": line_dedup.op6, "op7_chat_formatting": chat_formatting.op7,
        "op8_quality_rules": quality_rules.op8, "op9_lm_scoring": lm_scoring.op9, "op10_simhash": simhash_dedup.op10, "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    from sluice.llm import benchmark_decontamination, chat_formatting, quality_rules, url_filters

    return {"op1_url_filters": url_filters.SQL, "op3_decontamination": benchmark_decontamination.SQL, "op7_chat_formatting": chat_formatting.SQL, "op8_quality_rules": quality_rules.SQL}
