"""Registry of the training-data queries."""

import corpus_pipeline
from panelforge.llm.decontamination import op7_decontamination
from panelforge.llm.filter_audit import op13_filter_audit
from panelforge.llm.language_id import op10_language_id
from panelforge.llm.mixing import op9_mixing
from panelforge.llm.ngram_join import op1_ngram_jaccard_join
from panelforge.llm.oracles import ORACLES
from panelforge.llm.packing import op12_packing
from panelforge.llm.personal_data import op6_personal_data
from panelforge.llm.quality_rules import op8_quality_rules
from panelforge.llm.secrets import op5_secret_scan
from panelforge.llm.sharding import op4_sharding
from panelforge.llm.toxicity import op2_toxicity
from panelforge.llm.warc import op3_warc
from panelforge.llm.whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_toxicity,
        op3_warc,
        op4_sharding,
        op5_secret_scan,
        op6_personal_data,
        op7_decontamination,
        op8_quality_rules,
        op9_mixing,
        op10_language_id,
        op11_whitening,
        op12_packing,
        op13_filter_audit,
    )
} | {"pipeline": corpus_pipeline.run}

