"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from geostrata.llm.decontaminate import op10_benchmark_decontamination
from geostrata.llm.hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from geostrata.llm.hard_negatives import op13_hard_negatives
from geostrata.llm.html_extract import op7_html_extraction
from geostrata.llm.jaccard_join import ORACLE_SQL as JACCARD_SQL
from geostrata.llm.jaccard_join import op5_jaccard_join
from geostrata.llm.license_scan import op4_license_scan
from geostrata.llm.mixing import op9_cube_mixing
from geostrata.llm.packing import op11_packing
from geostrata.llm.periodic import op12_periodic_runs
from geostrata.llm.progressive_jpeg import op1_progressive_jpeg
from geostrata.llm.quality import op3_quality_classifier
from geostrata.llm.sharding import op2_histogram_sharding
from geostrata.llm.token_counts import op6_token_counts
from geostrata.llm.training_order import op8_training_order

QUERIES = {
    "op1_progressive_jpeg": op1_progressive_jpeg,
    "op2_histogram_sharding": op2_histogram_sharding,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_license_scan": op4_license_scan,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_training_order": op8_training_order,
    "op9_cube_mixing": op9_cube_mixing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_packing": op11_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {"op5_jaccard_join": JACCARD_SQL, "op13_hard_negatives": NEGATIVES_SQL}
