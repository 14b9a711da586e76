"""The queries of this subpackage and the SQL of those that SQL can express."""

from .decontam import op4_decontamination
from .forest import OP11_SQL, op11_lsh_forest
from .licences import OP5_SQL, op5_licence_scan
from .manifest import OP13_SQL, op13_merkle_manifest
from .mixing import OP8_SQL, op8_mixing
from .packing import op10_best_fit_packing
from .quality import OP6_SQL, op6_quality_rules
from .resample import OP12_SQL, op12_resample
from .simhash import op9_simhash_bit_sliced
from .suffixes import op3_suffix_dedup
from .toxicity import op1_toxicity_chain
from .units import op2_line_dedup
from .warc import OP7_SQL, op7_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity_chain,
        op2_line_dedup,
        op3_suffix_dedup,
        op4_decontamination,
        op5_licence_scan,
        op6_quality_rules,
        op7_warc,
        op8_mixing,
        op9_simhash_bit_sliced,
        op10_best_fit_packing,
        op11_lsh_forest,
        op12_resample,
        op13_merkle_manifest,
    )
}
ORACLE_SQL = {
    "op5_licence_scan": OP5_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op11_lsh_forest": OP11_SQL,
    "op12_resample": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
