"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from tallyloom.llm.fingerprints import op10_fingerprints
from tallyloom.llm.html_extract import op5_html_extract
from tallyloom.llm.importance import OP12_SQL, op12_importance
from tallyloom.llm.jaccard import op8_jaccard_join
from tallyloom.llm.line_dedup import OP4_SQL, op4_line_dedup
from tallyloom.llm.lm import op7_lm_scores
from tallyloom.llm.minhash import op13_minhash
from tallyloom.llm.mixing import OP2_SQL, op2_mix_sources
from tallyloom.llm.packing import op3_packing
from tallyloom.llm.quality import op9_quality_rules
from tallyloom.llm.search import OP11_SQL, op11_lexical_search
from tallyloom.llm.secrets import op1_secret_scan
from tallyloom.llm.tokens import op6_token_files

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_extract": op5_html_extract,
    "op6_token_files": op6_token_files,
    "op7_lm_scores": op7_lm_scores,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_fingerprints": op10_fingerprints,
    "op11_lexical_search": op11_lexical_search,
    "op12_importance": op12_importance,
    "op13_minhash": op13_minhash,
}
ORACLES = {"op2_mix_sources": OP2_SQL, "op4_line_dedup": OP4_SQL, "op11_lexical_search": OP11_SQL, "op12_importance": OP12_SQL}
