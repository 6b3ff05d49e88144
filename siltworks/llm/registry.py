"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from ..session import importable
from .audio import op3_audio_fingerprints
from .bpe import op5_bpe
from .chat import op6_chat
from .conversation_repair import OP13_SQL, op13_conversation_repair
from .decontaminate import op8_decontaminate
from .embedding_dedup import OP11_SQL, op11_embedding_dedup
from .html_extract import op10_html_extract
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .line_dedup import op9_line_dedup
from .quality import op4_quality
from .source_audit import OP12_SQL, op12_source_audit
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import OP2_SQL, op2_suffix_dedup


def _importable(query):
    """query with this package on the workers' path, for sessions that were started elsewhere."""

    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_audio_fingerprints": op3_audio_fingerprints,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_chat": op6_chat,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_dedup": op9_line_dedup,
    "op10_html_extract": op10_html_extract,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_source_audit": op12_source_audit,
    "op13_conversation_repair": op13_conversation_repair,
}
QUERIES = {name: _importable(query) for name, query in QUERIES.items()}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op7_jaccard_join": OP7_SQL,
    "op11_embedding_dedup": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_conversation_repair": OP13_SQL,
}
