"""The registered queries of this subpackage and the SQL that stands beside them."""

from .chat import OP8_SQL, op8_chat
from .decontaminate import op2_decontamination
from .language import op5_language_id
from .minhash import op6_minhash_dedup
from .negatives import OP12_SQL, op12_hard_negatives
from .neighbours import op3_neighbours
from .pieces import op1_sentencepiece
from .pii import OP11_SQL, op11_pii
from .quality import op10_quality
from .spelling import OP13_SQL, op13_spelling_variants
from .suffix_dedup import op4_suffix_dedup
from .url_filter import op7_url_filter
from .warc import op9_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontamination": op2_decontamination,
    "op3_neighbours": op3_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_language_id": op5_language_id,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_pii": op11_pii,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op8_chat": OP8_SQL, "op11_pii": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
