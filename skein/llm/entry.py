"""The queries of this subpackage and their SQL, for the registry at the repository's top."""

from __future__ import annotations

from .exact_dedup import OP7_SQL, op7_exact_dedup
from .langid import op6_language_id
from .lm import op2_gru_language_model
from .media import op1_flac_media
from .mixing import op5_pfair_mixing
from .near_dedup import op8_minhash_near_dedup
from .packing import op4_best_fit_packing
from .privacy import op10_pii_disclosure
from .quality import op3_quality_classifier
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_flac_media": op1_flac_media,
    "op2_gru_language_model": op2_gru_language_model,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_language_id": op6_language_id,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_warc": op9_warc,
    "op10_pii_disclosure": op10_pii_disclosure,
}

ORACLE_SQL = {"op7_exact_dedup": OP7_SQL, "op9_warc": OP9_SQL}
