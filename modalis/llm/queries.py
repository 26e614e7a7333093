"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .codes import op12_vector_codes
from .edits import op7_edit_fingerprints
from .jaccard import op6_jaccard_join
from .langid import op3_language_id
from .licenses import op9_license_scan
from .mixing import op5_source_mixing
from .packing import op4_best_fit_packing
from .privacy import op10_disclosure_sanitisation
from .search import op11_lexical_search
from .sharding import op8_sharding
from .statements import ORACLE_SQL
from .templates import op2_chat_template
from .tokencount import op13_token_counts
from .transport import op1_transport_streams

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Those without a statement are held against brute force, exact round trips and held-out accuracy by tests.
QUERIES = {f.__name__: f for f in (op1_transport_streams, op2_chat_template, op3_language_id, op4_best_fit_packing, op5_source_mixing, op6_jaccard_join, op7_edit_fingerprints, op8_sharding, op9_license_scan, op10_disclosure_sanitisation, op11_lexical_search, op12_vector_codes, op13_token_counts)}
