"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from ledgerlark.llm.collocations import OP13_SQL, op13_phrase_collocations
from ledgerlark.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from ledgerlark.llm.html_text import op1_html_extraction
from ledgerlark.llm.language_id import op5_language_id
from ledgerlark.llm.licences import op3_license_scans
from ledgerlark.llm.media import op9_media_columns
from ledgerlark.llm.mixing import op4_mix_sources
from ledgerlark.llm.ngram_join import op7_ngram_jaccard_join
from ledgerlark.llm.packing import op2_best_fit_packing
from ledgerlark.llm.quality import op6_quality_classifier
from ledgerlark.llm.quality_rules import op11_quality_rules
from ledgerlark.llm.tokens import op8_token_counts
from ledgerlark.llm.whitening import op12_embedding_whitening

QUERIES = {"op1_html_extraction": op1_html_extraction, "op3_license_scans": op3_license_scans, "op2_best_fit_packing": op2_best_fit_packing, "op4_mix_sources": op4_mix_sources, "op5_language_id": op5_language_id, "op6_quality_classifier": op6_quality_classifier, "op7_ngram_jaccard_join": op7_ngram_jaccard_join, "op8_token_counts": op8_token_counts, "op9_media_columns": op9_media_columns, "op10_exact_dedup": op10_exact_dedup, "op11_quality_rules": op11_quality_rules, "op12_embedding_whitening": op12_embedding_whitening, "op13_phrase_collocations": op13_phrase_collocations}
SQL = {"op10_exact_dedup": OP10_SQL, "op13_phrase_collocations": OP13_SQL}
