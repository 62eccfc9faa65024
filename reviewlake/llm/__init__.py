"""Operators for training corpora, each with a registered query."""

from reviewlake.llm import decontaminate, html_text, language_id, line_dedup, mixture, private_data, quality_model, quality_rules, repeats, simhash, token_alignment, token_counts, vector_codes  # noqa: F401
from reviewlake.llm.registry import QUERIES, SQL  # noqa: F401
