"""Every registered query of the library's own operators, with its SQL twin."""

from . import corpus_queries, label_queries, mask_queries, source_queries, vector_queries  # noqa: F401
from .book import ORACLE, QUERIES  # noqa: F401
