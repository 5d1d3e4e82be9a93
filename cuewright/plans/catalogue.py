"""All registered queries; importing the family modules fills the registry."""
from . import (library_queries, signal_queries, timing_queries, transcript_queries,  # noqa: F401
               translation_queries)
from .registry import ORACLES, QUERIES  # noqa: F401
