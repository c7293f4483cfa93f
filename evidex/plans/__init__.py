"""The registered queries."""

from . import evaluation, extensions, indexes, knowledge, ranking, records, retrieval, streams, summaries, text
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "extensions", "indexes", "knowledge", "ranking", "records", "retrieval", "streams", "summaries", "text"]
