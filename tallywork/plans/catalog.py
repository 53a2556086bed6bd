"""All registered queries; importing the query modules fills the registry."""

from tallywork.plans import code_queries, log_queries, reward_queries, stream_queries, text_queries, vote_queries  # noqa: F401
from tallywork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
