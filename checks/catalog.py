"""All registered queries; importing the modules fills the registry."""

from checks import choice_queries, evaluation_queries, feature_queries, model_queries, profile_queries, source_queries  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
