"""Discovery, verification and triage of denial constraints on Spark DataFrames."""

from gainsay.plans.discover import dependency_scores, discover, discover_many, discover_table

__all__ = ["dependency_scores", "discover", "discover_many", "discover_table"]
