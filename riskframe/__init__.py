"""Cost-weighted risk decisioning on Spark DataFrames and streams."""

from riskframe.config import Costs, MonitoringConfig, RulesConfig, SplitBounds

__all__ = ["Costs", "MonitoringConfig", "RulesConfig", "SplitBounds"]
