"""Page streams on Spark: classify, split, tag, score, decide, assemble and evaluate."""

from pagestream.operators.lookahead import SplitConfig, decide
from pagestream.plans.pipeline import PipelineConfig, Result, evaluate, inspect, parse

__all__ = ["PipelineConfig", "Result", "SplitConfig", "decide", "evaluate", "inspect", "parse"]
