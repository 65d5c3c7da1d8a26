"""How each stage of a tokenizer is carried out on Spark."""

from .tiers import NATIVE, RELATIONAL, VECTORIZED, tiers

__all__ = ["NATIVE", "RELATIONAL", "VECTORIZED", "tiers"]
