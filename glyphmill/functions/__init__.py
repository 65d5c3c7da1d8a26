"""The tokenizer on columns and tables."""

from .columns import TokenizerFunctions, register

__all__ = ["TokenizerFunctions", "register"]
