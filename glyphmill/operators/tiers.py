"""The tier of each stage: what the column functions will make of a tokenizer."""

from __future__ import annotations

from ..core.models import WordLevel
from ..core.tokenizer import Tokenizer

NATIVE = "native"  # expressions inside the plan
RELATIONAL = "relational"  # explode, broadcast join, ordered collect
VECTORIZED = "vectorized"  # one Python function over Arrow batches


def tiers(tokenizer: Tokenizer) -> dict[str, str]:
    """normalize, pre_tokenize, encode, post_process, decode of a tokenizer by tier.

    A chain is native only where all of it is: a native pre-tokenizer after a normalizer that is
    not runs in the same Python function as that.
    """
    plain = not tokenizer.splitter.tokens and not tokenizer.late_splitter.tokens
    normalize = NATIVE if tokenizer.normalizer.native else VECTORIZED
    cut = NATIVE if normalize == NATIVE and tokenizer.pre_tokenizer.native else VECTORIZED
    return {
        "normalize": normalize,
        "pre_tokenize": cut,
        "encode": RELATIONAL if cut == NATIVE and plain and isinstance(tokenizer.model, WordLevel) else VECTORIZED,
        "post_process": NATIVE,
        "decode": VECTORIZED,
    }
