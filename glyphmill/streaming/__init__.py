"""Structured Streaming: stateful decoding and response parsing, keyed by stream."""

from .stateful import batch_decode, stream_decode, stream_parse

__all__ = ["batch_decode", "stream_decode", "stream_parse"]
