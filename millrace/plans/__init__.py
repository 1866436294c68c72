"""One flat select block per pipeline stage, and its compilation to a DataFrame."""
from .block import Block, Join, compile_block, resolver, safe_projected  # noqa: F401
