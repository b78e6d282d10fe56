"""Structured Streaming form of the weekly article counts (an addition of this engine)."""
