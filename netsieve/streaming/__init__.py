"""Structured Streaming forms: flow-stat source (S8), the live detection
stream (ST7) and stateful block episodes (ST3 with applyInPandasWithState)."""
