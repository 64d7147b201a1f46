"""Slot-aware knowledge analytics on Spark."""
