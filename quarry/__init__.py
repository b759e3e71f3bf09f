"""Quarry: a catalogue and text-corpus engine written as Spark DataFrame jobs."""
