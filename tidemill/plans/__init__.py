"""Flows composed of operators; they return DataFrames and change no file."""
