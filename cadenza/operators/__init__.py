"""Operators on DataFrames; each is partitioned by recording (or section), so they run side by side."""
