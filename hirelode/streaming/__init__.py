"""Run-to-run state as streams."""
