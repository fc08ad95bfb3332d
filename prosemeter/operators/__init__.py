"""Operators over documents: signals, issues, passages, verdicts, facts, overlap, rewriting, evaluation, state."""
