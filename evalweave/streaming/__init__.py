"""Scores that follow generations as they are judged."""
