"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import experiments, files, graph, questions, scores, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "experiments", "files", "graph", "questions", "scores", "texts"]
