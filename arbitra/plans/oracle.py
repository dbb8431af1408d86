"""The SQL of all registered queries that SQL can express."""

from __future__ import annotations

from . import control, coverage, dataset, decisions, evaluation, jobs, metrics, models, packs, records, streams, student, workflow

SQL = {}
for family in (metrics, dataset, workflow, control, streams, decisions, records, models, packs, evaluation, coverage, student, jobs):
    SQL |= family.SQL
