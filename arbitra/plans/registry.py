"""All registered queries of the decision engine."""

from __future__ import annotations

from . import control, coverage, dataset, decisions, evaluation, jobs, metrics, models, packs, records, streams, student, workflow

QUERIES = {}
for family in (metrics, dataset, workflow, control, streams, decisions, records, models, packs, evaluation, coverage, student, jobs):
    QUERIES |= family.QUERIES
