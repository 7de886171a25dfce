"""Registered queries, grouped by area."""

from __future__ import annotations

import importlib

AREAS = ("scans", "aggregates", "stakes", "streams", "replication", "rollbacks", "integrity", "commitments", "snapshots", "forms")


def load_all():
    for area in AREAS:
        importlib.import_module(f"blockloom.plans.{area}")
    return importlib.import_module("blockloom.plans.registry")
