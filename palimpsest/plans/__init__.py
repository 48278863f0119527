"""Registered queries of the core library."""

from __future__ import annotations


def registries() -> list:
    from palimpsest.plans import data_quality, insight, memory, pipeline

    return [data_quality.registry, memory.registry, insight.registry, pipeline.registry]
