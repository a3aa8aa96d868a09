"""The registered queries of the operators and the SQL of those that SQL can express."""

from importlib import import_module

MODULES = ("quality_rules", "url_filter", "decontaminate", "suffix_dedup", "license_scan", "toxicity", "jaccard_join", "mixing", "warc", "chat_format",
           "line_dedup", "centroid_clustering", "spelling_variants")

_LOADED = [import_module(f"groundwork.llm.{name}") for name in MODULES]
QUERIES = {name: run for module in _LOADED for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _LOADED for name, sql in module.ORACLES.items()}
