"""Operators over training corpora, their queries and SQL."""

import importlib

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the task, so executors need no install of the package.
for _name in ("common", "shingles", "minhash", "decontaminate", "pretokens", "token_counts", "main_text", "language", "byte_bpe", "warc", "quality",
              "fill_middle", "filter_audit", "context_tree"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"trialmesh.llm.{_name}"))
