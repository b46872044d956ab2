"""Operators for building training data from documents at scale.

Nothing outside this subpackage imports it; ``geostrata.llm.entry`` lists the
queries and ``corpus_pipeline`` chains five of the operators.
"""
