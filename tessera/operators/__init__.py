"""Operators over DataFrames: retrieval, evaluation, mining, memory, queues and commerce."""
