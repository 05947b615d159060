"""Operators over DataFrames: index maintenance, import graphs, retrieval, packing, messages and telemetry."""
