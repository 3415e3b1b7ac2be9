"""Operators over DataFrames: incidents, graph context, actions, gate, metrics, training rows."""
