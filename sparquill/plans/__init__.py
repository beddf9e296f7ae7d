"""Adaptive plan selection: alternatives to Catalyst's plan, predicted, gated and logged."""
