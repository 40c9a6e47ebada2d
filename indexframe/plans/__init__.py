"""Logical side of the engine: keys, conditions and their lowering to Catalyst expressions."""
