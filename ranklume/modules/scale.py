"""A user module: a score times a number."""

META = {"name": "scale", "version": "1", "reads": [3001], "writes": [3002], "params": {"by": "float"}, "scope": "row", "budget": {"max_write_bytes": 400_000_000, "max_write_cells": 100_000_000}}


def run_batch(batch, ctx, params):
    batch.write_f32(3002)[:] = batch.f32(3001) * params["by"]
