"""Canonical tables of the engine; missing values are nulls, never NaN."""

SNAP = "traj int, t int, node int, f array<double>"
EDGES = "traj int, t int, src int, dst int, w double"  # t null: holds at every step
CTRL = "traj int, t int, node int, u array<double>"  # node null: one control for all nodes
TIMES = "traj int, t int, ts double"
MASK = "traj int, t int, node int, observed boolean"
FORECAST = "traj int, origin int, h int, node int, f array<double>"
SPECTRUM = "mode int, re double, im double, magnitude double, growth double, freq double"
METRICS = "horizon int, mae double, rmse double, mape double"
MATRIX = "name string, i int, j int, v double"
