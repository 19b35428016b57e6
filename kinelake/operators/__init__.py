"""Operators over sample, frame, signal and verdict tables; each takes and returns DataFrames.

Tables, by their columns:

samples   dataset, subject, t, ord, activity, node, ax ay az, gx gy gz, has_gyro
frames    dataset, subject, seg, win, start, end, label, node, idx, t, ax ay az, gx gy gz, has_gyro
truth     dataset, subject, seg, win, target_node, failure, severity, realised, ...
"""

WINDOW_KEY = ("dataset", "subject", "seg", "win")
NODE_KEY = (*WINDOW_KEY, "node")
