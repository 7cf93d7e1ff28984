"""tidewatch: network-telemetry analytics as Spark DataFrame transformations.

Flow logs or packets -> overlapping time windows -> a wide state row per window -> staged labels and
look-ahead targets -> scores, causal thresholds, alarms, episodes and their evaluation. Every operator takes
and returns DataFrames keyed by ``split`` (the capture: a day, a sensor, a scenario) and ``w`` (the window).
"""

from tidewatch.operators.grid import Grid, WindowSpec

__all__ = ["Grid", "WindowSpec"]
