"""Queries over the benchmark tables; importing this package registers them."""

from . import event_plans, power_plans, select_plans, graph_plans, check_plans, activity_plans, physical_plans, stream_plans  # noqa: F401
